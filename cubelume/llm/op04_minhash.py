"""MinHash near-duplicates by DartMinHash.

A document is its multiset of word shingles (five words; a shorter text is one shingle): a shingle's weight is the number of its
occurrences. Documents of equal multisets are one class first.
Darts: each shingle has a Poisson process of hashed darts over the region (its weight) x (rank), the same in every
document. A document keeps the darts that fall under its shingles' weights and under a rank of about k ln k + 2 k
darts in all, and of those the earliest for each of the k coordinates; if a coordinate has none, the rank is doubled. Two
documents agree in a coordinate with a probability equal to their weighted Jaccard similarity, sum of the lesser over sum of the
greater weights; for texts that repeat no shingle that is the similarity of sets.

BANDS bands of ROWS coordinates are buckets, which are gone through in turns. First each bucket's lead (the first in an order that is
the same in all buckets) is compared with the others: no pairs within a bucket. Links are contracted to components, and in the second turn,
with other leads, only one document of each component that isn't the lead's is compared. Then documents
of different components that are still in one bucket are compared by a join on their rarest shingles, which passes
over what many documents share. So the size of a bucket loses no link between components. Before texts are fetched the signatures
must agree in LEAST_AGREED coordinates, four standard deviations below the threshold. Links have exact similarity >= 0.8.

A pair at the threshold misses all bands with probability (1 - 0.8^ROWS)^BANDS, 3e-6, and agrees in fewer than LEAST_AGREED coordinates with 3e-5: that
pair is then no link, unless others join its documents. Both fall fast with the similarity.

Defined results: a text without words (null, empty) and a row without doc_id is a class of its own; a document is a doc_id and its
text, so that repeated rows are one document and texts under one doc_id are documents of their own (ties for the one that stays go by a hash of
the text); very long texts are read whole; an empty table gives no rows; further columns are ignored, or kept by deduplicated().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, drop_scratch, fresh, mix64, ready, scratch_mark, slices, table, trim, written
from .components import connected_components
from .words import shingles, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
K = BANDS * ROWS
LEAST_AGREED = int(K * (SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / K) ** 0.5))
#: Coordinates are kept as 8 bits, 7 of them in a long.
LANES = 7
LONGS = -(-K // LANES)
#: Ids up to this many are broadcast (16 MB); beyond it Spark joins by shuffle.
BROADCAST_IDS = 1_000_000
TURNS = 2
#: Documents that begin with one shingle are compared in blocks of about this many.
BLOCK = 256
_LOW7, _HIGH = 0x007F7F7F7F7F7F7F, 0x0080808080808080


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _throw(h: np.ndarray, weight: np.ndarray, owner: np.ndarray, limit: np.ndarray, k: int, best: np.ndarray, dart: np.ndarray) -> None:
    """Darts of elements h (in documents `owner`) with ranks under limit[owner]; the earliest go to best and dart (documents x k).
    The weight axis is cut at 1, 2, 4, ...; each part has a process of its own, of a rate as its width."""
    part, low, high = 0, 0.0, 1.0
    while True:
        in_part = np.flatnonzero(weight > low)
        if not len(in_part):
            return
        x = mix64(h[in_part] + np.uint64((part * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
        w, own, rank, i = weight[in_part], owner[in_part], np.zeros(len(in_part)), 0
        while len(x):
            i += 1
            u = mix64(x + np.uint64((i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(_uniform(u)) / (high - low)
            go = rank < limit[own]
            x, w, own, rank, u = x[go], w[go], own[go], rank[go], u[go]
            thrown = mix64(u)
            key, r = own * k + (thrown % np.uint64(k)).astype(np.int64), rank
            if (w < high).any():  # where on the weight axis it fell
                under = low + (high - low) * _uniform(mix64(thrown + np.uint64(1))) < w
                key, r, thrown = key[under], r[under], thrown[under]
            np.minimum.at(best, key, r)
            won = best[key] == r
            dart[key[won]] = thrown[won]
        part, low, high = part + 1, high, high * 2


def signatures(h: np.ndarray, weight: np.ndarray, counts: np.ndarray, k: int = K) -> np.ndarray:
    """Documents x k darts (uint64), for documents of counts (> 0) distinct elements each."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    total = np.bincount(owner, weight, n)
    limit = (k * np.log(k) + 2 * k) / total
    best, dart = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    todo = np.arange(n)
    while len(todo):
        mine = np.isin(owner, todo)
        best.reshape(n, k)[todo] = np.inf
        _throw(h[mine], weight[mine], owner[mine], limit, k, best, dart)
        todo = todo[~np.isfinite(best.reshape(n, k)[todo]).all(1)]
        limit[todo] *= 2
    return dart.reshape(n, k)


def distinct_shingles(texts: list, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, one text after the other; how often each occurs; and their numbers."""
    h, n = shingles(*word_hashes(texts), k)
    ends = np.cumsum(n)
    sets = [np.unique(h[a:b], return_counts=True) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
    if not sets:
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in sets]), np.concatenate([c for _, c in sets]), np.array([len(s) for s, _ in sets], np.int64)


def _occurrences(h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """An element of its own for each occurrence of a shingle, so that the weighted similarity is that of sets of these."""
    first = np.cumsum(times) - times
    nth = np.arange(int(times.sum())) - np.repeat(first, times)
    return mix64(np.repeat(h, times) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _packed(sig: np.ndarray) -> np.ndarray:
    """8 bits of each coordinate, LANES in a long."""
    lanes = np.zeros((len(sig), LONGS * LANES), np.uint64)
    lanes[:, : sig.shape[1]] = sig & np.uint64(0xFF)
    return (lanes.reshape(len(sig), LONGS, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(8))).sum(2, dtype=np.uint64).astype(np.int64)


def agreed(a: Column, b: Column) -> Column:
    """Number of coordinates in which two packed signatures agree: zero bytes of the longs' exclusive or."""
    total = F.lit(K - LONGS * LANES)
    for i in range(LONGS):
        x = a[i].bitwiseXOR(b[i])
        nonzero = (x.bitwiseAND(F.lit(_LOW7)) + F.lit(_LOW7)).bitwiseOR(x).bitwiseAND(F.lit(_HIGH))
        total = total + F.lit(LANES) - F.bit_count(nonzero)
    return total


def _lists(rows: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """n lists: the rows at their places, null elsewhere."""
    values = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))
    where = np.full(n, -1)
    where[at] = np.arange(len(at))
    return values.take(pa.array(where, mask=where < 0))


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, h (of the text), n, k1, k2 (of the shingles), bands, sig of every row; n is 0 where there are no words or no id."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in slices(texts, 1_000_000):
                h, times, n = distinct_shingles(texts[lo:hi], words)
                has = np.flatnonzero(n)
                total, k1, k2 = np.zeros((3, hi - lo), np.int64)
                band, sig = np.zeros((0, BANDS), np.int64), np.zeros((0, K), np.uint64)
                if len(has):
                    counts = n[has]
                    first, w = np.cumsum(counts) - counts, times.astype(np.uint64)
                    sig = signatures(h, times.astype(np.float64), counts)
                    total[has] = np.add.reduceat(times, first)
                    k1[has], k2[has] = (np.add.reduceat(mix64(h + np.uint64(x)) * w, first).astype(np.int64) for x in (17, 91))
                    code = np.zeros((len(has), BANDS), np.uint64)
                    for r in range(ROWS):
                        code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
                    band = mix64(code + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
                lists = [_lists(x, has, hi - lo) for x in (band, _packed(sig))]
                trim()
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("h").slice(lo, hi - lo), *map(pa.array, (total, k1, k2)), *lists], ["doc_id", "h", "n", "k1", "k2", "bands", "sig"])

    doc_id, text = col(docs, "doc_id").cast("long"), col(docs, "text")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("h"), F.when(doc_id.isNotNull(), text).alias("text"))
    ready(docs.sparkSession)
    return rows.mapInArrow(made, "doc_id long, h long, n long, k1 long, k2 long, bands array<long>, sig array<long>")


def _elements_of(docs: DataFrame, reps: DataFrame, nodes: DataFrame, words: int, tag: str) -> DataFrame:
    """node, elements (an element for each occurrence of a shingle) of the nodes, from the texts of their representatives."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys = b.column("text").to_pylist(), b.column("node")
            for lo, hi in slices(texts, 1_000_000):
                h, times, n = distinct_shingles(texts[lo:hi], words)
                ends = np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], np.cumsum(n)])]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_occurrences(h, times).astype(np.int64)))], ["node", "elements"])

    wanted = written(reps.join(nodes.distinct(), "node").select("node", F.col("doc_id").alias("rep_id"), F.col("h").alias("rep_h")), f"{tag}-nodes")
    small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(col(docs, "doc_id").cast("long").alias("rep_id"), F.xxhash64(col(docs, "text")).alias("rep_h"), col(docs, "text").alias("text"))
    rows = rows.join(F.broadcast(wanted) if small else wanted, ["rep_id", "rep_h"]).select("node", "text").dropDuplicates(["node"])
    return written(rows.mapInArrow(made, "node long, elements array<long>"), f"{tag}-sets")


def _verified(sets: DataFrame, pairs: DataFrame, similarity: float, tag: str) -> DataFrame:
    """Of pairs (a, b) those of at least that similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("elements").alias(f"e{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ea", "eb"))
    return written(both.where(common >= similarity * (F.size("ea") + F.size("eb") - common) - 1e-9).select("a", "b"), f"{tag}-links")


def _star(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): in each bucket (code, node, part) one node of each part with the bucket's lead, if that is of another part. At first
    the order by which leads are chosen is the same in all buckets, so that nodes which share many buckets meet few leads; later each
    bucket has its own, so that a part meets many."""
    order = F.xxhash64("node") if turn == 0 else F.xxhash64("node", "code")
    ones = members if turn == 0 else members.groupBy("code", "part").agg(F.min_by("node", order).alias("node"))
    lead = ones.groupBy("code").agg(F.min_by(F.struct(F.col("node").alias("lead"), F.col("part").alias("of")), order).alias("l")).select("code", "l.*")
    return ones.join(lead, "code").where("part != of").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in LEAST_AGREED coordinates."""
    sides = [reps.select(F.col("node").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(agreed(F.col("sa"), F.col("sb")) >= LEAST_AGREED).select("a", "b")


def _across(sets: DataFrame, part: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components (part: node, part) that may reach the similarity: all that do are there.

    Elements stand in one order, rarest first. Sets of n elements that reach t share at least t n, so they share one of
    their first n - ceil(t n) + 1; and from the first that they share on, each must have t / (1 + t) of both's elements left.
    Elements of one set alone can't be shared: they only take places. Passages of many documents come last in the order. Nodes
    of an element that many begin with are dealt in blocks: one side stands in its own block, the other one in all."""
    e = sets.select("node", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    common = e.groupBy("e").agg(F.count("*").alias("c")).where("c > 1")
    w = Window.partitionBy("node")
    shared = e.join(common, "e").withColumn("k", F.row_number().over(w.orderBy("c", "e"))).withColumn("s", F.count("*").over(w))
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - (F.col("n") - F.col("s"))
    prefix = shared.where(F.col("k") <= first).select("node", "e", "n", (F.col("s") - F.col("k") + 1).alias("left")).join(part, "node")
    prefix = written(prefix, "mh-prefix")
    open_ = prefix.groupBy("e").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    prefix = prefix.join(open_.drop("lo", "hi"), "e").join(reps.select("node", "sig"), "node")
    values = ("node", "n", "left", "part", "sig")
    x = prefix.select("e", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), *[F.col(v).alias(f"{v}_a") for v in values])
    y = prefix.select("e", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(v).alias(f"{v}_b") for v in values])
    enough = F.least("left_a", "left_b") >= (F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - 1e-9
    met = x.join(y, (x["e"] == y["e"]) & (x["block"] == y["block"]) & (F.col("part_a") < F.col("part_b")) & enough & (agreed(F.col("sig_a"), F.col("sig_b")) >= LEAST_AGREED))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, h, class_id, kept, rows: every document (a distinct non-null doc_id and text, whose hash is h), the least doc_id of its
    near-duplicates, whether it is the one that stays of them, and how many rows it has."""
    spark = docs.sparkSession
    mark = scratch_mark(spark)
    made = written(sketches(docs, words), "mh-sketches")
    least = F.min(F.struct("doc_id", "h")).alias("rep")
    reps = made.where("n > 0").groupBy("k1", "k2", "n").agg(least, F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "n", "rep.*", "bands", "sig"), "mh-reps")
    banded = reps.select("node", F.explode("bands").alias("code"))
    shared = banded.groupBy("code").agg(F.count("*").alias("size")).where("size > 1")
    inside = written(banded.join(shared, "code").select("code", "node", "size"), "mh-members")

    # buckets in turns: a member of each component against the bucket's lead, as long as a turn finds links
    parts, members, sets, turn = None, inside.select("code", "node", F.col("node").alias("part")), None, 0
    while turn < TURNS:
        star = written(_alike(_star(members, turn), reps), "mh-star")
        if turn == 0:
            found = _verified(_elements_of(docs, reps, star.select(F.explode(F.array("a", "b")).alias("node")), words, "mh-star"), star, similarity, "mh-star")
        else:
            found = _verified(sets, star, similarity, "mh-star")
        parts = connected_components(found if parts is None else found.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))), "mh")
        # buckets of two are settled by their pair; of the others those with several components stay
        label = (inside.where("size > 2") if turn == 0 else members).select("code", "node").join(parts, "node", "left").select("code", "node", F.coalesce("component", "node").alias("part"))
        mixed = label.groupBy("code").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("code")
        members = written(label.join(mixed, "code"), "mh-mixed")
        if members.isEmpty():
            break
        if turn == 0:
            sets = _elements_of(docs, reps, members.select("node"), words, "mh-rest")
        turn += 1

    # what is left: documents of different components that may still be near, by the rarest shingles they share
    if not members.isEmpty():
        across = written(_across(sets, members.select("node", "part").distinct(), reps, similarity), "mh-across")
        found = _verified(sets, across, similarity, "mh-across")
        if not found.isEmpty():
            parts = connected_components(found.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))), "mh")

    of_node = reps.select("node", F.struct("doc_id", "h").alias("rep")).join(parts, "node")
    first = of_node.groupBy("component").agg(F.min("rep").alias("first"))
    of_node = of_node.join(first, "component").select("node", "first")
    of_set = reps.join(of_node, "node", "left").select("k1", "k2", "n", F.coalesce("first", F.struct("doc_id", "h")).alias("first"))
    known = made.where("n > 0").select("doc_id", "h", "n", "k1", "k2").join(of_set, ["k1", "k2", "n"]).select("doc_id", "h", "first")
    alone = made.where("n = 0 AND doc_id IS NOT NULL").select("doc_id", "h", F.struct("doc_id", "h").alias("first"))
    out = known.unionByName(alone).groupBy("doc_id", "h").agg(F.min("first").alias("first"), F.count("*").alias("rows"))
    out = written(out.select("doc_id", "h", F.col("first.doc_id").alias("class_id"), (F.col("first") == F.struct("doc_id", "h")).alias("kept"), "rows"), "mh-classes")
    drop_scratch(spark, mark, keep=1)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept: one row of each document (distinct doc_id and text), and one of each row without doc_id."""
    found = classes(docs, words, similarity).select("doc_id", "class_id", "kept")
    doc_id = col(docs, "doc_id").cast("long")
    return found.unionByName(docs.where(doc_id.isNull()).select(doc_id.alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")))


def deduplicated(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of docs that stay: one document of each class, one row of each document (of repeated ones that differ in other columns the
    first in order of a hash of all), and all rows without doc_id."""
    found = classes(docs, words, similarity)
    gone_id, gone_h = fresh(docs, "gone_id", "gone_h")
    gone = written(found.where("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h)), "mh-gone")
    side = F.broadcast(gone) if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else gone
    doc_id, h = col(docs, "doc_id").cast("long"), F.xxhash64(col(docs, "text"))
    out = docs.join(side, (doc_id == F.col(gone_id)) & (h == F.col(gone_h)), "left_anti")
    if found.where("rows > 1").isEmpty():
        return out
    doc_id, h = col(out, "doc_id").cast("long"), F.xxhash64(col(out, "text"))
    hashed = F.xxhash64(*[col(out, c) for c, kind in docs.dtypes if "map<" not in kind])
    once = out.where(doc_id.isNotNull()).groupBy(doc_id, h).agg(F.min_by(F.struct(*[col(out, c) for c in docs.columns]), hashed).alias("row")).select("row.*")
    return once.unionByName(out.where(doc_id.isNull()))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op4_minhash": op4_minhash}
