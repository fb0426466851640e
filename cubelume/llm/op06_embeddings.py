"""Near-duplicate embeddings by cross-polytope hashing.

Equal vectors are one first. A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the
coordinate of largest size, with its sign. Two to four hashes make a bucket (wide), buckets of other rotations make
the index, and each vector also stands in further buckets of each table, with the second largest coordinate in place of the
largest where that is closest. More hashes come with more tables and probes (INDEX), so that recall doesn't fall with the number of vectors. Vectors that share a bucket are compared by cosine in double precision; a pair that meets in
several buckets counts in the least of them. Buckets of more than BLOCK vectors are split in blocks, every two of which meet in a task of
their own, so that no task holds more than 2 BLOCK vectors and no link is lost.

Recall for pairs at the threshold is estimated in tests against brute force; see README. It never falls with the number of vectors, but as the setting
follows that number, one of the few pairs that are missed in one table may be found when the same vectors stand in a larger one.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
different lengths; repeated rows are copies that link; a vec_id stands for one vector; a vector without
vec_id has a null component and is kept; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, ready, table, written
from .components import connected_components

COSINE = 0.9
TABLES, PROBES = 6, 3
#: Tables and probes by the number of hashes: pairs at COSINE are found at least as often as with two, in 64 and in 384 dimensions.
INDEX = {2: (TABLES, PROBES), 3: (10, 6), 4: (18, 9)}
BLOCK = 1024
SMALL = 48


def wide(n: int) -> int:
    """Hashes in a bucket's code for n vectors of some dimension: 128 values each leave few strangers in a bucket."""
    return 2 if n < 5_000_000 else 3 if n < 600_000_000 else 4


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray, k: int, tables: int | None = None, probes: int | None = None, seed: int = 7) -> np.ndarray:
    """Bucket codes of unit vectors: n x (tables * probes), the probes of a table side by side, the first its own bucket."""
    tables, probes = tables or INDEX[k][0], probes or INDEX[k][1]
    n, d = x.shape
    d2 = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, d2), np.float32)
    padded[:, :d] = x
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (tables, k, 3, d2))
    out = np.empty((n, tables * probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, gap = np.empty((n, k), np.int64), np.empty((n, k), np.int64), np.empty((n, k), np.float32)
        for j in range(k):
            y = padded
            for r in range(3):
                y = _hadamard(y * signs[t, j, r]) / np.float32(np.sqrt(d2))
            size = np.abs(y)
            a = size.argmax(1)
            top = size[rows, a]
            size[rows, a] = -1
            b = size.argmax(1)
            best[:, j], second[:, j] = 2 * a + (y[rows, a] > 0), 2 * b + (y[rows, b] > 0)
            gap[:, j] = top - size[rows, b]
        power = (2 * d2) ** np.arange(k)
        own = best @ power
        order = np.argsort(gap, axis=1, kind="stable")
        out[:, t * probes] = own
        for p in range(1, probes):  # one hash at a time, the one of least gap first; then the first two together
            j = order[:, (p - 1) % k]
            code = own + (second[rows, j] - best[rows, j]) * power[j]
            if p > k and k > 1:
                i = order[:, p % k]
                code = code + (second[rows, i] - best[rows, i]) * power[i]
            out[:, t * probes + p] = code
        out[:, t * probes : (t + 1) * probes] += t << 56
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; by the largest component first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    top = np.abs(x).max(1, keepdims=True)
    x = np.ldexp(x, -np.frexp(top)[1])  # a power of two: exact, and sound for denormal numbers, too
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pairs(unit: np.ndarray, group: np.ndarray, bucket: np.ndarray, side: np.ndarray, own: np.ndarray, probes: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group (rows are sorted by group) that link, each only in the least bucket that the two share.
    side: 0, or in a meeting of two blocks the block (1 or 2): there only pairs across count. own: codes of the rows."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    small = np.repeat(sizes <= SMALL, sizes)
    left, right = [], []
    for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]))
        i = i[np.einsum("ij,ij->i", unit[i], unit[i + d]) >= least]
        left.append(i)
        right.append(i + d)
    for g in np.flatnonzero(sizes > SMALL):
        a, b = starts[g], starts[g] + sizes[g]
        i, j = np.nonzero(np.triu(unit[a:b] @ unit[a:b].T >= least, 1))
        left.append(i + a)
        right.append(j + a)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    keep = (side[i] == 0) | (side[i] != side[j])
    i, j = i[keep], j[keep]
    least_shared = np.full(len(i), np.iinfo(np.int64).max)
    for t in range(0, own.shape[1], probes):
        for p in range(t, t + probes):
            a = own[i, p]
            for q in range(t, t + probes):
                least_shared = np.where(a == own[j, q], np.minimum(least_shared, a), least_shared)
    keep = least_shared == bucket[i]
    return i[keep], j[keep]


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges node - least node that join what the pairs join."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def links(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id."""
    spark = ready(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"  # shipped as they are, compared as doubles
    v = vectors.select(col(vectors, "vec_id").cast("long").alias("vec_id"), col(vectors, "embedding").cast(kind).alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("e").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0)
    good = v.where(F.coalesce(sound, F.lit(False)))
    reps = written(good.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vec-reps")
    k = wide(reps.count())
    n_codes, probes = INDEX[k][0] * INDEX[k][1], INDEX[k][1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array([len(x) for x in b.column("e")])
            for d in np.unique(lengths):
                some = b.filter(pa.array(lengths == d))
                c = codes(_unit(_matrix(some.column("e"))), k) * 131 + int(d) if d else None
                yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("copies"), some.column("e"), pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, n_codes, dtype=np.int32)), pa.array(c.ravel()))], ["rep", "copies", "e", "codes"])

    rows = reps.mapInArrow(coded, f"rep long, copies long, e {kind}, codes array<long>")
    placed = rows.select("rep", "copies", "e", F.explode(F.array_distinct("codes")).alias("bucket"))
    full = written(rows.select(F.explode(F.array_distinct("codes")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "vec-buckets")
    placed = placed.join(full, "bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    met = placed.withColumn("block", block).withColumn("other", other)
    met = met.select("rep", "copies", "e", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "rep")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            rep, copies = (t.column(c).to_numpy() for c in ("rep", "copies"))
            bucket, low, high, side = (t.column(c).to_numpy() for c in ("bucket", "low", "high", "side"))
            e = t.column("e").combine_chunks()
            e = e.chunk(0) if isinstance(e, pa.ChunkedArray) else e
            lengths = np.diff(e.offsets.to_numpy()) if len(e) else np.zeros(0, int)
            out = [[], [], [], []]
            for d in np.unique(lengths):
                m = np.flatnonzero(lengths == d)
                unit = _unit(_matrix(e.take(pa.array(m))))
                group = np.cumsum(np.concatenate([[0], (bucket[m][1:] != bucket[m][:-1]) | (low[m][1:] != low[m][:-1]) | (high[m][1:] != high[m][:-1])])) if len(m) else m
                own = codes(unit, k) * 131 + int(d)
                i, j = _pairs(unit, group, bucket[m], side[m], own, probes, least)
                if not len(i):
                    continue
                r, c = rep[m], copies[m]
                n = np.zeros(len(m), np.int64)
                np.add.at(n, i, c[j])
                np.add.at(n, j, c[i])
                has = np.flatnonzero(n)
                a, b = _forest(r[i], r[j])
                out[0] += [r[has], a]
                out[1] += [n[has], np.zeros(len(a), np.int64)]
                out[2] += [np.full(len(has), -1), b]
                out[3] += [np.zeros(len(has), bool), np.ones(len(a), bool)]
            columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.int64, bool), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "n", "b", "edge"])

        waiting: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if waiting is None else pa.concat_tables([waiting, now])
            if not len(now):
                continue
            key = [now.column(c).to_numpy() for c in ("bucket", "low", "high")]
            last = int(np.argmax((key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])))  # where the last group begins
            if last:
                yield result(now.slice(0, last))
            waiting = now.slice(last)
        if waiting is not None and len(waiting):
            yield result(waiting)

    found = written(met.mapInArrow(compared, "a long, n long, b long, edge boolean"), "vec-links")
    counts = found.where("NOT edge").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    component_of = connected_components(found.where("edge").select("a", "b"), "vec")
    per_rep = reps.join(counts, "rep", "left").join(component_of.withColumnRenamed("node", "rep"), "rep", "left")
    per_rep = per_rep.select(F.col("e").alias("rep_e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    usable = F.when(F.coalesce(sound, F.lit(False)), F.col("e"))
    out = v.withColumn("e", usable).join(per_rep, F.col("e") == F.col("rep_e"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL: dict[str, str] = {}
QUERIES = {"op6_embeddings": op6_embeddings}
