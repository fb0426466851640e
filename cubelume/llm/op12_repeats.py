"""Removal of repeated substrings by suffix arrays that are sorted in two stages.

A string of WINDOW bytes that starts at two places at all must be found, wherever the places lie. Each window has a key that its bytes alone decide:
the least hash of the GRAM-byte strings in it. So equal windows have one key, and consecutive windows mostly share theirs: a text falls into segments, runs of windows of
one key, some 90 windows long. Keys that occur once in all texts are no one's repeat; only segments of the other keys are looked at again. Segments of
one key, and so all windows that could be equal, meet in a task; equal segments are counted first and meet as one.

There the segments' bytes become a suffix array: only suffixes smaller than their successors are sorted directly, the others follow by one scan over the buckets of
first bytes, in which each suffix puts its larger predecessor at the next place of its bucket. Then the common prefixes of neighbours are computed, word by word,
up to WINDOW bytes. Windows whose neighbour shares all of them are repeated. A key with more than GROUP different segments, as at the
edges of a passage that very many documents hold, isn't left to a task: its windows are dealt by their own digests, so that equal ones meet anywhere.

Texts are compared once each: copies of a whole text are counted first.

Defined results: null text is the empty text; texts shorter than a window keep all; repeated rows are copies; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, mix64, ready, slices, table, trim, written

WINDOW, GRAM = 200, 32
#: Windows of a segment at most (a longer run of one key is cut, which loses nothing).
SEGMENT = 256
#: Bytes of texts, and of segments in a suffix array, that are worked on at once.
CHUNK, ARRAY = 1 << 19, 1 << 20
#: Different segments of a key that one task compares.
GROUP = 2048
GROUPS_BROADCAST = 10_000
BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up, down = (np.multiply.accumulate(np.concatenate([one, np.full(n, x, np.uint64)])) for x in (BASE, pow(BASE, -1, 1 << 64)))
    return up, down


def _rolling(b: np.ndarray, k: int, most: int) -> np.ndarray:
    """Polynomial hashes of all strings of k bytes of b (at most `most` bytes long)."""
    up, down = _powers(most)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return (sums[k:] - sums[:-k]) * down[: len(b) - k + 1]


def _sliding(x: np.ndarray, w: int, best: np.ufunc, worst: int) -> np.ndarray:
    """best over each w consecutive values."""
    rows = np.concatenate([x, np.full(-len(x) % w, worst, x.dtype)]).reshape(-1, w)
    ahead, back = best.accumulate(rows, 1).ravel(), best.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return best(back[: len(x) - w + 1], ahead[w - 1 : len(x)])


def segments(b: np.ndarray, ends: np.ndarray, most: int, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts side by side in b, ending at `ends` -> first windows of segments, their lengths, their keys, and places of keys that stand twice in a segment."""
    w, n = window - gram + 1, len(b) - window + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none.view(np.uint64), none
    starts = np.concatenate([[0], ends[:-1]])
    open_ = np.zeros(n + 1, np.int32)  # windows within a text
    long = ends - starts >= window
    np.add.at(open_, starts[long], 1)
    np.add.at(open_, ends[long] - window + 1, -1)
    valid = np.cumsum(open_[:n]) > 0
    h = mix64(_rolling(b, gram, most))
    key = _sliding(h, w, np.minimum, np.iinfo(np.uint64).max)
    first = valid.copy()
    first[1:] &= (key[1:] != key[:-1]) | ~valid[:-1]
    first[starts[long]] = True
    at = np.flatnonzero(first)
    if not len(at):
        return none, none, none.view(np.uint64), none
    stop = np.flatnonzero(valid & np.concatenate([first[1:] | ~valid[1:], [True]])) + 1
    sizes = stop - at
    parts = -(-sizes // SEGMENT)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(at, parts) + number * SEGMENT
    length = np.minimum(np.repeat(stop, parts) - begin, SEGMENT)
    highest = np.concatenate([np.zeros(w - 1, np.uint64), np.where(valid, key, np.uint64(0)), np.zeros(w - 1, np.uint64)])
    least = np.flatnonzero(h == _sliding(highest, w, np.maximum, 0))  # places that are least in some window
    twice = least[1:][(h[least[1:]] == h[least[:-1]]) & (np.diff(least) <= w)]
    return begin, length, key[begin], h[twice]


def _texts(batch: pa.RecordBatch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Bytes of some texts, where each ends, and (row, offset in the row's text) of each; long texts come in parts that overlap by all but one byte of a window."""
    column = batch.column("text")
    offsets, data = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1], np.frombuffer(column.buffers()[2] or b"", np.uint8)
    waiting: list[tuple[int, int, int, int]] = []
    size = 0

    def side_by_side() -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        return np.concatenate([data[x:y] for _, _, x, y in waiting]), np.cumsum([y - x for _, _, x, y in waiting]), [(i, at) for i, at, _, _ in waiting]

    for i in range(len(column)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        for at in range(0, max(1, b - a - WINDOW + 1), most - WINDOW):
            part = (i, at, a + at, min(b, a + at + most - 1))
            if waiting and size + part[3] - part[2] > most:
                yield side_by_side()
                waiting, size = [], 0
            waiting.append(part)
            size += part[3] - part[2]
    if waiting:
        yield side_by_side()


def _segmented(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Texts (key, text) -> key, spans (first window * 512 + length), keys of segments, and keys that stand twice."""
    for batch in batches:
        out: list[list] = [[[] for _ in range(batch.num_rows)] for _ in range(3)]
        for b, ends, rows in _texts(batch, most):
            begin, length, key, twice = segments(b, ends, most)
            cuts = np.searchsorted(begin, ends)
            starts = np.concatenate([[0], ends[:-1]])
            for (i, at), s, x, y in zip(rows, starts, np.concatenate([[0], cuts[:-1]]), cuts, strict=True):
                if y > x:
                    out[0][i].append((begin[x:y] - s + at) * 512 + length[x:y])
                    out[1][i].append(key[x:y].view(np.int64))
            if len(twice):
                out[2][rows[0][0]].append(twice.view(np.int64))
        lists = []
        for column in out:
            sizes = [sum(map(len, c)) for c in column]
            flat = [x for c in column for x in c]
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))))
        yield pa.RecordBatch.from_arrays([batch.column("key"), *lists], ["key", "spans", "keys", "twice"])
        trim()


def two_stage(s: np.ndarray, wanted: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Wanted suffixes of s in the order of their first `depth` bytes (beyond its end s goes on with zeros).

    Only those smaller than their successors are sorted by their bytes; each other one is put in its bucket when the scan meets its successor."""
    n = len(s)
    t = np.concatenate([s, np.zeros(depth + 16, np.uint8)])
    place = np.arange(n)
    differs = np.flatnonzero(t[:n] != t[1 : n + 1])
    ahead = np.searchsorted(differs, place)
    ahead_at = np.concatenate([differs, [n]])[ahead]
    rises = np.concatenate([t[:n] < t[1 : n + 1], [True]])[ahead_at]  # suffix i is smaller than suffix i + 1
    rises = np.concatenate([rises, [True]])
    up = np.flatnonzero(rises)
    chosen = np.zeros(n + 1, bool)
    chosen[wanted] = True
    last = up[np.searchsorted(up, wanted)]  # an unsorted suffix needs its successors up to the first that is sorted
    steps = np.zeros(n + 2, np.int32)
    np.add.at(steps, wanted, 1)
    np.add.at(steps, last + 1, -1)
    chosen |= np.cumsum(steps[: n + 1]) > 0
    words = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        words |= t[k : k + len(words)].astype(np.uint64) << np.uint64(56 - 8 * k)
    whole = _rolling(t, depth, 1 << max(16, int(len(t)).bit_length()))
    direct = _by_bytes(np.flatnonzero(chosen & rises), words, whole, depth)
    first = np.append(t[:n], 0)
    edges = np.searchsorted(first[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    falls = chosen & ~rises
    order = []
    for c in range(256):
        front = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        bucket = [front]
        while len(front):  # predecessors with the same byte stand behind, in the same order
            front = front[front > 0] - 1
            front = front[falls[front] & (first[front] == c)]
            bucket.append(front)
        bucket.append(direct[edges[c] : edges[c + 1]])
        whole_bucket = np.concatenate(bucket)
        order.append(whole_bucket)
        before = whole_bucket[whole_bucket > 0] - 1
        before = before[falls[before] & (first[before] > c)]
        if len(before):
            by = np.argsort(first[before], kind="stable")
            before = before[by]
            to = first[before]
            cuts = np.flatnonzero(np.diff(to)) + 1
            for x in np.split(before, cuts):
                induced[first[x[0]]].append(x)
    order = np.concatenate(order)
    keep = np.zeros(n + 1, bool)
    keep[wanted] = True
    return order[keep[order]]


def _by_bytes(p: np.ndarray, words: np.ndarray, whole: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by their first `depth` bytes, eight at a time; ties whose whole windows have one hash stay as they are."""
    p = p[np.argsort(words[p], kind="stable")]
    at = np.arange(len(p))  # places in p that aren't decided yet, ties side by side
    group = np.cumsum(np.concatenate([[0], words[p[1:]] != words[p[:-1]]])) if len(p) else at
    for k in range(8, depth + 8, 8):
        if not len(at):
            break
        same = np.concatenate([[True], group[1:] == group[:-1]])
        same[0] = False
        begin = np.flatnonzero(~same)
        size = np.diff(np.append(begin, len(at)))
        h = whole[p[at]]
        alike = np.minimum.reduceat(h, begin) == np.maximum.reduceat(h, begin)
        open_ = np.repeat((size > 1) & ~alike, size)
        at, group = at[open_], group[open_]
        if not len(at) or k >= depth:
            break
        by = np.lexsort((words[p[at] + k], group))
        p[at] = p[at[by]]
        w = words[p[at] + k]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (w[1:] != w[:-1])])) if len(at) else group
    return p


def common_prefixes(s: np.ndarray, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Whole words of eight bytes, in bytes up to depth, that each suffix of the order shares with the one before it (the first: 0)."""
    t = np.concatenate([s, np.zeros(depth + 16, np.uint8)])
    words = np.zeros(len(s) + depth + 8, np.uint64)
    for k in range(8):
        words |= t[k : k + len(words)].astype(np.uint64) << np.uint64(56 - 8 * k)
    out, at = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for k in range(0, depth, 8):
        at = at[words[order[at] + k] == words[order[at - 1] + k]]
        out[at] = k + 8
    return out


def repeated(contexts: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each of some byte strings which of its windows start anywhere else in them, too."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    s = np.frombuffer(b"\0".join(contexts), np.uint8)
    counts = np.maximum(sizes - window + 1, 0)
    wanted = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    order = two_stage(s, wanted, window)
    equal = common_prefixes(s, order, window) >= window
    found = np.zeros(len(s) + 1, bool)
    found[order[equal]] = True
    found[order[np.flatnonzero(equal) - 1]] = True
    return [found[a : a + c] for a, c in zip(starts, counts, strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _compared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Segments by key (h, d, ctx, n), all of a key in this task and side by side -> d, first, stop (of repeated windows)."""

    def result(rows: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
        out: list[tuple[bytes, int, int]] = []
        for (d, ctx, n), flags in zip(rows, repeated([c for _, c, _ in rows]), strict=True):
            out += [(d, 0, len(ctx) - WINDOW + 1)] if n > 1 else [(d, a, b) for a, b in runs(flags)]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int32()))], ["d", "first", "stop"])

    waiting: list[tuple] = []
    size, key = 0, None
    for batch in batches:
        for h, d, ctx, n in zip(*(batch.column(c).to_pylist() for c in ("h", "d", "ctx", "n")), strict=True):
            if h != key and size > most:
                yield result(waiting)
                trim()
                waiting, size = [], 0
            key = h
            waiting.append((d, ctx, n))
            size += len(ctx) + 1
    if waiting:
        yield result(waiting)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their segments of repeated keys -> tid, first (window), h, ctx (the segment's bytes), n (2 for a text with copies)."""
    last = None
    names, types = ["tid", "first", "h", "ctx", "n"], [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        size = 0
        for tid, text, copies, found in zip(*(batch.column(c) for c in ("tid", "text", "copies", "found")), strict=True):
            if (tid := tid.as_py()) == last:  # copies of a text
                continue
            last, text, n = tid, text.as_buffer(), 2 if copies.as_py() > 1 else 1
            text = memoryview(text)
            hashes, spans = (found.values.field(k).to_numpy() for k in ("h", "span"))
            for h, span in zip(hashes.tolist(), spans.tolist(), strict=True):
                first, length = span >> 9, span & 511
                ctx = bytes(text[first : first + length + WINDOW - 1])
                for have, x in zip(out, (tid, first, h, ctx, n), strict=True):
                    have.append(x)
                size += len(ctx)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
                out, size = [[], [], [], [], []], 0
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)


def repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (text) -> documents with their text's digest `text_key`, and text_key, removed (array of first and stop of repeated windows)
    of the texts that have any."""
    spark, chunk, array, group = ready(documents.sparkSession), CHUNK, ARRAY, GROUP
    text = F.coalesce(col(documents, "text").cast("string"), F.lit(""))
    keyed = documents.withColumn("text_key", F.substring(F.unhex(F.sha2(text, 256)), 1, 16)).withColumn("text_bytes", text.cast("binary"))
    long = keyed.where(F.octet_length("text_bytes") >= WINDOW).select(F.col("text_key").alias("key"), F.col("text_bytes").alias("text"))
    cut = long.mapInArrow(lambda batches: _segmented(batches, chunk), "key binary, spans array<long>, keys array<long>, twice array<long>")
    texts = cut.groupBy("key").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("spans", "keys", "twice")))
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()), "repeats-texts")
    often = texts.select(F.explode(F.concat("keys", "twice")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    each = texts.select("tid", F.explode(F.arrays_zip(F.col("keys").alias("h"), F.col("spans").alias("span"))).alias("x")).select("tid", "x.h", "x.span")
    found = each.join(often, "h").groupBy("tid").agg(F.collect_list(F.struct("h", "span")).alias("found")).join(texts.select("tid", "key", "copies"), "tid")
    cut_out = long.join(found, "key").select("tid", "text", "copies", "found").mapInArrow(_cut_out, "tid long, first int, h long, ctx binary, n long")
    contexts = written(cut_out.withColumn("d", F.substring(F.unhex(F.sha2("ctx", 256)), 1, 16)), "repeats-segments")
    different = written(contexts.groupBy("h", "d", "ctx").agg(F.sum("n").alias("n")), "repeats-different")
    hot = written(different.groupBy("h").agg(F.count("*").alias("in_all")).where(F.col("in_all") > group).select("h"), "repeats-hot")
    side = F.broadcast(hot) if hot.count() <= GROUPS_BROADCAST else hot
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = different.join(side, "h", "left_anti").repartition(parts, "h").sortWithinPartitions("h")
    places = met.mapInArrow(lambda batches: _compared(batches, array), "d binary, first int, stop int")
    windows = different.join(side, "h").select("d", "n", "ctx", F.explode(F.sequence(F.lit(0), F.octet_length("ctx") - WINDOW)).alias("first"))
    windows = windows.select("d", "n", "first", F.unhex(F.sha2(F.substring("ctx", F.col("first") + 1, F.lit(WINDOW)), 256)).alias("w"))
    more = windows.groupBy("w").agg(F.sum("n").alias("times")).where("times > 1").select("w")
    places = places.unionByName(windows.join(more, "w").select("d", "first", (F.col("first") + 1).alias("stop")))
    back = contexts.select("tid", F.col("first").alias("at"), "d").join(places, "d").select("tid", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("stop")).alias("stop"))
    removed = back.groupBy("tid").agg(F.collect_list(F.struct("first", "stop")).alias("removed"))
    everything = F.when(F.col("copies") > 1, F.array(F.struct(F.lit(0).alias("first"), F.lit((1 << 31) - 1).alias("stop")))).otherwise(F.col("removed"))
    marked = texts.select("tid", "key", "copies").join(removed, "tid", "left").select(F.col("key").alias("text_key"), everything.alias("removed")).where("removed IS NOT NULL")
    return keyed, marked


def kept(text: memoryview, first: np.ndarray, stop: np.ndarray, window: int = WINDOW) -> tuple[int, int, list[memoryview]]:
    """Bytes covered by windows that start in [first, stop), their maximal runs, and the parts that stay."""
    order = np.argsort(first, kind="stable")
    a, b = first[order].astype(np.int64), np.minimum(stop[order].astype(np.int64) - 1 + window, len(text))
    if not len(a):
        return 0, 0, [text]
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    begin, end = a[new], np.append(reach[:-1][new[1:]], reach[-1])
    edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
    return int((end - begin).sum()), len(begin), [text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]


def without_repeats(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (bytes: a cut may fall within a character)."""
    keyed, marked = repeats(documents)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column("text_bytes"), batch.column("removed")
            sizes = texts.to_pylist() if not batch.num_rows else [len(memoryview(t.as_buffer())) for t in texts]
            for x, y in slices([range(s) for s in sizes], 4 << 20):
                out: list[list] = [[], [], [], [], []]
                for i in range(x, y):
                    text, places = memoryview(texts[i].as_buffer()), removed[i]
                    first, stop = (places.values.field(k).to_numpy() for k in ("first", "stop")) if places.is_valid else (np.zeros(0, int),) * 2
                    n, spans, parts = kept(text, first, stop)
                    rest = b"".join(parts)
                    for have, v in zip(out, (len(text), n, spans, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                        have.append(v)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(x, y - x), *(pa.array(v, t) for v, t in zip(out, types[1:], strict=True))], names)

    docs = keyed.select(col(keyed, "doc_id").cast("long").alias("doc_id"), "text_bytes", "text_key")
    return docs.join(marked, "text_key", "left").select("doc_id", "text_bytes", "removed").mapInArrow(cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


SQL: dict[str, str] = {}
QUERIES = {"op12_repeats": op12_repeats}
