"""Token-ID output in Simple-8b words.

Documents are dealt by ranges of doc_id (texts under one id, or without one, by ranges of a hash of the text) and sorted within each,
so that the files, in order, hold the ids in ascending doc_id order. Each row of a file is a segment: the documents it holds, their numbers of ids, and a payload as simple8b.py
describes it. Segments end between documents at about SEGMENT ids. Spark writes the files, so any store it reaches will do.

Words between blanks are encoded once and remembered by hash (64 bits): a blank (ASCII space, line feed, tab) ends every piece of
this tokeniser's pattern, its normaliser works on either side alone, and no added token has one. So words are remembered for VOCABULARY
only; with another file every text is encoded whole.

Defined results: null text is the empty text, which has the end id only; documents of one doc_id stand in order of
their text's hash; a null doc_id stands first; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import col, mix64, ready, scratch_path, slices, table, trim
from .op02_tokens import tokenizer, vocabulary_path
from .words import power_tables

VOCABULARY = "word_bpe_49k.json"
END = 2
SEGMENT = 1 << 20
#: Bytes of text that a task is to encode, on average.
BYTES_A_PART = 64 << 20
#: Slots of the words that a worker remembers (16 B each), and the ids of them at which it starts anew (4 B each).
SLOTS, REMEMBERED = 1 << 21, 8_000_000
FILE = "part int, seg int, n_ids long, doc_ids array<long>, n_tokens array<int>, payload binary"
_words: dict[str, Words] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 10, 32]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class Words:
    """Ids of words, remembered by 64-bit hash in a direct-mapped cache: a later word of the same slot takes the place."""

    def __init__(self, path: str) -> None:
        self.tok = tokenizer(path)
        self.tag = np.zeros(SLOTS, np.uint64)
        self.first = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(SLOTS, np.int32)
        self.ids, self.used = np.zeros(REMEMBERED + (1 << 20), np.uint32), 0
        self.ends_word = np.zeros(max(self.tok.get_vocab(True).values()) + 1, bool)
        self.ends_word[[i for t, i in self.tok.get_vocab(True).items() if t.endswith("</w>")]] = True

    def _add(self, ids: np.ndarray) -> int:
        """Place of the ids in the buffer."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        at, self.used = self.used, self.used + len(ids)
        self.ids[at : self.used] = ids
        return at

    def _encode(self, words: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """first and size of each word's ids. plain: words of a to z alone, which are one piece each and so may be encoded together:
        the end of a piece shows in its last id."""
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for some, together in ((np.flatnonzero(plain), 64), (np.flatnonzero(~plain), 1)):
            for a in range(0, len(some), 1 << 15):
                k = some[a : a + (1 << 15)].tolist()
                lines = [" ".join([words[i] for i in k[j : j + together]]) for j in range(0, len(k), together)]
                got = [e.ids for e in self.tok.encode_batch_fast(lines, add_special_tokens=False)]
                ids = np.fromiter(itertools.chain.from_iterable(got), np.uint32)
                ends = np.flatnonzero(self.ends_word[ids]) + 1 if together > 1 else np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
                size[k] = np.diff(ends, prepend=0)
                first[k] = self._add(ids) + ends - size[k]
        return first, size

    def encode(self, texts: list, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the place after each text's (with its end id)."""
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b" " + b" ".join(data) + b" "
        b = np.frombuffer(joined, np.uint8)
        if b"<|" not in joined:  # an added token is matched as it is written
            b = _LOWER[b]
        blank = _BLANK[b]
        cut = np.flatnonzero((b == 46) | (b == 44))
        cut = cut[_ALNUM[b[cut - 1]] & blank[cut + 1]]  # a last full stop or comma is a piece of its own
        edge = blank[1:] != blank[:-1]
        start = np.sort(np.concatenate([np.flatnonzero(edge & blank[:-1]) + 1, cut]))
        stop = np.sort(np.concatenate([np.flatnonzero(edge & ~blank[:-1]) + 1, cut]))
        power, inverse = power_tables(len(b))
        sums = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])
        h = mix64((sums[stop - 1] - sums[start - 1]) * inverse[start] + (stop - start).astype(np.uint64)) | np.uint64(1)
        slot = ((h >> np.uint64(20)) & np.uint64(SLOTS - 1)).astype(np.int64)
        if self.used > REMEMBERED:
            self.tag[:], self.used = 0, 0
        hit = self.tag[slot] == h
        first, size = self.first[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[at]
            letters = np.concatenate([[0], np.cumsum((b >= 97) & (b <= 122))])
            plain = letters[stop[at]] - letters[start[at]] == stop[at] - start[at]
            lower = b.tobytes()
            words = [lower[i:j].decode("utf-8", "surrogatepass") for i, j in zip(start[at].tolist(), stop[at].tolist(), strict=True)]
            f, n = self._encode(words, plain)
            first[miss], size[miss] = f[back], n[back]
            where = slot[at]
            self.tag[where], self.first[where], self.size[where] = new, f, n
        last = np.cumsum(size)
        text_end = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
        upto = np.searchsorted(start, text_end, "right")
        ends = np.concatenate([[0], last])[upto]
        ids = self.ids[np.arange(int(last[-1]) if len(last) else 0) + np.repeat(first - (last - size), size)]
        out = np.empty(len(ids) + len(texts), np.uint32)
        place = ends + np.arange(len(texts))
        own = np.ones(len(out), bool)
        own[place] = False
        out[own], out[place] = ids, end
        return out, place + 1


def encode_whole(texts: list, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    got = [[*e.ids, end] for e in tokenizer(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    return np.fromiter(itertools.chain.from_iterable(got), np.uint32), np.cumsum([len(x) for x in got])


def encode_texts(texts: list, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    if not path.endswith(VOCABULARY):
        return encode_whole(texts, path, end)
    if path not in _words:
        _words[path] = Words(path)
    return _words[path].encode(texts, end)


def _segments(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    part, seg, ids, docs, counts, n = None, 0, [], [], [], 0

    def row() -> pa.RecordBatch:
        payload = simple8b.encode(np.concatenate(ids))
        columns = [[part], [seg], [n], [docs], [counts], [payload]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()), strict=True)], ["part", "seg", "n_ids", "doc_ids", "n_tokens", "payload"])

    for batch in batches:
        texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        if len(keys):
            part = batch.column("part")[0].as_py()
        for a, b in slices(texts, 600_000):
            got, ends = encode_texts(texts[a:b], path, end)
            at = 0
            while at < b - a:  # whole documents up to about SEGMENT ids
                base = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + SEGMENT - n, "right")))
                ids.append(got[base : int(ends[to - 1])])
                counts += np.diff(np.concatenate([[base], ends[at:to]])).tolist()
                docs += keys[a + at : a + to]
                n, at = n + len(ids[-1]), to
                if n >= SEGMENT - SEGMENT // 8:
                    yield row()
                    seg, ids, docs, counts, n = seg + 1, [], [], [], 0
        trim()
    if docs:
        yield row()


def write(docs: DataFrame, to: str, path: str | None = None, end: int = END, parts: int | None = None) -> None:
    """Writes the files of docs to the folder `to`, which any executor must be able to reach."""
    spark, path = ready(docs.sparkSession), path or vocabulary_path(VOCABULARY)
    rows = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), F.coalesce(col(docs, "text"), F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_A_PART))
    h = F.xxhash64("text")
    rows = rows.repartitionByRange(parts, F.col("doc_id"), h).sortWithinPartitions("doc_id", h, "text").withColumn("part", F.spark_partition_id())
    rows.mapInArrow(lambda batches: _segments(batches, path, end), FILE).write.parquet(to)


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the folder's files, decoded."""
    files = ready(spark).read.schema(FILE).parquet(at)
    total = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    by_part = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = total.select("part", by_part.alias("part_start"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("part", "seg", "n_ids").withColumn("inside", inside).join(total, "part").select("part", "seg", (F.col("part_start") + F.col("inside")).alias("seg_start"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = simple8b.decode(batch.column("payload")[i].as_py()).astype("<u4")
                n = np.array(batch.column("n_tokens")[i].as_py(), np.int64)
                ends = np.cumsum(n)
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_ids")[i].as_py(), pa.int64()), pa.array([batch.column("part")[i].as_py()] * k, pa.int32()), pa.array([batch.column("seg")[i].as_py()] * k, pa.int32()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "part", "seg", "at", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seg", "doc_ids", "n_tokens", "payload").mapInArrow(decoded, "doc_id long, part int, seg int, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seg"]).select("doc_id", (F.col("seg_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """write() into the shared folder, then read()."""
    to = scratch_path(docs.sparkSession, "ids")
    write(docs, to, path, end)
    return read(docs.sparkSession, to)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op8_token_ids": op8_token_ids}
