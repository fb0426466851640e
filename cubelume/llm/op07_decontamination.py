"""Benchmark decontamination by a BM25 index of the test items, searched with block-max WAND.

Every training passage is a query: documents are cut in windows of 2 L words every L words, L the words of the longest
item of an index (there is one for each doubling of the items' length), so that an item that stands in a document lies in one window whole.
Impacts are BM25 weights divided by the item's score for its own text, so that a score is the share of an item's weight that the passage
has. All items of a score >= SCORE are retrieved. A retrieved item counts as a leak if a stretch of the passage of at most twice the
item's length has, in order, at least OVERLAP of the words of its question and of its answer. An item's answer is its last sentence, if it has several, else the last
quarter of its words.

Bounds are checked at two depths: first, for whole batches of windows in numpy, the sum of block maxima over blocks of items, below
which no item of the block can reach SCORE; then, for the windows left, WAND's pivots and the maxima of blocks of postings.

Frequencies are counted by Spark over all items. The index is broadcast in slices of about SLICE_WORDS words of items; more items take more
passes over the documents, with the same scores.

Defined results: null, empty and wordless texts have no leaks, items without words match nothing; equal rows give equal rows;
very long texts are cut in windows like others; items of one text are all found; empty tables on either side give no rows (and no document is
leaked); a document without doc_id has its leaks under null; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, ready, slices, table, trim, written
from .words import word_hashes

SCORE, OVERLAP = 0.7, 0.8
K1, B = 1.2, 0.75
BLOCKS, POSTINGS = 64, 8
SLICE_WORDS = 4_000_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def parts(text: str) -> tuple[str, str]:
    """Question and answer."""
    sentences = [s for s in _SENTENCE.split(text) if re.search(r"\w", s)]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    n = max(1, len(words) // 4)
    return " ".join(words[:-n]), " ".join(words[-n:])


def in_order(item: list[int], passage: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in passage:
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def local_shares(question: list[int], answer: list[int], passage: list[int]) -> list[tuple[float, float]]:
    """Shares of the question's and the answer's words that stand in order in windows of twice the item's length, every half of it."""
    m, out = len(question) + len(answer), []
    for a in range(0, max(len(passage) - m, 1), -(-m // 2)):
        window = passage[a : a + 2 * m]
        out.append(tuple(in_order(x, window) / len(x) if x else 1.0 for x in (question, answer)))
    return out


@dataclass
class Item:
    """Words of an item by hash, and the number of items that have each of its distinct words."""

    item_id: int
    question: list[int]
    answer: list[int]
    common: dict[int, int]

    @property
    def length(self) -> int:
        return len(self.question) + len(self.answer)


@dataclass
class Index:
    """An index of items of like length."""

    ids: list[int]
    question: list[list[int]]
    answer: list[list[int]]
    longest: int
    slots: np.ndarray  # hash table: word number + 1 by the lowest bits of its hash
    vocabulary: np.ndarray
    bounds: np.ndarray  # words x blocks of items
    postings: list[tuple[list[int], list[float], list[float], float]]  # items, impacts, maxima of blocks, maximum

    @staticmethod
    def of(items: list[tuple[int, str | None]]) -> list[Index]:
        """Indexes of a few items, all in one place; none if no item has a word."""
        found = [Item(i, *split_words(t), {}) for i, t in items]
        found = [x for x in found if x.length]
        common: dict[int, int] = {}
        for x in found:
            for w in {*x.question, *x.answer}:
                common[w] = common.get(w, 0) + 1
        for x in found:
            x.common = {w: common[w] for w in {*x.question, *x.answer}}
        return by_length(found, len(found), sum(x.length for x in found) / max(len(found), 1))

    @staticmethod
    def build(items: list[Item], n: int, mean: float) -> Index:
        """n, mean: number and mean length of all items, of which these may be a slice."""
        common = {w: c for x in items for w, c in x.common.items()}
        hashes = [(x.item_id, x.question, x.answer) for x in items]
        # items of like vocabulary stand together, so that maxima of blocks are tight
        hashes.sort(key=lambda x: (sorted(({*x[1], *x[2]}), key=lambda w: (-common[w], w))[:3], x[0]))
        lengths = [len(q) + len(a) for _, q, a in hashes]
        found: dict[int, list[tuple[int, float]]] = {}
        for k, (_, q, a) in enumerate(hashes):
            tf: dict[int, int] = {}
            for w in [*q, *a]:
                tf[w] = tf.get(w, 0) + 1
            weights = {w: np.log(1 + (n - common[w] + 0.5) / (common[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * lengths[k] / mean)) for w, f in tf.items()}
            own = sum(weights.values())
            for w, x in weights.items():
                found.setdefault(w, []).append((k, float(x / own)))
        vocabulary = np.array(sorted(found), np.uint64)
        size = -(-len(hashes) // BLOCKS)
        bounds = np.zeros((len(vocabulary), -(-len(hashes) // size)), np.float32)
        postings = []
        for v, w in enumerate(vocabulary.tolist()):
            at, impact = [k for k, _ in found[w]], [x for _, x in found[w]]
            np.maximum.at(bounds[v], np.array(at) // size, np.array(impact, np.float32))
            postings.append((at, impact, [max(impact[j : j + POSTINGS]) for j in range(0, len(at), POSTINGS)], max(impact)))
        bits = max(16, int(len(vocabulary) * 16).bit_length())
        slots = np.zeros(1 << bits, np.int32)
        order = (vocabulary & np.uint64((1 << bits) - 1)).astype(np.int64)
        rest = []
        for v, s in enumerate(order.tolist()):
            if slots[s]:
                rest.append(v)
            else:
                slots[s] = v + 1
        index = Index([i for i, _, _ in hashes], [q for _, q, _ in hashes], [a for _, _, a in hashes], max(lengths), slots, vocabulary, bounds, postings)
        index.rest = np.array(rest, np.int64)  # words whose slot another has
        return index

    rest: np.ndarray = None

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The word's number in the vocabulary, or -1."""
        v = self.slots[(h & np.uint64(len(self.slots) - 1)).astype(np.int64)].astype(np.int64) - 1
        hit = np.flatnonzero(v >= 0)
        wrong = hit[self.vocabulary[v[hit]] != h[hit]]
        v[wrong] = -1
        if len(self.rest) and len(wrong):
            others = self.vocabulary[self.rest]
            at = np.minimum(np.searchsorted(others, h[wrong]), len(others) - 1)
            same = others[at] == h[wrong]
            v[wrong[same]] = self.rest[at[same]]
        return v

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items (by place) of at least that score for a query of distinct terms, with their scores."""
        least -= 1e-9
        cursors = [[self.postings[t][0][0], 0, self.postings[t]] for t in terms]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for k, c in enumerate(cursors):
                total += c[2][3]
                if total >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            ahead, bound, until = cursors[: pivot + 1], 0.0, None
            for c in ahead:
                at, _, maxima, _ = c[2]
                block = bisect_left(at, item, c[1]) // POSTINGS
                if block < len(maxima):
                    bound += maxima[block]
                    last = at[min(len(at), (block + 1) * POSTINGS) - 1]
                    until = last if until is None else min(until, last)
            if bound >= least:
                if ahead[0][0] == item:
                    score = sum(c[2][1][c[1]] for c in ahead)
                    if score >= least:
                        out.append((item, score))
                    to = item + 1
                else:
                    to = item
            else:  # nothing up to the end of the nearest block, nor before the next cursor, can reach it
                to = item + 1 if until is None else until + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, item + 1)
            for c in ahead:
                if c[0] < to:
                    c[1] = bisect_left(c[2][0], to, c[1])
                    c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else None
            cursors = [c for c in cursors if c[0] is not None]
        return out

    def leaks(self, h: np.ndarray, counts: np.ndarray, least: float, overlap: float, best: dict[tuple[int, int], tuple], lo: int = 0) -> None:
        """Puts (score, shares of question and answer) of each pair (text's place + lo, item_id) that is a leak into best, of its best
        passage. h, counts: hashes of the words of texts, and their numbers."""
        if not len(h):
            return
        length = self.longest
        cells = -(-counts // length)  # cells of L words; window c is the cells c and c + 1 of one text
        first_cell, ends = np.cumsum(cells) - cells, np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(h)) - (ends - counts)[owner]
        number = self.numbers(h)
        known = np.flatnonzero(number >= 0)
        cell = first_cell[owner[known]] + place[known] // length
        second = place[known] >= length
        v = len(self.vocabulary)
        pairs = np.unique(np.concatenate([cell * v + number[known], (cell[second] - 1) * v + number[known][second]]))
        if not len(pairs):
            return
        window, term = pairs // v, pairs % v
        start = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        bound = np.empty((len(start), self.bounds.shape[1]), np.float32)
        step = 20_000
        for a in range(0, len(start), step):  # a few MB at a time
            s = start[a : a + step]
            e = start[a + step] if a + step < len(start) else len(pairs)
            bound[a : a + step] = np.add.reduceat(self.bounds[term[s[0] : e]], s - s[0], axis=0)
        stop = np.concatenate([start[1:], [len(pairs)]])
        for k in np.flatnonzero(bound.max(1) >= least - 1e-4).tolist():
            w = int(window[start[k]])
            found = self.search(term[start[k] : stop[k]].tolist(), least)
            if not found:
                continue
            d = int(np.searchsorted(first_cell, w, "right")) - 1
            base = int(ends[d] - counts[d])
            a = base + (w - int(first_cell[d])) * length
            passage = h[a : min(a + 2 * length, base + int(counts[d]))].tolist()
            for item, score in found:
                for qs, an in local_shares(self.question[item], self.answer[item], passage):
                    if qs >= overlap and an >= overlap:
                        key, value = (lo + d, self.ids[item]), (score, qs, an)
                        if key not in best or value > best[key]:
                            best[key] = value


def by_length(items: list[Item], n: int, mean: float) -> list[Index]:
    """One index for items of up to 32 words, and one for each doubling beyond, as windows are cut by an index's longest item."""
    some: dict[int, list[Item]] = {}
    for x in items:
        some.setdefault(max(5, (x.length - 1).bit_length()), []).append(x)
    return [Index.build(some[k], n, mean) for k in sorted(some)]


def leaks_of(indexes: list[Index], texts: list, least: float = SCORE, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
    """(text's place, item_id, score, shares of question and answer), one for each pair, of its best passage."""
    best: dict[tuple[int, int], tuple] = {}
    for lo, hi in slices(texts, 500_000):
        h, counts = word_hashes(texts[lo:hi])
        for index in indexes:
            index.leaks(h, counts, least, overlap, best, lo)
    trim()
    return [(*k, *x) for k, x in sorted(best.items())]


def split_words(text: str | None) -> tuple[list[int], list[int]]:
    """Hashes of the words of question and answer."""
    h, n = word_hashes([*parts(text or "")])
    return h[: n[0]].tolist(), h[n[0] :].tolist()


def _signed(words: list[int]) -> np.ndarray:
    return np.array(words, np.uint64).astype(np.int64)


def _unsigned(words) -> list[int]:
    return np.array([*words], np.int64).astype(np.uint64).tolist()


def index_slices(items: DataFrame, words: int | None = None) -> Iterator[list[Index]]:
    """Indexes over slices of the items, each of a bounded number of words. Document frequencies, the number of items and their mean length
    are counted by Spark over all items, so that scores don't depend on slices."""
    ready(items.sparkSession)
    rows = items.select(col(items, "item_id").cast("long").alias("item_id"), col(items, "text").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [split_words(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), *(pa.array([_signed(x[k]) for x in both], pa.list_(pa.int64())) for k in (0, 1))], ["item_id", "q", "a"])

    said = rows.mapInArrow(hashed, "item_id long, q array<long>, a array<long>").withColumn("n", F.size("q") + F.size("a")).where("n > 0")
    said = written(said.withColumn("row", F.monotonically_increasing_id()), "bm25-items")
    n, mean = said.agg(F.count("*"), F.avg("n")).first()
    if not n:
        return
    distinct = said.select("row", F.explode(F.array_distinct(F.concat("q", "a"))).alias("word"))
    common = distinct.groupBy("word").agg(F.count("*").alias("c"))
    counts = distinct.join(common, "word").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "c"))).alias("common"))
    known = written(said.join(counts, "row").select("row", "item_id", "q", "a", "n", "common"), "bm25-counts")
    some, size = [], 0
    for r in known.orderBy("item_id", "row").toLocalIterator():
        some.append(Item(r.item_id, _unsigned(r.q), _unsigned(r.a), dict(zip(_unsigned(r.common), r.common.values(), strict=True))))
        size += r.n
        if size >= (words or SLICE_WORDS):
            yield by_length(some, n, mean)
            some, size = [], 0
    if some:
        yield by_length(some, n, mean)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question, answer: every leak."""
    spark = ready(docs.sparkSession)
    schema = "doc_id long, item_id long, score double, question double, answer double"
    rows = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), col(docs, "text").alias("text"))
    out = spark.createDataFrame([], schema)
    for some in index_slices(items):
        shared = spark.sparkContext.broadcast(some)

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = leaks_of(shared.value, b.column("text").to_pylist())
                ids = b.column("doc_id").to_pylist()
                columns = [[ids[x[0]] for x in got], *[[x[j] for x in got] for j in range(1, 5)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "score", "question", "answer"])

        out = out.unionByName(rows.mapInArrow(found, schema))
    return out


def _leaked(shared):
    @F.pandas_udf("boolean")
    def leaked(s: pd.Series) -> pd.Series:
        hit = {x[0] for x in leaks_of(shared.value, s.tolist())}
        return pd.Series([i in hit for i in range(len(s))], dtype="bool")

    return leaked


def is_leaked(text: Column, items: DataFrame) -> Column:
    """Whether a text holds any item."""
    spark = ready(items.sparkSession)
    out = F.lit(False)
    for some in index_slices(items):
        out = out | _leaked(spark.sparkContext.broadcast(some))(text)
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL: dict[str, str] = {}
QUERIES = {"op7_decontamination": op7_decontamination}
