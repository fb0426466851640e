"""Language identification with string kernels.

Kernel: blended spectrum of n-gram presence. Two texts' kernel is the weighted number of distinct character n-grams
(n = 1 to 3, hashed) that both have, divided by the geometric mean of their own. Landmarks of the training sample give Nyström
features, one-versus-rest ridge regression on these is fitted on +1 / -1 targets. As the kernel is linear in the presence
vector, landmarks and weights multiply out to one matrix (n-grams x languages); a batch's presence vectors times it are its scores.

Training reads a bounded sample: the first FIT_PER_LANGUAGE texts of each language in order of a hash of the id, and
FIT_ROWS in all. Whole texts count, in training as in prediction. Landmarks are drawn from the languages in turn.

Defined results: text that is null or has no letter is `und` with score 0; so is every text if nothing can be learned;
repeated rows get equal predictions; equal scores go to the language that is first in order; a row without doc_id isn't held out;
very long texts are read in pieces; further columns are kept by with_language(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, first_by_hash, fresh, id_crc, ready, table, trim, written

FIT_PER_LANGUAGE = 600
FIT_ROWS = 20_000
LANDMARKS = 200
RIDGE = 1e-3
UNKNOWN = "und"
#: Hash bits and kernel weight of the n-grams, n = 1, 2, 3.
ORDERS = ((10, 1.0), (13, 1.0), (15, 1.0))
WIDTH = sum(1 << b for b, _ in ORDERS)
_WEIGHT = np.concatenate([np.full(1 << b, w) for b, w in ORDERS])
_ROOT = np.sqrt(_WEIGHT)
#: Texts whose presence vectors are multiplied at once (20 MB), and the grain of the weights.
TEXTS_A_PRODUCT, STEP = 64, 2.0**-30
_PIECE = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None, flags: np.ndarray) -> np.ndarray:
    """Numbers of the n-grams that the text has, ascending; none if it has no letter. flags: WIDTH zeros, left as zeros."""
    letter, any_letter, text = _is_letter(), False, f" {(text or '').lower()} "
    for a in range(0, len(text), _PIECE):
        c = np.frombuffer(text[max(0, a - 2) : a + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[c]
        any_letter = any_letter or bool(is_letter.any())
        c = np.where(is_letter, c, np.uint32(0))
        h, base = c * np.uint32(0x9E3779B1), 0
        for n, (bits, _) in enumerate(ORDERS):
            if n:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n:] * np.uint32(0x9E3779B1)
            flags[base + ((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)).astype(np.int64)] = True
            base += 1 << bits
    found = np.flatnonzero(flags)
    flags[found] = False
    return found if any_letter else found[:0]


def presence(found: list[np.ndarray], dtype=np.float64) -> np.ndarray:
    """Texts x WIDTH, 1 where a text has the n-gram."""
    x = np.zeros((len(found), WIDTH), dtype)
    for k, g in enumerate(found):
        x[k, g] = 1
    return x


def normed(found: list[np.ndarray]) -> np.ndarray:
    """Feature vectors of length 1, whose products are the kernel."""
    x = presence(found) * _ROOT
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Model:
    """Weights are whole multiples of STEP, so that sums of them are exact in whatever order and batch they are taken."""

    languages: list[str]
    matrix: np.ndarray  # WIDTH x languages

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        flags = np.zeros(WIDTH, bool)
        for a in range(0, len(texts), TEXTS_A_PRODUCT):
            found = {i: g for i in range(a, min(a + TEXTS_A_PRODUCT, len(texts))) if len(g := grams(texts[i], flags))}
            if not found or not self.languages:
                continue
            norm = np.array([np.sqrt(_WEIGHT[g].sum()) for g in found.values()])
            margin = presence(list(found.values())) @ self.matrix / norm[:, None]
            best = margin.argmax(1)
            share = 1.0 / np.exp(8.0 * (margin - margin.max(1, keepdims=True))).sum(1)
            for i, k, s in zip(found, best.tolist(), share.tolist(), strict=True):
                labels[i], scores[i] = self.languages[k], s
        return labels, scores


@dataclass
class Nystroem:
    """Features of texts by their kernels with the landmarks."""

    landmarks: np.ndarray
    half: np.ndarray

    @staticmethod
    def of(found: list[np.ndarray]) -> Nystroem:
        z = normed(found)
        values, vectors = np.linalg.eigh(z @ z.T)
        keep = values > 1e-6
        return Nystroem(z, vectors[:, keep] / np.sqrt(values[keep]))

    def features(self, found: list[np.ndarray]) -> np.ndarray:
        """Rounded to multiples of 2^-18, so that sums of products over up to 100,000 texts are exact in any order."""
        return np.round(normed(found) @ self.landmarks.T @ self.half * (1 << 18)) / (1 << 18)


def sums_of(features: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """All that ridge regression needs of some texts: products of the features with each other and with the targets."""
    return features.T @ np.hstack([features, targets])


def solve(space: Nystroem, languages: list[str], sums: np.ndarray, n: int, ridge: float = RIDGE) -> Model:
    k = sums.shape[0]
    weight = np.linalg.solve(sums[:, :k] + ridge * n * np.eye(k), sums[:, k:])
    matrix = (space.landmarks * _ROOT).T @ (space.half @ weight)
    return Model(languages, np.round(matrix / STEP) * STEP)


def _targets(langs: list[str], languages: list[str]) -> np.ndarray:
    return np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """rows: language and n-grams of each training text. The whole fit in one place, as train() does it over Spark."""
    turn: dict[str, int] = {}
    turns = []
    for lang, g in rows:
        if len(g):
            turns.append((turn.setdefault(lang, 0), lang, g))
            turn[lang] += 1
    rows = [(lang, g) for _, lang, g in sorted(turns, key=lambda r: r[:2])]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.zeros((WIDTH, 0)))
    space = Nystroem.of([g for _, g in rows[:landmarks]])
    return solve(space, languages, sums_of(space.features([g for _, g in rows]), _targets([x for x, _ in rows], languages)), len(rows), ridge)


def train(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE, most: int = FIT_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Learns from rows with text and lang. The driver gets the landmarks and sums of products, whatever the number of texts."""
    spark = ready(docs.sparkSession)
    d = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").alias("text"), col(docs, "lang").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    picked = first_by_hash(d.select("doc_id", "lang"), "lang", "doc_id", F.lit(per_language))
    picked = picked.orderBy("turn", "lang").limit(most).select(F.col("doc_id").alias("picked"), F.col("lang").alias("of"), "turn")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(WIDTH, bool)
        for b in batches:
            found = [grams(t.as_py(), flags).astype(np.int32) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("turn"), b.column("lang"), pa.array([f.tobytes() for f in found], pa.binary())], ["turn", "lang", "grams"])

    chosen = d.join(F.broadcast(picked.distinct()), F.col("doc_id").eqNullSafe(F.col("picked")) & (F.col("lang") == F.col("of"))).select("turn", "text", "lang")
    rows = written(chosen.mapInArrow(seen, "turn int, lang string, grams binary").where("length(grams) > 0"), "language-sample")
    # repeated rows of one id may be more than were picked: the sample is cut again, so that its bound holds
    rows = written(rows.orderBy("turn", "lang", "grams").limit(most), "language-rows")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((WIDTH, 0)))
    first = rows.orderBy("turn", "lang", "grams").limit(landmarks).collect()
    space = Nystroem.of([np.frombuffer(bytes(r.grams), np.int32) for r in first])
    shared = spark.sparkContext.broadcast(space)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for b in batches:
            for a in range(0, b.num_rows, TEXTS_A_PRODUCT):
                some = b.slice(a, TEXTS_A_PRODUCT)
                found = [np.frombuffer(g.as_py(), np.int32) for g in some.column("grams")]
                total = total + sums_of(shared.value.features(found), _targets(some.column("lang").to_pylist(), languages))
                n += len(found)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])

    sums, n = 0.0, 0
    for r in rows.mapInArrow(summed, "n long, sums binary").toLocalIterator():
        sums, n = sums + np.frombuffer(bytes(r.sums)).reshape(space.half.shape[1], -1), n + r.n
    return solve(space, languages, sums, n)


def with_language(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score") -> DataFrame:
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("label string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            labels, scores = shared.value.predict(s.tolist())
            trim()
            yield pd.DataFrame({"label": labels, "score": scores})

    (both,) = fresh(docs, "language_found")
    out = docs.withColumn(both, predicted(col(docs, "text")))
    return out.withColumns({label: F.col(f"{both}.label"), score: F.col(f"{both}.score")}).drop(both)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    model = train(docs.where(~held_out))
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


SQL: dict[str, str] = {}
QUERIES = {"op10_language": op10_language}
