"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs as they are.

1. language: documents in which no language can be told (no letter at all) go.
2. near_duplicates: one document of each group of near-duplicates stays.
3. decontamination: documents that hold an item of the benchmark go.
4. mixing: each document is there as often as its source's rate takes it, which may be not at all.
5. token_ids: the ids of all documents are written and read back: doc_id, start, n_tokens, ids_crc32.

Defined results: null and empty texts have no language and go in stage 1 (unless there is nothing to learn a language from); repeated rows are one document to stage 2, which keeps
one of them; rows without doc_id go through all stages as documents of their own; ties between near-duplicates go to the least doc_id; very long texts are read whole
by every stage; further columns and columns of clashing names are kept as they are up to stage 4; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelume.llm import op01_mixing, op04_minhash, op07_decontamination, op08_token_ids, op10_language
from cubelume.llm.common import fresh, id_crc, ready, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    model = op10_language.train(docs.where(F.coalesce(id_crc(F.col("doc_id")) % 5 != 0, F.lit(True))))
    label, score = fresh(docs, "language_label", "language_score")
    out = op10_language.with_language(docs, model, label, score)
    # without anything to learn from, nothing is rejected
    kept = out.where(F.col(label) != op10_language.UNKNOWN) if model.languages else out
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return op04_minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return docs.where(~op07_decontamination.is_leaked(F.col("text"), table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op01_mixing.emit(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return op08_token_ids.round_trip(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]
#: Language, near-duplicates, decontamination and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
