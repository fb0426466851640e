import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with ours."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the of and " * 20_000, "en", "a", 1), (4, "only two", "en", "b", 8), (4, "only two", "en", "b", 8), (None, "no id here at all", "en", "b", 3), (5, "\t\n ", None, None, 3), (6, "x" * 50_000, "de", "c", 1), (7, "été \U0001f600 日本語", "fr", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("size", "target", "shard", "score", "mix_size", "bands", "h", "key", "number.of words"):
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
