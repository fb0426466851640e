"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch_mark, written


def _linked_to_least(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are linked to the least of them and it: the larger ones (large star), or the others and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """edges (a, b), longs, either way round -> (node, component): every node of an edge and the least node it reaches."""
    spark = edges.sparkSession
    mark = scratch_mark(spark)
    edges = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b").distinct(), f"{tag}-edges")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now.n, now.s) == state or not now.n:
            break
        state = (now.n, now.s)
        edges = written(_linked_to_least(_linked_to_least(edges, True), False), f"{tag}-stars")
        drop_scratch(spark, mark, keep=1)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
