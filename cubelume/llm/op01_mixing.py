"""Mixing sources to target weights.

Tokens (words) are summed per source, targets are set by weight under a repetition ceiling, and each
document is taken floor(rate) times plus once more if a hash of its id falls under the rate's fraction.

Defined results: null text has size 0; null source is a source of its own, last in order; a source of
size 0 gets target 0 and its documents are taken 0 times; repeated rows with one id share one draw;
an empty table gives an empty plan; columns of the input that clash with ours are kept by emit() as
they are, as ours get other names inside. Targets are set in one task over one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, fresh, table, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Source tables up to this many rows are broadcast (about 100 B each); beyond it Spark joins by shuffle and splits skew.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> the same with target: a share by weight of all sizes, held at max_repeats times the source's size.

    Resharing the excess until none is above ends where every target is min(ceiling, level * weight). The level
    is found in one pass in order of ceiling / weight: with the first k at their ceilings it is (all - their
    ceilings) / (the others' weights), and the first source whose ratio is above that is free.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeats)
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("level", left / F.sum("w").over(after)).withColumn("place", F.row_number().over(order))
    s = s.withColumn("free", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", F.col("level").alias("level")))).over(every))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("free.level") * F.col("w")), F.lit(0.0))
    return s.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone: 52 bits of md5."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> tuple[DataFrame, dict[str, str]]:
    """docs with columns for size, source_size, target and copies; the second value has their names in the result."""
    names = dict(zip(("size", "source_size", "target", "copies"), fresh(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies"), strict=True))
    sized = docs.withColumn(names["size"], n_words(col(docs, "text")))
    per = sized.groupBy(col(sized, "source").alias("source")).agg(F.sum(names["size"]).cast("long").alias("source_size"))
    plan = written(source_targets(per, weights, max_repeats).coalesce(1), "mix-targets")
    s, n, t = fresh(sized, *(f"{names['target']}_{x}" for x in "snt"))
    plan = plan.select(F.col("source").alias(s), F.col("source_size").alias(n), F.col("target").alias(t))
    side = F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan
    out = sized.join(side, col(sized, "source").eqNullSafe(F.col(s)), "left")
    rate = F.when(F.col(n) > 0, F.col(t) / F.col(n)).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(col(sized, "doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    out = out.withColumns({names["source_size"]: F.col(n), names["target"]: F.col(t), names["copies"]: F.least(copies, F.lit(max_repeats)).cast("int")})
    return out.drop(s, n, t), names


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the input's columns."""
    out, names = with_copies(docs, **options)
    (i,) = fresh(out, "mix_copy")
    out = out.where(F.col(names["copies"]) > 0).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(names["copies"]))))
    return out.drop(i, *names.values())


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    c = {k: F.col(v) for k, v in n.items()}
    return out.select("doc_id", c["size"].alias("size"), c["source_size"].alias("source_size"), c["target"].alias("target"), (c["size"] * c["copies"]).cast("long").alias("taken"), c["copies"].alias("copies"))


SQL = {
    "op1_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, (source_size * 3)::BIGINT AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY ratio, source ASC NULLS LAST) AS place FROM r),
f AS (SELECT arg_min(level, place) AS level FROM l WHERE ratio > level),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT level FROM f) * w), 0.0)::DOUBLE AS target FROM l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 3)::INT AS copies FROM q)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
""",
}
QUERIES = {"op1_mixing": op1_mixing}
