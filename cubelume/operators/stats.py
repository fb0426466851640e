"""Circular statistics, content features and classification."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import FARTHEST, distance, hsv
from ..functions.scoring import content_scores
from .cells import motion, rgb, step
from .windows import ranked, shares


def circular(df: DataFrame, hue: str, *by: str) -> DataFrame:
    """Mean direction of hues in 0 to 1, and 1 - the length of the mean vector; 0 and 0 of none."""
    a = F.col(hue) * (2 * math.pi)
    s = df.groupBy(*by).agg(F.sum(F.sin(a)).alias("y"), F.sum(F.cos(a)).alias("x"), F.count("*").alias("n"))
    y, x, n = F.coalesce("y", F.lit(0.0)), F.coalesce("x", F.lit(0.0)), F.col("n")
    return s.select(*by, F.when(n > 0, (F.atan2(y, x) / (2 * math.pi) + 1) % 1).otherwise(0.0).alias("hue"), F.when(n > 0, 1 - F.sqrt(x * x + y * y) / n).otherwise(0.0).alias("spread"))


def content_features(cells: DataFrame) -> DataFrame:
    """One row of nine features of a cube's cells."""
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    c = cells.withColumns({"h": h, "s": s, "v": v})
    colour = F.floor(F.col("r") / 8) * 1024 + F.floor(F.col("g") / 8) * 32 + F.floor(F.col("b") / 8)
    base = c.agg(F.avg("v").alias("mean_v"), F.var_pop("v").alias("var_v"), F.avg("s").alias("mean_s"), F.var_pop("s").alias("var_s"), (F.count_distinct(colour) / F.count("*")).alias("unique"))
    hue = circular(c.where("s > 0.1"), "h").withColumnsRenamed({"spread": "hue_spread"})
    moved = motion(cells).agg((F.avg(F.when(F.col("t") > 0, F.col("motion")))).alias("motion"))
    # the middle slice, without its last row and column, as the rule has it
    middle = cells.where("t = 4")
    gaps = [step(middle, a, -1).where("pr IS NOT NULL AND y < 8 AND x < 8").select(distance(rgb(), rgb("p")).alias("d")) for a in "xy"]
    edge = gaps[0].unionByName(gaps[1]).agg((F.avg("d") / FARTHEST).alias("edge"))
    out = base.crossJoin(hue).crossJoin(moved).crossJoin(edge)  # one row each
    return out.select(*[F.round(x, 6).alias(x) for x in ("mean_v", "var_v", "mean_s", "var_s", "hue", "hue_spread", "edge", "motion", "unique")])


def classified(features: DataFrame) -> DataFrame:
    """kind, points, share, rank of one row of features; the first is the primary, the second counts if its share is over 0.2."""
    f = {c: F.col(f"`{c}`") for c in features.columns}
    wide = features.select(*[F.round(p, 6).alias(n) for n, p in content_scores(f).items()])
    long = wide.unpivot([], wide.columns, "kind", "points")
    out = ranked(shares(long, "points"), "points", key="kind")
    return out.select("kind", "points", F.round("share", 6).alias("share"), "rank")
