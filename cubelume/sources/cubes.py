"""Where cubes, palettes, rewards and telemetry come from: views over tables, and synthetic patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ready

SIDE, CELL = 81, 9


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, y, x, r, g, b: a sparse bag of voxels from lineitem; keys repeat and some are missing."""
    c = F.col
    cols = {
        "f": c("l_orderkey") % SIDE, "y": c("l_partkey") % SIDE, "x": (c("l_suppkey") * 7 + c("l_linenumber")) % SIDE,
        "r": (c("l_orderkey") * 31 + c("l_linenumber") * 7) % 256, "g": (c("l_partkey") * 17) % 256, "b": (c("l_suppkey") * 13 + c("l_orderkey")) % 256,
    }
    return load(spark, sf_dir, "lineitem").select(*[v.cast("int").alias(k) for k, v in cols.items()])


PATTERNS = ("gradient", "checkerboard", "solid", "rings", "wave", "tiles", "diagonal", "pulse", "board")


def _pattern(name: str, f: Column, y: Column, x: Column) -> tuple[Column, Column, Column]:
    up = lambda v: F.floor(v * 255 / 80).cast("int")
    if name == "gradient":
        return up(x), up(y), up(f)
    if name == "checkerboard":
        on = (F.floor(x / 9) + F.floor(y / 9) + F.floor(f / 9)) % 2 * 255
        return on.cast("int"), on.cast("int"), on.cast("int")
    if name == "solid":
        return (f * 3).cast("int"), F.lit(128), (240 - f * 3).cast("int")
    if name == "rings":
        d = ((x - 40) * (x - 40) + (y - 40) * (y - 40)).cast("int")
        return (d + f * 5) % 256, (d * 2) % 256, (d * 3) % 256
    if name == "wave":
        return ((x + f * 3) * 7 % 256).cast("int"), ((y + f * 2) * 5 % 256).cast("int"), (f * 3).cast("int")
    if name == "tiles":
        cell = (F.floor(f / 9) * 81 + F.floor(y / 9) * 9 + F.floor(x / 9)).cast("int")
        return (cell * 37) % 256, (cell * 59) % 256, (cell * 83) % 256
    if name == "diagonal":
        d = (x + y + f).cast("int")
        return d % 256, (255 - d).cast("int"), (d * 2) % 256
    if name == "pulse":
        p = F.abs(40 - f) * 6
        return p.cast("int"), (240 - p).cast("int"), F.lit(60)
    if name == "board":
        line = ((x % 9 == 4) | (y % 9 == 4)).cast("int")
        return (200 - line * 160).cast("int"), (170 - line * 140).cast("int"), (90 - line * 70).cast("int")
    raise ValueError(name)


def dense_cube(spark: SparkSession, pattern: str = "gradient", side: int = SIDE) -> DataFrame:
    """f, y, x, r, g, b of every place of a cube, by arithmetic over a range: no data, any parallelism."""
    i = F.col("id")
    keys = ready(spark).range(side**3).select(F.floor(i / (side * side)).cast("int").alias("f"), (F.floor(i / side) % side).cast("int").alias("y"), (i % side).cast("int").alias("x"))
    r, g, b = _pattern(pattern, F.col("f"), F.col("y"), F.col("x"))
    return keys.withColumns({"r": r.cast("int"), "g": g.cast("int"), "b": b.cast("int")})


def filled(spark: SparkSession, sf_dir: str, side: int = 81) -> DataFrame:
    """f, y, x, r, g, b of every place of a cube from the table: the mean colour of a place's voxels; a place without any has that of the nearest
    earlier frame that has some there, or else of the nearest later one; black where no frame has."""
    means = voxels(spark, sf_dir).groupBy("f", "y", "x").agg(*[F.expr(f"CAST(sum({c}) div count(*) AS INT)").alias(c) for c in "rgb"])
    every = dense_cube(spark, "solid", side).select("f", "y", "x").join(means, ["f", "y", "x"], "left")
    w = Window.partitionBy("y", "x").orderBy("f")  # a row a frame
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return every.select("f", "y", "x", *[F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after), F.lit(0)).alias(c) for c in "rgb"])


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, content, ssim, delta_e, rating (nullable), edited, accepted, bytes from events."""
    e, i = load(spark, sf_dir, "events"), F.col("event_id")
    content = F.when(i % 7 != 0, F.col("event_type"))
    return e.select(
        i.alias("id"), "ts", content.alias("content"), ((i * 37 % 1000) / 1000.0).alias("ssim"), ((i * 53 % 500) / 10.0).alias("delta_e"),
        F.when(i % 3 != 0, (i % 5 + 1).cast("int")).alias("rating"), (i % 4 == 0).alias("edited"), (i % 5 != 0).alias("accepted"), (i * 7919 % 2_000_000).alias("bytes"),
    )


def frames(cube: DataFrame) -> DataFrame:
    """f and its rows of pixels as one binary of r, g, b triples in raster order: a frame a row, grouped by frame."""
    packed = F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    hexed = F.transform(packed, lambda p: F.concat(*[F.lpad(F.hex(p[c].cast("long")), 2, "0") for c in "rgb"]))
    return cube.groupBy("f").agg(F.unhex(F.array_join(hexed, "")).alias("rgb"), F.count("*").alias("n"))


# ---- the same views as SQL
VOXEL = """voxel AS (SELECT CAST(l_orderkey % 81 AS INT) AS f, CAST(l_partkey % 81 AS INT) AS y, CAST((l_suppkey * 7 + l_linenumber) % 81 AS INT) AS x,
 CAST((l_orderkey * 31 + l_linenumber * 7) % 256 AS INT) AS r, CAST((l_partkey * 17) % 256 AS INT) AS g, CAST((l_suppkey * 13 + l_orderkey) % 256 AS INT) AS b FROM lineitem)"""
CELLS = (
    VOXEL
    + """, cells AS (SELECT CAST(f // 9 * 81 + y // 9 * 9 + x // 9 AS INT) AS cell, CAST(f // 9 AS INT) AS t, CAST(y // 9 AS INT) AS y, CAST(x // 9 AS INT) AS x,
 CAST(sum(r * w) // sum(w) AS INT) AS r, CAST(sum(g * w) // sum(w) AS INT) AS g, CAST(sum(b * w) // sum(w) AS INT) AS b, CAST(sum(w) AS BIGINT) AS w, CAST(count(*) AS BIGINT) AS n
 FROM (SELECT *, CAST(round(1000000 * exp(-((x % 9 - 4) * (x % 9 - 4) + (y % 9 - 4) * (y % 9 - 4)) / 12.5) * exp(-((f % 9 - 4) * (f % 9 - 4)) / 8.0)) AS BIGINT) AS w FROM voxel)
 GROUP BY ALL_KEYS)""".replace("GROUP BY ALL_KEYS", "GROUP BY f // 9, y // 9, x // 9")
)
FILLED = (
    VOXEL
    + """, vm AS (SELECT f, y, x, CAST(sum(r) // count(*) AS INT) AS r, CAST(sum(g) // count(*) AS INT) AS g, CAST(sum(b) // count(*) AS INT) AS b FROM voxel GROUP BY f, y, x),
 cube AS (SELECT p.f, p.y, p.x, """
    + ", ".join(f"coalesce(last_value(vm.{c} IGNORE NULLS) OVER before, first_value(vm.{c} IGNORE NULLS) OVER after, 0) AS {c}" for c in "rgb")
    + """ FROM (SELECT CAST(i // 6561 AS INT) AS f, CAST(i // 81 % 81 AS INT) AS y, CAST(i % 81 AS INT) AS x FROM range(531441) t(i)) p LEFT JOIN vm ON p.f = vm.f AND p.y = vm.y AND p.x = vm.x
 WINDOW before AS (PARTITION BY p.y, p.x ORDER BY p.f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), after AS (PARTITION BY p.y, p.x ORDER BY p.f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
)
GRADIENT = "cube AS (SELECT CAST(i // 6561 AS INT) AS f, CAST(i // 81 % 81 AS INT) AS y, CAST(i % 81 AS INT) AS x, CAST(i % 81 * 255 // 80 AS INT) AS r, CAST(i // 81 % 81 * 255 // 80 AS INT) AS g, CAST(i // 6561 * 255 // 80 AS INT) AS b FROM range(531441) t(i))"
RINGS = "cube AS (SELECT f, y, x, CAST((d + f * 5) % 256 AS INT) AS r, CAST(d * 2 % 256 AS INT) AS g, CAST(d * 3 % 256 AS INT) AS b FROM (SELECT f, y, x, (x - 40) * (x - 40) + (y - 40) * (y - 40) AS d FROM (SELECT CAST(i // 6561 AS INT) AS f, CAST(i // 81 % 81 AS INT) AS y, CAST(i % 81 AS INT) AS x FROM range(531441) t(i))))"
REWARD = """reward AS (SELECT event_id AS id, ts, CASE WHEN event_id % 7 <> 0 THEN event_type END AS content, (event_id * 37 % 1000) / 1000.0::DOUBLE AS ssim, (event_id * 53 % 500) / 10.0::DOUBLE AS delta_e,
 CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 5 + 1 AS INT) END AS rating, event_id % 4 = 0 AS edited, event_id % 5 <> 0 AS accepted, event_id * 7919 % 2000000 AS bytes FROM events)"""


def from_rows(data: Column, width: int, height: int, stride: int, depth: int = 4) -> Column:
    """r, g, b bytes of width x height pixels out of rows of `stride` bytes with b, g, r first in each pixel of `depth` bytes. A pixel whose
    three bytes the data doesn't hold is black; no data is a black frame."""
    digits = F.hex(F.coalesce(data, F.lit(b"")))
    has = F.coalesce(F.octet_length(data), F.lit(0))

    def pixel(i: Column) -> Column:
        at = F.floor(i / width) * stride + i % width * depth
        one = lambda k: F.substring(digits, ((at + k) * 2 + 1).cast("int"), F.lit(2))
        return F.when(at + 3 <= has, F.concat(one(2), one(1), one(0))).otherwise("000000")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel), ""))
