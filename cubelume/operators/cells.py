"""Cells of a cube: kernel-weighted aggregation, statistics, neighbours in space and time, importance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import FARTHEST, brightness, distance, pack, saturation

#: Weights are whole millionths, so that sums are exact in any order.
UNIT = 1_000_000
SIGMA_SPACE, SIGMA_TIME = 2.5, 2.0


def at(c: str) -> Column:
    return F.floor(F.col(c) / 9).cast("int")


def offset(c: str) -> Column:
    return F.col(c) % 9 - 4


def cell_key(t: Column, y: Column, x: Column) -> Column:
    return (t * 81 + y * 9 + x).cast("int")


def kernel_weight(space: float = SIGMA_SPACE, time: float = SIGMA_TIME) -> Column:
    """Of a voxel (f, y, x) about its cell's centre."""
    dx, dy, dt = offset("x"), offset("y"), offset("f")
    return F.round(UNIT * F.exp(-(dx * dx + dy * dy) / (2 * space * space)) * F.exp(-(dt * dt) / (2 * time * time))).cast("long")


def kernel_table() -> list[tuple[int, int, int, int]]:
    """dt, dy, dx, weight: the same 729 weights as rows."""
    return [(t, y, x, round(UNIT * math.exp(-(x * x + y * y) / (2 * SIGMA_SPACE**2)) * math.exp(-t * t / (2 * SIGMA_TIME**2)))) for t in range(-4, 5) for y in range(-4, 5) for x in range(-4, 5)]


def centroids(voxels: DataFrame, weight: Column | None = None) -> DataFrame:
    """cell, t, y, x, r, g, b, w, n: one shuffle of partial sums, at most 729 rows a task."""
    v = voxels.withColumn("w", weight if weight is not None else kernel_weight())
    sums = [F.sum(F.col(c).cast("long") * F.col("w")).alias(f"s{c}") for c in "rgb"]
    s = v.groupBy(at("f").alias("t"), at("y").alias("cy"), at("x").alias("cx")).agg(*sums, F.sum("w").alias("w"), F.count("*").alias("n"))
    whole = [F.when(F.col("w") > 0, F.expr(f"s{c} div w")).otherwise(0).cast("int").alias(c) for c in "rgb"]
    return s.select(cell_key(F.col("t"), F.col("cy"), F.col("cx")).alias("cell"), "t", F.col("cy").alias("y"), F.col("cx").alias("x"), *whole, "w", "n")


def tensor_stats(cells: DataFrame) -> DataFrame:
    w = F.col("w")
    return cells.agg(F.count("*").alias("cells"), F.count_if(w > 0).alias("non_zero"), F.sum("w").cast("long").alias("total"), F.round(F.avg("w"), 6).alias("mean"), F.min(F.when(w > 0, w)).alias("least"), F.max("w").alias("most"))


def centre_sample(voxels: DataFrame) -> DataFrame:
    """The centre of each 9 x 9 x 9 cell: a filter on the scan, no shuffle."""
    return voxels.where((F.col("f") % 9 == 4) & (F.col("y") % 9 == 4) & (F.col("x") % 9 == 4))


def frame_stats(voxels: DataFrame) -> DataFrame:
    light = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    return voxels.groupBy("f").agg(F.count("*").alias("n"), F.round(F.avg(light), 6).alias("mean"), F.round(F.stddev_pop(light), 6).alias("deviation"), F.count_distinct(pack(F.col("r"), F.col("g"), F.col("b"), None)).alias("colours"))


def colour_variance() -> Column:
    """Population variance of r, g, b over the group, as a share of 255²."""
    return (F.var_pop("r") + F.var_pop("g") + F.var_pop("b")) / (3.0 * 255 * 255)


def rgb(prefix: str = "") -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in "rgb")


def step(cells: DataFrame, axis: str, by: int = 1, default: str | None = None) -> DataFrame:
    """cells with the colour `by` places back on an axis (t, y or x), as pr, pg, pb; null at the edge."""
    others = [c for c in "tyx" if c != axis]
    w = Window.partitionBy(*others).orderBy(axis)
    return cells.withColumns({f"p{c}": F.lag(c, by).over(w) for c in "rgb"})


def motion(cells: DataFrame) -> DataFrame:
    """Distance to the cell before in time as a share of the largest, and its change from step to step."""
    w = Window.partitionBy("y", "x").orderBy("t")
    m = F.coalesce(distance(rgb(), rgb("p")) / FARTHEST, F.lit(0.0))
    out = step(cells, "t").withColumn("motion", m)
    return out.withColumn("gradient", F.coalesce(F.col("motion") - F.lag("motion").over(w), F.lit(0.0))).drop("pr", "pg", "pb")


def edges(cells: DataFrame) -> DataFrame:
    """t and the distance of each cell to its right and to its lower neighbour, a row each."""
    right, down = (step(cells, a, -1).where("pr IS NOT NULL").select("t", "y", "x", distance(rgb(), rgb("p")).alias("d")) for a in "xy")
    return right.unionByName(down)


def edge_density(cells: DataFrame) -> DataFrame:
    return edges(cells).groupBy("t").agg((F.avg("d") / FARTHEST).alias("edge"))


def spatial_importance(cells: DataFrame) -> DataFrame:
    """axis, slice, raw: 0.6 colour variance + 0.4 edge density of each time slice."""
    var = cells.groupBy("t").agg(colour_variance().alias("variance"))
    return var.join(edge_density(cells), "t").select(F.lit("t").alias("axis"), F.col("t").alias("slice"), (0.6 * F.col("variance") + 0.4 * F.col("edge")).alias("raw"))


def temporal_importance(cells: DataFrame) -> DataFrame:
    """axis, slice, raw: 0.7 motion + 0.3 mean over y of the variance in time, of each column."""
    m = step(cells, "t").where("pr IS NOT NULL").groupBy("x").agg((F.avg(distance(rgb(), rgb("p"))) / FARTHEST).alias("motion"))
    v = cells.groupBy("x", "y").agg(colour_variance().alias("v")).groupBy("x").agg(F.avg("v").alias("variance"))
    return m.join(v, "x").select(F.lit("x").alias("axis"), F.col("x").alias("slice"), (0.7 * F.col("motion") + 0.3 * F.col("variance")).alias("raw"))


METRICS = ("brightness", "saturation", "motion", "variance", "combined")


def importance_by(cells: DataFrame, metric: str, out: str = "value") -> DataFrame:
    """cells with the importance that a player of boards sees: brightness, saturation, motion from the cell before (0 in the first layer),
    variance of the colour over time, or the mean of brightness and saturation (combined)."""
    light, pure = brightness(*rgb()), saturation(*rgb())
    if metric == "motion":
        return motion(cells).withColumnRenamed("motion", out).drop("gradient")
    if metric == "variance":
        over = Window.partitionBy("y", "x")
        return cells.withColumn(out, (F.var_pop("r").over(over) + F.var_pop("g").over(over) + F.var_pop("b").over(over)) / (3.0 * 255 * 255))
    return cells.withColumn(out, {"brightness": light, "saturation": pure, "combined": (light + pure) / 2}[metric])


def mode_of_cells(indexed: DataFrame, top: int = 4) -> DataFrame:
    """indexed (cell, idx, ...) -> cell, n, dominant, secondary, share of others (purity gap), the top (idx, count) list."""
    counts = indexed.groupBy("cell", "idx").agg(F.count("*").alias("k"))
    w = Window.partitionBy("cell").orderBy(F.desc("k"), "idx")
    ranked = counts.withColumn("rank", F.row_number().over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("cell")))
    out = ranked.where(F.col("rank") <= top).groupBy("cell", "n").agg(F.sort_array(F.collect_list(F.struct("rank", "idx", "k"))).alias("list"))
    return out.select("cell", "n", F.col("list")[0]["idx"].alias("dominant"), F.try_element_at("list", F.lit(2))["idx"].alias("secondary"), F.round(1 - F.col("list")[0]["k"] / F.col("n"), 9).alias("variance"), F.array_join(F.transform("list", lambda e: F.concat_ws(":", e["idx"].cast("string"), e["k"].cast("string"))), " ").alias("top"))


def neighbour_mean(cells: DataFrame) -> DataFrame:
    """Distance of each cell to the mean of its up to six neighbours."""
    out, total, n = cells, {c: F.lit(0) for c in "rgb"}, F.lit(0)
    for axis in "tyx":
        w = Window.partitionBy(*[c for c in "tyx" if c != axis]).orderBy(axis)
        for by in (1, -1):
            for c in "rgb":
                total[c] = total[c] + F.coalesce(F.lag(c, by).over(w), F.lit(0))
            n = n + F.lag("r", by).over(w).isNotNull().cast("int")
    out = out.withColumns({f"s{c}": total[c] for c in "rgb"} | {"k": n})
    gap = F.sqrt(sum(((F.col(c) - F.col(f"s{c}") / F.col("k")) * (F.col(c) - F.col(f"s{c}") / F.col("k")) for c in "rgb"), F.lit(0.0)))
    return out.select("cell", "t", "y", "x", F.col("k").alias("neighbours"), F.round(gap, 6).alias("gap"))


def region_stats(cells: DataFrame, *by: str) -> DataFrame:
    """Mean intensity, capped variance and dominant channel of each region."""
    light = (F.col("r") + F.col("g") + F.col("b")) / 765.0
    sums = cells.groupBy(*by).agg(F.avg(light).alias("m"), F.var_pop(light).alias("v"), *[F.sum(c).alias(f"s{c}") for c in "rgb"])
    dominant = F.when((F.col("sr") >= F.col("sg")) & (F.col("sr") >= F.col("sb")), "r").when(F.col("sg") >= F.col("sb"), "g").otherwise("b")
    return sums.select(*by, F.round("m", 6).alias("mean"), F.round(F.least(F.lit(1.0), F.col("v") * 4), 6).alias("variance"), dominant.alias("dominant"))


def index_formula(cells: DataFrame) -> DataFrame:
    """Cells whose key isn't that of their place: none."""
    return cells.where(F.col("cell") != cell_key(F.col("t"), F.col("y"), F.col("x")))


def lineage(frames: DataFrame) -> DataFrame:
    """frame -> layer, offset and the 81 cells it is in."""
    return frames.select("f", at("f").alias("layer"), (F.col("f") % 9).alias("offset"), F.explode(F.sequence(F.lit(0), F.lit(80))).alias("i")).select("f", "layer", "offset", (F.col("layer") * 81 + F.col("i")).cast("int").alias("cell"))


def rgb_summary(voxels: DataFrame, *by: str) -> DataFrame:
    """Least, most, mean and population deviation of each channel, and the number of colours. Sums are of whole numbers, so that they are exact."""
    c = {x: F.col(x).cast("long") for x in "rgb"}
    sums = [f for x in "rgb" for f in (F.min(x).alias(f"min_{x}"), F.max(x).alias(f"max_{x}"), F.sum(c[x]).alias(f"s_{x}"), F.sum(c[x] * c[x]).alias(f"q_{x}"))]
    s = voxels.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(pack(c["r"], c["g"], c["b"], None)).alias("colours"), *sums)
    n = F.col("n")
    shown = [f for x in "rgb" for f in (f"min_{x}", f"max_{x}", F.round(F.col(f"s_{x}") / n, 6).alias(f"mean_{x}"), F.round(F.sqrt((n * F.col(f"q_{x}") - F.col(f"s_{x}") * F.col(f"s_{x}")).cast("double")) / n, 6).alias(f"deviation_{x}"))]
    return s.select(*by, "n", "colours", *shown)


def with_cell_weight(voxels: DataFrame, cells: DataFrame) -> DataFrame:
    """voxels with the weight of the cell they are in (0 where that has none); cells are a cube's, 729 at most by their key."""
    w = cells.groupBy("cell").agg(F.max("w").alias("cell_weight"))
    return voxels.withColumn("cell", cell_key(at("f"), at("y"), at("x"))).join(F.broadcast(w), "cell", "left").withColumn("cell_weight", F.coalesce("cell_weight", F.lit(0).cast("long")))


def looked_up(keys: DataFrame, cells: DataFrame, default: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """keys (t, y, x) with r, g, b, w of their cell; keys beyond the cube, null keys and cells without voxels have the default and no weight."""
    c = cells.groupBy("t", "y", "x").agg(*[F.max(v).alias(v) for v in ("r", "g", "b", "w")])  # 729 rows
    out = keys.join(F.broadcast(c), ["t", "y", "x"], "left")
    return out.withColumns({x: F.coalesce(x, F.lit(v).cast("int")) for x, v in zip("rgb", default, strict=True)} | {"w": F.coalesce("w", F.lit(0).cast("long"))})


def whole_capture(voxels: DataFrame, frames: int = 81) -> DataFrame:
    """frames found, missing and beyond, and whether there are exactly those from 0 to frames - 1."""
    f = F.col("f")
    inside, beyond = f.between(0, frames - 1), (f < 0) | (f >= frames)
    s = voxels.agg(F.count_distinct(F.when(inside, f)).alias("found"), F.count_distinct(F.when(beyond, f)).alias("beyond"))
    return s.select("found", (frames - F.col("found")).alias("missing"), "beyond", ((F.col("found") == frames) & (F.col("beyond") == 0)).alias("exact"))
