"""Digests of cells, the colour space of a cube, and palettes chosen by place and by time that are merged into one.

Bins and scores are whole numbers, so that they don't depend on the order of rows; entropies are rounded before they are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import luma_milli, unpack
from . import palettes as P
from . import windows as W
from .cells import at, cell_key
from .matching import one_to_one

BINS = 9
#: Places of the corners and of the centre: t, y, x.
SAMPLES = ((0, 0, 0), (0, 0, 8), (0, 8, 0), (0, 8, 8), (4, 4, 4), (8, 0, 0), (8, 0, 8), (8, 8, 0), (8, 8, 8))
#: Bits below which a colour is local in space (81 tiles) and transient in time (9 layers).
LOCAL_BITS, TRANSIENT_BITS = 2.0, 1.5
#: Fixed value: 9 to the fifth, the most colours that a report compares with.
MOST_COLOURS = 59_049


def _binned(cube: DataFrame) -> DataFrame:
    """f, y, x, cell, o, luma (thousandths) and the bins lb, hb, sb of luminance, hue and HSL saturation; hb is null at saturations up to 0.1."""
    r, g, b = (F.col(c) for c in "rgb")
    c = cube.select("f", "y", "x", cell_key(at("f"), at("y"), at("x")).alias("cell"), (F.col("f") % 9).alias("o"), luma_milli(r, g, b).alias("luma"), F.greatest(r, g, b).alias("top"), F.least(r, g, b).alias("low"), "r", "g", "b")
    c = c.withColumn("d", F.expr("top - low")).withColumn("whole", F.expr("IF(top + low <= 255, top + low, 510 - top - low)"))
    turn = "CASE WHEN top = r THEN g - b + IF(g < b, 6 * d, 0) WHEN top = g THEN b - r + 2 * d ELSE r - g + 4 * d END"
    bins = {"lb": "least(8, luma * 9 div 255000)", "sb": "CASE WHEN d > 0 THEN least(8, d * 9 div whole) ELSE 0 END", "hb": f"CASE WHEN d * 10 > whole THEN least(8, ({turn}) * 9 div (6 * d)) END"}
    return c.select("f", "y", "x", "cell", "o", "luma", *[F.expr(e).cast("int").alias(n) for n, e in bins.items()])


def digests(cube: DataFrame) -> DataFrame:
    """cell and nine numbers each of luminance, hue and saturation (shares of bins), change, stability and contrast (by frame), with
    their means activity, light and mean_contrast. cube has one voxel a place; a cell's first frame has no change.

    One shuffle by pixel and layer for the change, then partial sums: at most 6 561 rows a task and a cube."""
    from pyspark.sql import Window

    w = Window.partitionBy(at("f"), "y", "x").orderBy("f")
    v = _binned(cube).withColumn("moved", F.coalesce(F.abs(F.col("luma") - F.lag("luma").over(w)), F.lit(0)))
    counts = [F.count_if(F.col(f"{k}b") == i).alias(f"{k}{i}") for k in "lhs" for i in range(BINS)]
    per = v.groupBy("cell", "o").agg(F.count("*").alias("n"), F.sum("moved").alias("moved"), F.max("luma").alias("top"), F.min("luma").alias("low"), *counts)
    frame = F.struct("o", (F.col("moved") / 255000.0 / F.col("n")).alias("change"), ((F.col("top") - F.col("low")) / 255000.0).alias("contrast"))
    s = per.groupBy("cell").agg(F.sort_array(F.collect_list(frame)).alias("frames"), *[F.sum(f"{k}{i}").alias(f"{k}{i}") for k in "lhs" for i in range(BINS)])

    def histogram(k: str) -> Column:
        total = sum((F.col(f"{k}{i}") for i in range(1, BINS)), F.col(f"{k}0"))
        return F.array(*[F.when(total > 0, F.col(f"{k}{i}") / total).otherwise(0.0) for i in range(BINS)])

    d = s.select("cell", histogram("l").alias("luminance"), histogram("h").alias("hue"), histogram("s").alias("saturation"), F.col("frames.change").alias("change"), F.col("frames.contrast").alias("contrast"))
    most = F.greatest(F.array_max("change"), F.lit(0.001))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, e: a + e)
    light = F.aggregate(F.transform("luminance", lambda p, i: p * i / 8.0), F.lit(0.0), lambda a, e: a + e)
    return d.select("cell", "luminance", "hue", "saturation", "change", F.transform("change", lambda c: 1 - c / most).alias("stability"), "contrast", (total("change") / 9).alias("activity"), light.alias("light"), (total("contrast") / 9).alias("mean_contrast"))


FEATURES = ("luminance", "hue", "saturation", "change", "stability", "contrast")


def digest_values(d: DataFrame) -> DataFrame:
    """cell, feature, k, value: a digest's numbers as rows."""

    def rows(name: str) -> Column:
        return F.transform(name, lambda v, i: F.struct(F.lit(name).alias("feature"), i.alias("k"), F.round(v, 6).alias("value")))

    return d.select("cell", F.inline(F.flatten(F.array(*[rows(n) for n in FEATURES]))))


def top_cells(d: DataFrame, n: int = 10) -> DataFrame:
    """measure, cell, value, rank: the n cells of most activity, light and contrast; ties by cell."""
    measures = {"activity": "activity", "luminance": "light", "contrast": "mean_contrast"}
    long = d.select("cell", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(c, 9).alias("value")) for m, c in measures.items()])))
    return W.ranked(long, "value", "measure", key="cell").where(F.col("rank") <= n).select("measure", "cell", F.round("value", 6).alias("value"), "rank")


def sample_cells(cells: DataFrame) -> DataFrame:
    """The cells at the corners and at the centre."""
    return cells.where(F.col("cell").isin([t * 81 + y * 9 + x for t, y, x in SAMPLES]))


def _bits(counts: DataFrame, by: str, out: str) -> DataFrame:
    """argb, entropy of its counts (n) over by, in bits; adding 0 makes a negative zero plain."""
    n = counts.groupBy("argb", by).agg(F.sum("n").alias("n"))
    h = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    return n.groupBy("argb").agg((F.round(h, 8) + 0.0).alias(out), F.sum("n").alias("n"))


def colour_space(voxels: DataFrame) -> DataFrame:
    """argb, n, spatial, temporal, localised, transient: each colour's spread over the 81 tiles and the 9 layers. Everything after the
    first partial sums is by colour."""
    tile = (at("y") * 9 + at("x")).alias("tile")
    counts = P.argb(voxels).groupBy("argb", tile, at("f").alias("t")).agg(F.count("*").alias("n"))
    both = _bits(counts, "tile", "spatial").join(_bits(counts, "t", "temporal").drop("n"), "argb")
    return both.select("argb", "n", "spatial", "temporal", (F.col("spatial") < LOCAL_BITS).alias("localised"), (F.col("temporal") < TRANSIENT_BITS).alias("transient"))


def dual_palettes(voxels: DataFrame, by_tile: Column | None = None, by_frame: Column | None = None, k: int = P.SIZE) -> tuple[DataFrame, DataFrame]:
    """(argb, score) of the k colours of most weight in space and in time. by_tile is a whole number from y and x, by_frame one from f;
    without them all places weigh the same."""
    out = []
    for weight in (by_tile, by_frame):
        h = P.histogram(voxels, weight).orderBy(F.desc("weight"), "argb").limit(k)
        out.append(h.select("argb", F.col("weight").alias("score")))
    return out[0], out[1]


def merged_palettes(a: DataFrame, b: DataFrame) -> DataFrame:
    """idx, argb, r, g, b, kind of two palettes (argb, score): colours of both (0), then similar ones one to one (1), then the rest one by
    one from each side (2), 256 in all, in order of luminance."""
    exact = P.intersection(a, b).withColumn("kind", F.lit(0))
    rest_a, rest_b = P.only(a, b), P.only(b, a)
    matched = one_to_one(P.similar_pairs(rest_a, rest_b)).select(F.col("a").alias("argb"), F.col("b").alias("other"))
    similar = matched.join(rest_a, "argb").select("argb", "score", F.lit(1).alias("kind"))
    left = rest_a.join(matched, "argb", "left_anti")
    right = rest_b.join(matched.select(F.col("other").alias("argb")), "argb", "left_anti")
    order = W.interleaved(left, right, "score", "argb").select("argb", F.col("seq").cast("long").alias("score"), F.lit(2).alias("kind"))
    ranked = exact.unionByName(similar).unionByName(order).orderBy("kind", F.when(F.col("kind") == 2, F.col("score")).otherwise(-F.col("score")), "argb").limit(P.SIZE)
    r, g, b_ = unpack(F.col("argb"))
    return P.by_luminance(ranked.withColumns({"r": r, "g": g, "b": b_})).select("idx", "argb", "r", "g", "b", "kind")


def colour_report(space: DataFrame, spatial: DataFrame, temporal: DataFrame) -> DataFrame:
    """One row: numbers of colours, their density among MOST_COLOURS, global, localised, stable and transient ones, sizes of two palettes
    and how many colours both have."""
    s = space.agg(
        F.count("*").alias("colours"), F.round(F.count("*") / float(MOST_COLOURS), 9).alias("density"),
        *[F.count_if(c).alias(n) for n, c in (("global", ~F.col("localised")), ("localised", F.col("localised")), ("stable", ~F.col("transient")), ("transient", F.col("transient")))],
    )
    sizes = [spatial.agg(F.count("*").alias("spatial")), temporal.agg(F.count("*").alias("temporal")), P.intersection(spatial, temporal).agg(F.count("*").alias("exact"))]
    for one in sizes:  # one row each
        s = s.crossJoin(one)
    return s
