"""Resampling, sliding windows, slices and connected components on rasters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import shared_dir


def square_crop(width: int, height: int) -> tuple[int, int, int]:
    """x, y and side of the centre square."""
    side = min(width, height)
    return (width - side) // 2, (height - side) // 2, side


def crop_resize(pixels: DataFrame, width: int, height: int, out: int = 81) -> DataFrame:
    """f, y, x, r, g, b of out x out pixels: source = crop offset + (place + 0.5) * scale, truncated, clamped.
    The target grid is made by arithmetic and meets the source by an equi-join on the source's key."""
    x0, y0, side = square_crop(width, height)

    def source(c: str, start: int, end: int) -> Column:
        return F.least(F.lit(end - 1), F.lit(start) + F.floor((F.col(c) * 2 + 1) * side / (2 * out))).cast("int")

    i = F.col("id")
    grid = pixels.sparkSession.range(out * out).select(F.floor(i / out).cast("int").alias("oy"), (i % out).cast("int").alias("ox"))
    grid = grid.select("oy", "ox", source("oy", y0, y0 + side).alias("y"), source("ox", x0, x0 + side).alias("x"))
    return pixels.join(F.broadcast(grid), ["y", "x"]).select("f", F.col("oy").alias("y"), F.col("ox").alias("x"), "r", "g", "b")


def box(pixels: DataFrame, side: int, out: int) -> DataFrame:
    """Mean of the source pixels of each target pixel (whole numbers, truncated)."""
    to = [F.floor(F.col(c) * out / side).cast("int").alias(c) for c in "yx"]
    return pixels.groupBy("f", *to).agg(*[F.floor(F.sum(c) / F.count("*")).cast("int").alias(c) for c in "rgb"])


def bilinear(pixels: DataFrame, side: int, out: int) -> DataFrame:
    """Four taps, weights in 1/10000; taps past the edge are the edge's."""
    return _taps(pixels, _axis_taps(side, out, lambda t: max(0.0, 1 - abs(t)), 1.0, False), out)


def lanczos3(pixels: DataFrame, side: int, out: int) -> DataFrame:
    def kernel(t: float) -> float:
        if t == 0:
            return 1.0
        return 0.0 if abs(t) >= 3 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2

    return _taps(pixels, _axis_taps(side, out, kernel, 3.0, True), out)


def _cubic(b: float, c: float):
    """The two-parameter cubic kernel, |t| < 2."""

    def kernel(t: float) -> float:
        t = abs(t)
        if t < 1:
            return ((12 - 9 * b - 6 * c) * t**3 + (-18 + 12 * b + 6 * c) * t**2 + 6 - 2 * b) / 6
        return ((-b - 6 * c) * t**3 + (6 * b + 30 * c) * t**2 + (-12 * b - 48 * c) * t + 8 * b + 24 * c) / 6 if t < 2 else 0.0

    return kernel


def bicubic(pixels: DataFrame, side: int, out: int) -> DataFrame:
    return _taps(pixels, _axis_taps(side, out, _cubic(0.0, 0.5), 2.0, True), out)


def mitchell(pixels: DataFrame, side: int, out: int) -> DataFrame:
    return _taps(pixels, _axis_taps(side, out, _cubic(1 / 3, 1 / 3), 2.0, True), out)


def hermite(pixels: DataFrame, side: int, out: int) -> DataFrame:
    return _taps(pixels, _axis_taps(side, out, lambda t: max(0.0, (2 * abs(t) - 3) * t * t + 1) if abs(t) < 1 else 0.0, 1.0, True), out)


def two_stage(pixels: DataFrame, side: int, out: int) -> DataFrame:
    """Below a quarter of the size by box to twice the target first; then Lanczos-3."""
    if out * 4 < side:
        return lanczos3(box(pixels, side, out * 2), out * 2, out)
    return lanczos3(pixels, side, out)


def resampler(side: int, out: int) -> str:
    """The method for a scale: box below 1/8, Mitchell below 1/4, bicubic below 1/2, else Lanczos-3."""
    scale = out / side
    return "box" if scale < 0.125 else "mitchell" if scale < 0.25 else "bicubic" if scale < 0.5 else "lanczos3"


def resampled(pixels: DataFrame, side: int, out: int, method: str | None = None) -> DataFrame:
    """By the method named, or by the one that suits the scale."""
    every = {"box": box, "bilinear": bilinear, "lanczos3": lanczos3, "bicubic": bicubic, "mitchell": mitchell, "hermite": hermite, "two_stage": two_stage}
    return every[method or resampler(side, out)](pixels, side, out)


def _axis_taps(side: int, out: int, kernel, reach: float, stretch: bool) -> list[tuple[int, int, int]]:
    """(target, source, weight in 1/10000) along one axis; weights of a target sum to 10000."""
    scale, rows = side / out, []
    wide = max(1.0, scale) if stretch else 1.0
    for o in range(out):
        centre = (o + 0.5) * scale - 0.5
        found: dict[int, float] = {}
        for s in range(math.ceil(centre - reach * wide), math.floor(centre + reach * wide) + 1):
            at = min(side - 1, max(0, s))
            found[at] = found.get(at, 0.0) + kernel((s - centre) / wide)
        total = sum(found.values())
        whole = {s: round(10_000 * w / total) for s, w in found.items()}
        whole[max(whole, key=lambda s: (whole[s], -s))] += 10_000 - sum(whole.values())
        rows += [(o, s, w) for s, w in whole.items() if w]
    return rows


def _taps(pixels: DataFrame, taps: list[tuple[int, int, int]], out: int) -> DataFrame:
    """A separable kernel: along x, then along y; the table of taps has a few rows for each target and is broadcast."""
    for axis, other in (("x", "y"), ("y", "x")):
        t = pixels.sparkSession.createDataFrame(taps, f"o int, {axis} int, k int")
        met = pixels.join(F.broadcast(t), axis)
        pixels = met.groupBy("f", other, F.col("o").alias(axis)).agg(*[F.sum(F.col(c).cast("long") * F.col("k")).alias(c) for c in "rgb"])
    scale = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col(c) + 50_000_000) / 100_000_000))).cast("int").alias(c)
    return pixels.select("f", "y", "x", *[scale(c) for c in "rgb"])


def plane(cube: DataFrame, axis: str, at: int) -> DataFrame:
    return cube.where(F.col(axis) == at).drop(axis)


def trace(cube: DataFrame, y: int, x: int) -> DataFrame:
    """One row: the colours of a pixel in order of time."""
    return cube.where((F.col("y") == y) & (F.col("x") == x)).agg(F.sort_array(F.collect_list(F.struct("f", "r", "g", "b"))).alias("trace"))


def evenly(cube: DataFrame, n: int, total: int = 81) -> DataFrame:
    """n frames, the i-th being floor(i * total / n), renumbered."""
    picks = cube.sparkSession.range(n).select(F.col("id").cast("int").alias("pick"), F.floor(F.col("id") * total / n).cast("int").alias("f"))
    return cube.join(F.broadcast(picks), "f").drop("f").withColumnRenamed("pick", "f")


def ssim(a: DataFrame, b: DataFrame, side: int = 81, size: int = 8, stride: int = 4) -> DataFrame:
    """f, ssim: mean over size x size windows every stride pixels, the end left out, of two cubes' luma (population statistics).
    Each pixel goes to its at most 4 windows, so one shuffle of partial sums does."""
    y = lambda: ((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000.0)
    met = a.select("f", "y", "x", y().alias("u")).join(b.select("f", "y", "x", y().alias("v")), ["f", "y", "x"])
    last = (side - size - 1) // stride if side > size else -1

    def window(c: str) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride)).cast("int"), F.least(F.lit(last), F.floor(F.col(c) / stride)).cast("int"))

    covered = met.where((F.ceil((F.col("x") - size + 1) / stride) <= last) & (F.ceil((F.col("y") - size + 1) / stride) <= last))
    w = covered.withColumn("wy", F.explode(window("y"))).withColumn("wx", F.explode(window("x")))
    s = w.groupBy("f", "wy", "wx").agg(F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.var_pop("u").alias("vu"), F.var_pop("v").alias("vv"), F.covar_pop("u", "v").alias("c"))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    one = (2 * F.col("mu") * F.col("mv") + c1) * (2 * F.col("c") + c2) / ((F.col("mu") * F.col("mu") + F.col("mv") * F.col("mv") + c1) * (F.col("vu") + F.col("vv") + c2))
    return s.groupBy("f").agg(F.round(F.avg(one), 6).alias("ssim"), F.count("*").alias("windows"))


def components(cells: DataFrame, colour: str) -> DataFrame:
    """cells (t, y, x, colour) with group: the least y * 9 + x of each 4-connected area of one colour in a layer.

    A layer has 81 cells whatever the cube's size, so runs of least labels go by windows along rows and columns until
    nothing changes (at most 81 rounds); lineage is cut in the shared checkpoint folder."""
    out = cells.withColumn("group", (F.col("y") * 9 + F.col("x")).cast("int"))
    shared_dir(out.sparkSession)
    total = None
    while True:
        for line, along in (("y", "x"), ("x", "y")):
            w = Window.partitionBy("t", line).orderBy(along)
            new_run = F.coalesce((F.lag(colour).over(w) != F.col(colour)) | (F.lag(along).over(w) != F.col(along) - 1), F.lit(True))
            out = out.withColumn("__run", F.sum(new_run.cast("int")).over(w)).withColumn("group", F.min("group").over(Window.partitionBy("t", line, "__run"))).drop("__run")
        out = out.checkpoint()
        now = out.agg(F.sum("group")).first()[0]
        if now == total:
            return out
        total = now


def liberties(grouped: DataFrame, colour: str, empty: str = "empty") -> DataFrame:
    """t, group, liberties: distinct empty neighbours of each group that isn't empty itself."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    stones = grouped.where(F.col(colour) != empty).withColumn("m", moves).select("t", "group", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"))
    free = grouped.where(F.col(colour) == empty).select("t", "y", "x", F.lit(1).alias("free"))
    return stones.join(free, ["t", "y", "x"], "left").groupBy("t", "group").agg(F.count_distinct(F.when(F.col("free") == 1, F.col("y") * 9 + F.col("x"))).alias("liberties"))
