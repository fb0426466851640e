"""Nearest-colour joins. A palette of at most SIZE
colours (it is written and counted first) goes to the tasks, which multiply their rows by it; a larger one of any size is met cell by cell of a grid."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.color import pack, squared_distance
from ..runtime import kept

SIZE = 256
#: A cell's side is 2 to one of these; the widest leaves two cells on an axis, so that all are neighbours.
FINEST, WIDEST = 2, 7


def _small(palette: DataFrame) -> DataFrame:
    """The palette to broadcast; one of more than SIZE rows is an error when it is read."""
    p = palette.limit(SIZE + 1).select("idx", *[F.col(c).alias(f"p{c}") for c in "rgb"])
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    fits = F.when(F.col("n") > SIZE, F.raise_error(F.lit(f"a palette of more than {SIZE} colours")).cast("boolean")).otherwise(True)
    return F.broadcast(p.withColumn("n", n).where(fits).drop("n"))


def _packed(palette: DataFrame) -> Column:
    """idx, r, g, b in one number."""
    return (F.col("idx").cast("long") * (1 << 24) + F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("__p")


def _least(colours: DataFrame, lists: str) -> DataFrame:
    """r, g, b, idx, dist: the least squared distance to the numbers of a list, the least idx of equals; nulls without a list."""

    def key(p: Column) -> Column:
        away = squared_distance(tuple(F.col(c) for c in "rgb"), tuple(F.shiftright(p, s).bitwiseAND(F.lit(255).cast("long")) for s in (16, 8, 0)))
        return away.cast("long") * (1 << 32) + F.shiftright(p, 24)

    met = colours.withColumn("__key", F.array_min(F.transform(lists, key)))
    return met.select("r", "g", "b", F.col("__key").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("idx"), F.shiftright("__key", 32).alias("dist"))


def _colours_of(palette: DataFrame) -> np.ndarray:
    """idx, r, g, b in order of idx, of a counted palette of at most SIZE colours."""
    return np.array(sorted(tuple(r) for r in palette.select("idx", "r", "g", "b").collect()), np.int64).reshape(-1, 4)


def _by_product(voxels: DataFrame, p: np.ndarray) -> DataFrame:
    """voxels with idx and dist, where they have a colour. A task multiplies a batch's rows by the palette: |p|² - 2 c p is least for the nearest colour, and its whole
    numbers are exact, for bytes in single precision. No shuffle, and no row for a pair."""
    idx, colours = p[:, 0], p[:, 1:]
    turned, sizes = np.ascontiguousarray(-2 * colours.T), (colours * colours).sum(1)
    bytes_ = bool(((colours >= 0) & (colours <= 255)).all())
    schema = T.StructType([*(f for f in voxels.schema if f.name not in ("idx", "dist")), T.StructField("idx", T.IntegerType()), T.StructField("dist", T.LongType())])
    names = [f.name for f in schema][:-2]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in "rgb"], 1)
            kind = np.float32 if bytes_ and len(c) and c.min() >= 0 and c.max() <= 255 else np.float64
            c, by, size = c.astype(kind), turned.astype(kind), sizes.astype(kind)
            best, dist = np.empty(len(c), np.int64), (c * c).sum(1)
            for at in range(0, len(c), 1024):  # a piece's distances stay in the cache
                away = c[at : at + 1024] @ by
                away += size
                k = best[at : at + 1024] = away.argmin(1)  # the first of equals, so the least idx
                dist[at : at + 1024] += away[np.arange(len(k)), k]
            found = [pa.array(idx[best].astype(np.int32)), pa.array(dist.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *found], [f.name for f in schema])

    return voxels.where(" AND ".join(f"{c} IS NOT NULL" for c in "rgb")).mapInArrow(met, schema)


def _by_grid(colours: DataFrame, palette: DataFrame, n: int) -> DataFrame:
    """Each palette colour stands in its cell of a grid and the 26 around it, so a colour meets all that lie within a cell's side of it by an
    equi-join on its own cell. If the best is no farther than that, nothing outside is nearer; the other colours go on to a grid of twice the side.
    The first grid has about one palette colour a cell."""
    one = palette.groupBy("r", "g", "b").agg(F.min("idx").alias("idx"))
    open_, done = colours, None
    for shift in range(min(WIDEST, max(FINEST, 8 - round(math.log2(n) / 3))), WIDEST + 1):
        side, most = 1 << shift, 255 >> shift
        around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", (i // 9 - 1, i // 3 % 3 - 1, i % 3 - 1), strict=True)]) for i in range(27)]))
        near = one.select(_packed(one), *[F.shiftright(c, shift).alias(f"c{c}") for c in "rgb"], around.alias("d"))
        near = near.select("__p", *[(F.col(f"c{c}") + F.col(f"d.{d}")).alias(f"c{c}") for c, d in zip("rgb", "xyz", strict=True)])
        lists = near.where(" AND ".join(f"c{c} BETWEEN 0 AND {most}" for c in "rgb")).groupBy("cr", "cg", "cb").agg(F.collect_list("__p").alias("__near"))
        met = open_.withColumns({f"c{c}": F.shiftright(c, shift) for c in "rgb"}).join(lists, ["cr", "cg", "cb"], "left")
        met = kept(_least(met, "__near"), "nearest")
        settled = F.lit(True) if shift == WIDEST else F.coalesce(F.col("dist") < (side + 1) ** 2, F.lit(False))
        done = met.where(settled) if done is None else done.unionByName(met.where(settled))
        open_ = met.where(~settled).select("r", "g", "b")
        if shift < WIDEST and open_.isEmpty():
            break
    return done


def _counted(palette: DataFrame) -> tuple[DataFrame, int]:
    p = kept(palette.select("idx", "r", "g", "b").where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL"), "palette")
    return p, p.count()


def best(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """colours (distinct r, g, b) with idx and dist (squared) of the nearest palette colour, the least idx of equals; exact. An empty palette
    has no nearest colour, so that no row is left."""
    p, n = _counted(palette)
    if n > SIZE:
        return _by_grid(colours, p, n)
    found = _by_product(colours.select("r", "g", "b"), _colours_of(p) if n else np.zeros((1, 4)))
    return found if n else found.limit(0)


def nearest(voxels: DataFrame, palette: DataFrame) -> DataFrame:
    """voxels with idx and dist, exact: a small palette meets all of them in place, a larger one meets their distinct colours."""
    p, n = _counted(palette)
    if n > SIZE:
        return voxels.join(_by_grid(voxels.select("r", "g", "b").distinct(), p, n), ["r", "g", "b"])
    found = _by_product(voxels, _colours_of(p) if n else np.zeros((1, 4)))
    return found if n else found.limit(0)


def lookup_table(palette: DataFrame) -> DataFrame:
    """4 096 rows: idx of the palette colour nearest to the centre of each bucket of 4 bits a channel."""
    i = F.col("id")
    centres = palette.sparkSession.range(4096).select(*[(F.shiftright(i, s).bitwiseAND(F.lit(15).cast("long")) * 16 + 8).cast("int").alias(c) for c, s in zip("rgb", (8, 4, 0), strict=True)])
    b = best(centres, palette)
    return b.select(*[F.shiftright(c, 4).alias(f"k{c}") for c in "rgb"], "idx")


def by_lookup(voxels: DataFrame, palette: DataFrame) -> DataFrame:
    """voxels with the idx of their bucket: an equi-join with a table of 4 096 rows, for any number of voxels."""
    lut = F.broadcast(lookup_table(palette))
    keyed = voxels.withColumns({f"k{c}": F.shiftright(c, 4) for c in "rgb"})
    return keyed.join(lut, ["kr", "kg", "kb"]).drop("kr", "kg", "kb")


def reconstructed(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """indexed (r, g, b, idx) with the palette's colour as pr, pg, pb. Small palettes are broadcast, as Spark sees their size."""
    return indexed.join(palette.select("idx", *[F.col(c).alias(f"p{c}") for c in "rgb"]), "idx")


def errors(recon: DataFrame) -> DataFrame:
    """One row: MSE, PSNR (infinite at 0), mean and largest absolute error, share of pixels within 25 in every channel."""
    gaps = {c: F.abs(F.col(c) - F.col(f"p{c}")) for c in "rgb"}
    square = sum((g * g for g in gaps.values()), F.lit(0)).cast("long")
    top = F.greatest(*gaps.values())
    s = recon.agg(F.count("*").alias("n"), F.sum(square).alias("square"), F.sum(sum(gaps.values(), F.lit(0)).cast("long")).alias("gap"), F.max(top).alias("largest"), F.count_if(top <= 25).alias("close"))
    mse = F.col("square") / (3.0 * F.col("n"))
    return s.select("n", F.round(mse, 6).alias("mse"), F.round(F.when(mse == 0, float("inf")).otherwise(10 * F.log10(65025.0 / mse)), 6).alias("psnr"), F.round(F.col("gap") / (3.0 * F.col("n")), 6).alias("mean_error"), F.col("largest").cast("int").alias("largest"), F.round(F.col("close") / F.col("n"), 6).alias("close"))


def distances(palette: DataFrame) -> DataFrame:
    """Upper triangle of the squared distances of a palette."""
    return palette.select("idx", "r", "g", "b").join(_small(palette.withColumnRenamed("idx", "other").withColumnRenamed("other", "idx")).withColumnRenamed("idx", "other"), F.col("idx") < F.col("other")).select("idx", "other", squared_distance(tuple(F.col(c) for c in "rgb"), tuple(F.col(f"p{c}") for c in "rgb")).alias("dist"))


def index_by_luma(y: DataFrame, palette: DataFrame) -> DataFrame:
    """y (luma 0 to 255) to the idx of the palette's nearest grey, for the 256 values."""
    luma = F.expr("(pr * 299 + pg * 587 + pb * 114)")
    met = y.crossJoin(_small(palette))
    return met.groupBy("y").agg(F.min(F.struct(F.abs(F.col("y") * 1000 - luma).alias("d"), "idx")).alias("m")).select("y", F.col("m.idx").alias("idx"))


def used(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("idx").agg(F.count("*").alias("n"), F.count_distinct(pack(F.col("r"), F.col("g"), F.col("b"), None)).alias("colours"))
