"""Palettes: histograms, top colours, orders, set operations, merges, banks and bindings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import bucket332, bucket_centre, lab, luma_milli, pack, unpack, with_delta_e2000

SIZE = 256


def argb(df: DataFrame) -> DataFrame:
    return df.withColumn("argb", pack(F.col("r"), F.col("g"), F.col("b"), None))


def histogram(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """argb, weight, n: partial sums before the shuffle, one row a colour."""
    w = weight if weight is not None else F.lit(1)
    return argb(df).groupBy("argb").agg(F.sum(w).cast("long").alias("weight"), F.count("*").alias("n"))


def colours(df: DataFrame, weight: Column) -> DataFrame:
    """r, g, b, argb, weight: a row a colour, of channels from -256 to 255 (remainders by 256 may be negative), which are grouped as one number. Rows that lack a
    channel make one row without a colour."""
    key = sum(((F.col(c) + 256) * (1 << s) for c, s in zip("rgb", (18, 9, 0), strict=True)), F.lit(0))
    by_colour = df.groupBy(key.alias("key")).agg(F.sum(weight).cast("long").alias("weight"))
    r, g, b = (F.shiftright("key", s).bitwiseAND(F.lit(511)) - 256 for s in (18, 9, 0))
    return by_colour.select(r.alias("r"), g.alias("g"), b.alias("b"), "weight").withColumn("argb", F.expr("r * 65536L + g * 256 + b"))


def top(hist: DataFrame, k: int = SIZE, score: str = "weight") -> DataFrame:
    """The k colours of largest score (ties by colour), in order of luminance: idx, argb, r, g, b, weight. Of argb, or of argb, r, g, b. Luma is in the one
    projection on the limit, so that Spark keeps k rows a task; with a second one it would deal out and sort all colours."""
    rgb = tuple(F.col(c) for c in "rgb") if "r" in hist.columns else unpack(F.col("argb"))
    best = hist.orderBy(F.desc(score), "argb").limit(k).select("argb", score, *[v.alias(c) for c, v in zip("rgb", rgb, strict=True)], luma_milli(*rgb).alias("luma"))
    return _in_order(best).select("idx", "argb", "r", "g", "b", score)


def _in_order(palette: DataFrame) -> DataFrame:
    return palette.withColumn("idx", (F.row_number().over(Window.orderBy("luma", "argb")) - 1).cast("int"))


def by_luminance(palette: DataFrame) -> DataFrame:
    """Of at most a few hundred colours: idx from 0."""
    luma = luma_milli(F.col("r"), F.col("g"), F.col("b"))
    return _in_order(palette.withColumn("luma", luma))


def padded(palette: DataFrame, size: int = SIZE) -> DataFrame:
    """idx 0 to size - 1, black where the palette has none."""
    every = palette.sparkSession.range(size).select(F.col("id").cast("int").alias("idx"))
    return every.join(palette, "idx", "left").select("idx", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"])


def bucket_palette(df: DataFrame) -> DataFrame:
    """3-3-2 bits: mean colour of each of 256 buckets, the centre of an empty one, with its place by luminance of the centres."""
    means = df.groupBy(bucket332(F.col("r"), F.col("g"), F.col("b")).alias("bucket")).agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"], F.count("*").alias("n"))
    every = df.sparkSession.range(SIZE).select(F.col("id").cast("int").alias("bucket"))
    centre = dict(zip("rgb", bucket_centre(F.col("bucket")), strict=True))
    out = every.join(means, "bucket", "left").select("bucket", *[F.coalesce(c, centre[c]).cast("int").alias(c) for c in "rgb"], F.coalesce("n", F.lit(0)).cast("long").alias("n"), luma_milli(*centre.values()).alias("luma"))
    return out.withColumn("idx", (F.row_number().over(Window.orderBy("luma", "bucket")) - 1).cast("int")).drop("luma")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Colours of both, with the sum of their scores."""
    return a.alias("a").join(b.alias("b"), "argb").select("argb", (F.col("a.score") + F.col("b.score")).alias("score"))


def only(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("argb"), "argb", "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return only(a, b).select("argb", F.lit("a").alias("side")).unionByName(only(b, a).select("argb", F.lit("b").alias("side")))


def bounded(palette: DataFrame) -> DataFrame:
    """The palette; one of more than SIZE rows is an error when it is read."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    fits = F.when(F.col("__n") > SIZE, F.raise_error(F.lit(f"a palette of more than {SIZE} colours")).cast("boolean")).otherwise(True)
    return palette.limit(SIZE + 1).withColumn("__n", n).where(fits).drop("__n")


def similar_pairs(a: DataFrame, b: DataFrame, most: float = 5.0) -> DataFrame:
    """Pairs (a, b, delta) of colours under a CIEDE2000 of `most`; both are palettes of at most SIZE colours (more is an error), the second
    broadcast."""

    def in_lab(p: DataFrame, s: str) -> DataFrame:
        rgb = unpack(F.col("argb"))
        return p.select(F.col("argb").alias(s), *[v.alias(f"{s}{i}") for i, v in enumerate(lab(*rgb))])

    one, two = in_lab(bounded(a), "a"), in_lab(bounded(b), "b")
    met = with_delta_e2000(one.crossJoin(F.broadcast(two)), ("a0", "a1", "a2"), ("b0", "b1", "b2"), "delta")
    # the minimum of one row keeps the condition from being pushed into the join with all of the formula
    return met.groupBy("a", "b").agg(F.min("delta").alias("delta")).where(F.col("delta") < most)


#: Frames of a number of bits, beside the one before.
FRAMES = 62
_NONE = -(1 << 62)


def _frames_of_colours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's argb and frames as argb, block, bits: a row a colour and block of frames. Bit 0 is the frame before the block."""
    for b in batches:
        f, colour = b.column("f").to_numpy(), b.column("argb").to_numpy()
        block, at = np.divmod(f, FRAMES)
        last = at == FRAMES - 1  # it is the one before the next block, too
        colour, block, bits = np.r_[colour, colour[last]], np.r_[block, block[last] + 1], np.r_[np.int64(1) << (at + 1), np.ones(int(last.sum()), np.int64)]
        order = np.lexsort((block, colour))
        colour, block, bits = colour[order], block[order], bits[order]
        start = np.flatnonzero(np.r_[True, (colour[1:] != colour[:-1]) | (block[1:] != block[:-1])][: len(colour)])
        met = np.bitwise_or.reduceat(bits, start) if len(start) else bits
        yield pa.RecordBatch.from_arrays([pa.array(colour[start]), pa.array(block[start]), pa.array(met)], ["argb", "block", "bits"])


def _counted_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's colours: those of a frame and of the one before, and those of both."""
    for b in batches:
        block = b.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        block = block[order]
        start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
        if not len(start):
            continue
        n, both = (np.add.reduceat(np.unpackbits(b.column(c).to_numpy()[order].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), start, 0, np.int64) for c in ("bits", "both"))
        f = block[start, None] * FRAMES + np.arange(FRAMES)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (f, n[:, 1 : FRAMES + 1] + n[:, :FRAMES], both[:, 1 : FRAMES + 1])], ["f", "sides", "both"])


def transitions(df: DataFrame) -> DataFrame:
    """f, colours that come and go against the frame before, and 1 - their share of all. A colour's frames are bits of one number for each FRAMES of them, so that
    there is one shuffle (of batches' colours, so that a common one is no one task's) and as many rows as colours and blocks, however many voxels; a null colour is in no two frames."""
    here = argb(df).where("f IS NOT NULL").select(F.col("f").cast("long").alias("f"), F.coalesce(F.col("argb").cast("long"), F.lit(_NONE)).alias("argb"))
    last = df.agg(F.max("f")).first()[0]
    bits = here.mapInArrow(_frames_of_colours, "argb long, block long, bits long").repartition("argb").groupBy("argb", "block").agg(F.bit_or("bits").alias("bits"))
    bits = bits.withColumn("both", F.when(F.col("argb") == _NONE, F.lit(0).cast("long")).otherwise(F.col("bits").bitwiseAND(F.shiftleft("bits", 1))))
    k = bits.select("block", "bits", "both").mapInArrow(_counted_frames, "f long, sides long, both long").groupBy(F.col("f").cast("int").alias("f")).agg(F.sum("sides").alias("sides"), F.sum("both").alias("both"))
    out = k.where((F.col("f") > 0) & (F.col("f") <= (last if last is not None else 0)) & (F.col("sides") > 0))
    out = out.select("f", (F.col("sides") - 2 * F.col("both")).alias("changed"), (F.col("sides") - F.col("both")).alias("of"))
    return out.withColumn("stability", F.round(1 - F.col("changed") / F.col("of"), 6))


def quality(palette: DataFrame) -> DataFrame:
    octant = (F.col("r") > 127).cast("int") * 4 + (F.col("g") > 127).cast("int") * 2 + (F.col("b") > 127).cast("int")
    colour = pack(F.col("r"), F.col("g"), F.col("b"), None)
    return palette.agg((F.count_distinct(octant) / 8.0).alias("coverage"), F.count_distinct(colour).alias("colours"), F.round(F.count_distinct(colour) / F.count("*"), 6).alias("diversity"))


def bound(frames: DataFrame, n_palettes: int, how: str = "cycle", low: int = 0, uniform: int = 0, mapping: DataFrame | None = None) -> DataFrame:
    """frames (f) with the palette each is bound to: identity, uniform, cycle, or a map (f, ref) of which every ref must be there."""
    if how == "identity":
        ref = F.col("f")
    elif how == "uniform":
        ref = F.lit(uniform)
    elif how == "cycle":
        ref = low + F.col("f") % n_palettes
    else:
        ok = (F.col("ref") >= 0) & (F.col("ref") < n_palettes)
        return frames.join(mapping, "f", "left").withColumn("ref", F.when(F.coalesce(ok, F.lit(False)), F.col("ref")).otherwise(F.raise_error(F.lit("a frame has no palette, or one that isn't there"))))
    return frames.withColumn("ref", ref.cast("int"))


def dangling(frames: DataFrame, bank: DataFrame) -> DataFrame:
    """Frames whose palette isn't in the bank: none."""
    return frames.join(bank.select("ref").distinct(), "ref", "left_anti")


def remapped(frames: DataFrame, mapping: DataFrame) -> DataFrame:
    """ref by mapping (ref, new_ref); a ref without one is an error when the row is read."""
    new = F.coalesce("new_ref", F.raise_error(F.lit("no new palette for a frame")).cast("int"))
    return frames.join(mapping, "ref", "left").withColumn("ref", new).drop("new_ref")


def _after(df: DataFrame, name: str) -> int:
    """One more than the largest value, 0 where there is none."""
    top = df.agg(F.max(name)).first()[0]
    return 0 if top is None else top + 1


def banks_united(a: DataFrame, b: DataFrame, exponents: tuple[int, int]) -> tuple[DataFrame, int]:
    """Both banks (ref, ...) one after the other, and the offset of the second's refs."""
    if exponents[0] != exponents[1]:
        raise ValueError("banks of different sizes of palettes")
    offset = _after(a, "ref")
    return a.unionByName(b.withColumn("ref", F.col("ref") + offset)), offset


def streams_joined(a: DataFrame, b: DataFrame, ref_offset: int) -> DataFrame:
    """Frames of b after those of a, their refs moved as the bank's."""
    n = _after(a, "f")
    return a.unionByName(b.withColumn("f", F.col("f") + n).withColumn("ref", F.col("ref") + ref_offset))


def roles(palette: DataFrame) -> DataFrame:
    """One row: the colours that a theme takes from a palette of idx, r, g, b."""
    from ..functions.color import hsv, luma709

    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    p = palette.withColumns({"h": h, "s": s, "v": v, "light": luma709(F.col("r"), F.col("g"), F.col("b")) / 255.0, "argb": pack(F.col("r"), F.col("g"), F.col("b"), None)})
    loud = F.max_by("argb", F.struct(F.round(F.col("s") * F.col("v"), 9), -F.col("idx")))
    first = p.agg(loud.alias("primary"), F.max_by("h", F.struct(F.round(F.col("s") * F.col("v"), 9), -F.col("idx"))).alias("ph"), F.min_by("argb", F.struct("light", "idx")).alias("dark"), F.max_by("argb", F.struct("light", -F.col("idx"))).alias("light_"), F.avg("light").alias("mean"))
    p = p.crossJoin(F.broadcast(first.select(((F.col("ph") + 0.5) % 1).alias("across"))))

    def near(target: Column, floor: float) -> Column:
        return F.min_by("argb", F.struct(F.when(F.col("s") >= floor, F.round(F.abs(F.col("h") - target), 9)).otherwise(9.0), "idx"))

    def by_hue(target: float, floor: float, default: int) -> Column:
        return F.when(F.count_if(F.col("s") >= floor) > 0, near(F.lit(target), floor)).otherwise(F.lit(default))

    rest = p.agg(near(F.col("across"), 0.0).alias("secondary"), by_hue(0.33, 0.4, 0x34C759).alias("success"), by_hue(0.15, 0.5, 0xFF9500).alias("warning"), by_hue(0.0, 0.6, 0xFF3B30).alias("error"))
    both = first.crossJoin(rest)
    return both.select("primary", "secondary", "success", "warning", "error", "dark", F.col("light_").alias("light"), F.when(F.col("mean") > 0.5, F.col("light_")).otherwise(F.col("dark")).alias("background"))


def ramp_palette(spark: SparkSession, name: str) -> DataFrame:
    from ..functions.color import ramp

    p = spark.range(SIZE).select(F.col("id").cast("int").alias("idx"))
    r, g, b = ramp(name, F.col("idx"))
    return p.select("idx", r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def conveyor(cube: DataFrame, palette_size: int, shift: int = 1) -> DataFrame:
    """Indices moved on by the frame's number: a palette that runs through the frames."""
    return cube.withColumn("idx", ((F.col("idx") + F.col("f") * shift) % palette_size).cast("int"))


def override_frames(errors: DataFrame, threshold: float, most: int) -> DataFrame:
    """f of the frames that get a palette of their own: the first `most`, in order, whose error is over the threshold."""
    return errors.where(F.col("error") > threshold).withColumn("turn", F.row_number().over(Window.orderBy("f"))).where(F.col("turn") <= most).select("f")


def sources_of_cells(cells: DataFrame) -> DataFrame:
    """cell with the ranges of frames, rows and columns it is made of (both ends in)."""
    return cells.select("cell", *[x for c, n in (("t", "f"), ("y", "y"), ("x", "x")) for x in ((F.col(c) * 9).cast("int").alias(f"{n}_first"), (F.col(c) * 9 + 8).cast("int").alias(f"{n}_last"))])


def most_common(indexed: DataFrame, top: int, index: str = "idx") -> DataFrame:
    """One row: the commonest indices with their counts, as [index]=count, ties by index."""
    n = indexed.groupBy(index).agg(F.count("*").alias("n")).orderBy(F.desc("n"), index).limit(top)
    e = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(index).alias("i"))))  # top rows
    return n.agg(F.array_join(F.transform(e, lambda x: F.concat(F.lit("["), x["i"].cast("string"), F.lit("]="), (-x["k"]).cast("string"))), ", ").alias("common"))


def not_black(palette: DataFrame, least: int = 5) -> DataFrame:
    """One row: colours of a palette of which a channel is above least."""
    return palette.agg(F.count_if(F.greatest("r", "g", "b") > least).alias("not_black"))
