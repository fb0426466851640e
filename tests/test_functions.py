import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubelume.functions import color, gif, lzw, vectors
from cubelume.operators import grouped, nearest, palettes, spatial, windows
from cubelume.sources.cubes import PATTERNS, dense_cube


# published pairs (Sharma, Wu, Dalal 2005)
@pytest.mark.parametrize("one, two, want", [
    ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, -1, 2), (50, 0, 0), 2.3669),
    ((50, 2.49, -0.001), (50, -2.49, 0.0009), 7.1792), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
    ((50, 0, 0), (50, 0, 0), 0.0), ((63.0109, -31.0961, -5.8663), (62.8187, -29.7946, -4.0864), 1.2630),
])
def test_ciede2000(spark, one, two, want):
    df = spark.createDataFrame([(*map(float, one), *map(float, two))], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double")
    got = color.with_delta_e2000(df, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "d").first().d
    assert got == pytest.approx(want, abs=1e-4)


def test_hsv_round_trip(spark):
    df = spark.range(4096).select(*[(F.shiftright("id", s).bitwiseAND(F.lit(15).cast("long")) * 17).cast("int").alias(c) for c, s in zip("rgb", (8, 4, 0), strict=True)])
    for there, back in ((color.hsv, color.hsv_to_rgb), (color.hsl, color.hsl_to_rgb)):
        via = df.select("r", "g", "b", *[x.alias(n) for x, n in zip(there(F.col("r"), F.col("g"), F.col("b")), "xyz", strict=True)])
        out = back(F.col("x"), F.col("y"), F.col("z"))
        assert via.where(sum((F.abs(o - F.col(c)) for o, c in zip(out, "rgb", strict=True)), F.lit(0)) > 3).count() == 0


def test_hex_and_pack(spark):
    df = spark.createDataFrame([(1, 171, 255)], "r int, g int, b int")
    h = color.hex_of(F.col("r"), F.col("g"), F.col("b"))
    r = df.select(h.alias("h"), *[c.alias(n) for c, n in zip(color.from_hex(h), "xyz", strict=True)], color.pack(F.col("r"), F.col("g"), F.col("b")).alias("p")).first()
    assert (r.h, r.x, r.y, r.z, r.p) == ("#01ABFF", 1, 171, 255, 0xFF01ABFF)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([2, 4, 8]))
def test_lzw(data, bits):
    data = bytes(b & ((1 << bits) - 1) for b in data)
    assert lzw.decode(lzw.encode(data, bits), bits) == data


@pytest.mark.parametrize("n", [6561, 70_000])
def test_lzw_clears_its_table(n):
    r = random.Random(n)
    data = bytes(r.randrange(256) for _ in range(n))
    assert lzw.decode(lzw.encode(data)) == data


def test_gif_round_trip_and_reports():
    r = random.Random(1)
    p = [(i, 255 - i, i // 2) for i in range(256)]
    g = gif.Gif(9, 9, p, [gif.Frame(bytes(r.randrange(256) for _ in range(81)), 5, palette=p[::-1] if k == 2 else None) for k in range(4)])
    data = gif.write(g)
    assert [f.indices for f in gif.read(data).frames] == [f.indices for f in g.frames]
    assert gif.report(data)["valid"] and gif.report(data)["local_tables"] == 1
    again = gif.read(gif.mux(*gif.demux(data)))
    assert [(f.indices, f.delay) for f in again.frames] == [(f.indices, f.delay) for f in g.frames] and again.frames[2].palette == p[::-1]
    assert not gif.report(data[:-40])["valid"] and not gif.report(b"")["valid"] and not gif.report(b"GIF89a")["valid"]
    assert gif.read(gif.swapped(data, p[::-1])).palette == p[::-1]
    with pytest.raises(ValueError):
        gif.swapped(data, p[:4])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(0, 255)] * 3), max_size=20), max_size=5))
def test_bank_round_trip(bank):
    assert gif.read_bank(gif.write_bank(bank, "é"))[1] == bank


def test_quantisers_and_selection():
    colours = [(i * 7 % 256, i * 13 % 256, i * 29 % 256, 1 + i % 5) for i in range(500)]
    colours = [(*c, n) for c, n in {c[:3]: c[3] for c in colours}.items()]
    for make in (grouped.octree, grouped.median_cut):
        p = make(colours, 32)
        assert 0 < len(p) <= 32 and all(0 <= v <= 255 for c in p for v in c)
        assert make(colours[:5], 32) and len(make(colours[:5], 32)) <= 5 and make([], 4) == []
    assert len(grouped.octree(colours, 32, True)) <= 32


def test_dither_keeps_exact_colours():
    palette = np.array([[0, 0, 0], [255, 255, 255]], float)
    image = np.zeros((5, 5, 3))
    image[2:] = 255
    assert (grouped.dither(image, palette) == (image[:, :, 0] > 0)).all()
    grey = grouped.dither(np.full((16, 16, 3), 128.0), palette)
    assert abs(grey.mean() - 0.5) < 0.05


def test_patterns_are_dense(spark):
    for name in PATTERNS:
        r = dense_cube(spark, name, 9).agg(F.count("*").alias("n"), F.min(F.least("r", "g", "b")).alias("lo"), F.max(F.greatest("r", "g", "b")).alias("hi")).first()
        assert r.n == 729 and 0 <= r.lo and r.hi <= 255


def test_nearest_is_exact_and_first(spark):
    p = spark.createDataFrame([(0, 0, 0, 0), (1, 10, 0, 0), (2, 10, 0, 0)], "idx int, r int, g int, b int")
    v = spark.createDataFrame([(5, 0, 0), (6, 0, 0), (200, 9, 9)], "r int, g int, b int")
    assert {(r.r, r.idx) for r in nearest.nearest(v, p).collect()} == {(5, 0), (6, 1), (200, 1)}


def test_interpolation_edges(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0), (2, None), (3, 6.0), (4, None)], "t int, v double").withColumn("g", F.lit(1))
    assert [r.filled for r in windows.interpolated(df, "v", "t", "g").orderBy("t").collect()] == [2.0, 2.0, 4.0, 6.0, 6.0]
    none = df.withColumn("v", F.lit(None).cast("double"))
    assert {r.filled for r in windows.interpolated(none, "v", "t", "g", fallback=F.lit(1 / 81)).collect()} == {1 / 81}


def test_allocation_sums(spark):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([5, 1, 1, 0, 9, 2])], "k int, w double")
    for total in (7, 18, 100):
        assert windows.largest_remainder(df, "w", "k", total).agg(F.sum("allocated")).first()[0] == total


def test_slerp_ties(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    s, t = df.select(vectors.slerp(F.col("a"), F.col("b"), 0.5).alias("s"), vectors.ties(F.array(F.lit(1.0), F.lit(-2.0), F.lit(0.1)), F.array(F.lit(-1.0), F.lit(-4.0), F.lit(0.2)), 0.6).alias("t")).first()
    assert s == pytest.approx([math.sqrt(0.5)] * 2)
    assert t == pytest.approx([-1.0, -3.0, 0.0])  # a tie of signs is negative


def test_ssim_bounds(spark):
    for side, windows_ in ((81, 361), (80, 324)):
        c = dense_cube(spark, "rings", side).where("f = 0")
        r = spatial.ssim(c, c, side).first()
        assert (r.ssim, r.windows) == (1.0, windows_)


def test_resamplers_keep_flat_colours(spark):
    flat = dense_cube(spark, "solid", 27).where("f = 2")
    for f in (spatial.bilinear, spatial.lanczos3, spatial.box):
        assert {tuple(r) for r in f(flat, 27, 10).select("r", "g", "b").distinct().collect()} == {(6, 128, 234)}


def test_bindings(spark):
    f = spark.createDataFrame([(0,), (1,)], "f int")
    with pytest.raises(Exception, match="palette"):
        palettes.bound(f, 2, "map", mapping=spark.createDataFrame([(0, 1)], "f int, ref int")).collect()
    with pytest.raises(ValueError):
        palettes.banks_united(f, f, (8, 7))


def test_banks_and_streams_of_one_are_not_mixed_up(spark):
    from cubelume.operators import palettes as P

    bank = spark.createDataFrame([(0, 0, 9)], "ref int, idx int, r int")
    both, offset = P.banks_united(bank, bank, (8, 8))
    assert offset == 1 and sorted(r.ref for r in both.collect()) == [0, 1]
    frames = spark.createDataFrame([(0, 0)], "f int, ref int")
    assert sorted((r.f, r.ref) for r in P.streams_joined(frames, frames, offset).collect()) == [(0, 0), (1, 1)]
    assert P.banks_united(bank.where("ref > 5"), bank, (8, 8))[1] == 0
