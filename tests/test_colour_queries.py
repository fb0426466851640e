"""What the SQL twins of colour queries can't say, against plain Python."""

import numpy as np
import pytest
from oracle import TABLES, same
from pyspark.sql import functions as F

from cubelume.operators import digests as D
from cubelume.operators import grouped as G
from cubelume.operators import palettes as P
from cubelume.operators import spatial as S
from cubelume.operators import windows as W
from cubelume.plans import catalog


def cubic(b, c):
    def k(t):
        t = abs(t)
        if t < 1:
            return (2 - 1.5 * b - c) * t**3 + (-3 + 2 * b + c) * t**2 + 1 - b / 3
        return (-b / 6 - c) * t**3 + (b + 5 * c) * t**2 + (-2 * b - 8 * c) * t + 4 * b / 3 + 4 * c if t < 2 else 0

    return k


KERNELS = {"bicubic": (cubic(0, 0.5), 2), "mitchell": (cubic(1 / 3, 1 / 3), 2), "hermite": (lambda t: 1 - 3 * t * t + 2 * abs(t) ** 3 if abs(t) < 1 else 0, 1)}


@pytest.mark.parametrize("method", sorted(KERNELS))
def test_resampled_frame(spark, method):
    rng, side, out = np.random.default_rng(5), 20, 6
    image = rng.integers(0, 256, (side, side, 3))
    kernel, reach = KERNELS[method]
    scale = side / out
    m = np.zeros((out, side))
    for o in range(out):
        centre = (o + 0.5) * scale - 0.5
        for s in range(int(centre - reach * scale) - 2, int(centre + reach * scale) + 3):
            m[o, min(side - 1, max(0, s))] += kernel((s - centre) / scale)
    m /= m.sum(1, keepdims=True)
    want = np.clip(np.einsum("oy,yxc,px->opc", m, image, m), 0, 255)
    px = spark.createDataFrame([(0, y, x, *map(int, image[y, x])) for y in range(side) for x in range(side)], "f int, y int, x int, r int, g int, b int")
    rows = S.resampled(px, side, out, method).collect()
    assert len(rows) == out * out and all(abs(v - want[r.y, r.x, i]) <= 1 for r in rows for i, v in enumerate((r.r, r.g, r.b)))


def test_methods_by_scale():
    assert [S.resampler(81, n) for n in (9, 10, 16, 21, 40, 41, 81, 100)] == ["box", "box", "mitchell", "bicubic", "bicubic", "lanczos3", "lanczos3", "lanczos3"]


def test_dual_palette_flow(spark, sf_dir):
    r = catalog.QUERIES["q_dual_palette_flow"](spark, sf_dir).first()
    assert (r.cells, r.valid, r.width, r.height, r.frames) == (729, True, 81, 81, 81)
    assert r["global"] + r.localised == r.colours == r.stable + r.transient
    assert r.exact <= min(r.spatial, r.temporal) and r.exact + r.similar <= r.final <= 256


def test_merge_of_palettes(spark):
    a = spark.createDataFrame([(0x000000, 9), (0x0A0000, 5), (0x00FF00, 3)], "argb long, score long")
    b = spark.createDataFrame([(0x000000, 4), (0x0B0000, 7), (0x0000FF, 2)], "argb long, score long")
    got = {r.argb: r.kind for r in D.merged_palettes(a, b).collect()}
    assert got == {0x000000: 0, 0x0A0000: 1, 0x00FF00: 2, 0x0000FF: 2}


def test_digest_of_a_flat_cube(spark):
    cube = spark.range(729).selectExpr("cast(id div 81 as int) f", "cast(id div 9 % 9 as int) y", "cast(id % 9 as int) x", "128 r", "128 g", "128 b")
    r = D.digests(cube).first()
    assert sum(r.luminance) == r.luminance[4] == 1 and sum(r.hue) == 0 and r.saturation[0] == 1
    assert set(r.change) == {0.0} and set(r.stability) == {1.0} and set(r.contrast) == {0.0} and (r.activity, r.light) == (0.0, 0.5)
    assert D.digests(cube.limit(0)).count() == 0


def test_folds_by_blocks_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    v = rng.random(500)
    df = spark.createDataFrame([(int(i), float(x), "hot") for i, x in enumerate(v)], "i long, v double, key string")
    q, s, x, vel = 0.5, 0.0, 0.0, 0.0
    for g in v:
        q = q * 0.9 + g * 0.1
        vel = vel * 0.9 + g
        x += vel * 0.01
        s = s * 0.9 + g * g * (1 - 0.9)
    for size in (1, 7, 1000):
        block = F.floor(F.col("i") / size)
        e = W.folded(df, "v", ["i"], "key", alpha=0.1, block=block).first()
        assert e.ewma == pytest.approx(q, rel=1e-12) and e.n == 500
        m = W.momentum(df, "v", ["i"], "key", block=block).first()
        assert (m.velocity, m.position, m.fisher) == pytest.approx((vel, x, s), rel=1e-10)


def test_palettes_of_too_many_colours_are_errors(spark):
    big = spark.range(300).select(F.col("id").alias("argb"), F.lit(1).alias("score"))
    with pytest.raises(Exception, match="more than 256 colours"):
        P.similar_pairs(big, big.limit(3)).collect()
    with pytest.raises(ValueError, match="more than 256 colours"):
        G.argb_list(spark.range(300).selectExpr("cast(id as int) idx", "0 r", "0 g", "0 b"))


@pytest.fixture(scope="module")
def greys(spark, sf_dir, tmp_path_factory):
    """A table whose voxels are all black: no cell has a hue."""
    d = tmp_path_factory.mktemp("greys")
    for t in set(TABLES) - {"lineitem"}:
        (d / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    rows = spark.range(81 * 81).selectExpr("id * 256 AS l_orderkey", "id % 81 * 256 AS l_partkey", "id div 81 * 256 AS l_suppkey", "0 AS l_linenumber")
    rows.write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def test_content_without_any_hue(spark, greys):
    r = catalog.QUERIES["q_content_features"](spark, greys).first()
    assert (r.hue, r.hue_spread, r.mean_s) == (0.0, 0.0, 0.0)
    same(catalog.QUERIES["q_content_features"](spark, greys), catalog.ORACLE["q_content_features"], greys)


def test_scores_of_content_without_any_hue(spark, greys):
    same(catalog.QUERIES["q_content_scores"](spark, greys), catalog.ORACLE["q_content_scores"], greys)
