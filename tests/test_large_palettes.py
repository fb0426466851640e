"""Palettes of any size: nearest colours by a grid, octrees by sums, against plain searches."""

import random

import numpy as np
import pytest

from cubelume.operators import grouped as G
from cubelume.operators import nearest as N
from cubelume.operators import trees as T


def frame(spark, rows, names="r int, g int, b int"):
    return spark.createDataFrame([tuple(map(int, r)) for r in rows], names)


def plain(colours, palette):
    """(r, g, b) -> (dist, idx) by all distances."""
    p = np.array([q[1:] for q in palette], np.int64)
    idx = np.array([q[0] for q in palette], np.int64)
    out = {}
    for c in colours:
        d = ((p - np.array(c)) ** 2).sum(1)
        out[tuple(map(int, c))] = min(zip(d.tolist(), idx.tolist(), strict=True))
    return out


PALETTES = {
    "all over": lambda r: r.integers(0, 256, (5000, 3)),
    "in a corner": lambda r: r.integers(0, 20, (1500, 3)),
    "in two places": lambda r: np.concatenate([r.integers(0, 9, (300, 3)), r.integers(247, 256, (300, 3))]),
    "one colour many times": lambda r: np.full((400, 3), 77),
}


@pytest.mark.parametrize("name", PALETTES)
def test_nearest_of_many(spark, name):
    r = np.random.default_rng(1)
    p = [(i * 3 + 1, *map(int, c)) for i, c in enumerate(PALETTES[name](r))]
    r.shuffle(p)
    colours = {tuple(map(int, c)) for c in np.concatenate([r.integers(0, 256, (600, 3)), [[0, 0, 0], [255, 255, 255], [255, 0, 255]], np.array(p)[:40, 1:]])}
    found = N.best(frame(spark, colours), frame(spark, p, "idx int, r int, g int, b int"))
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert {(x.r, x.g, x.b): (x.dist, x.idx) for x in found.collect()} == plain(colours, p)


def test_nearest_with_few_none_and_null(spark):
    colours = frame(spark, [(1, 2, 3), (200, 0, 9)])
    p = spark.createDataFrame([(7, 0, 0, 0), (5, 2, 2, 2), (6, None, 1, 1)], "idx int, r int, g int, b int")
    assert {(x.r, x.idx, x.dist) for x in N.best(colours, p).collect()} == {(1, 5, 2), (200, 5, 198**2 + 4 + 49)}
    assert N.best(colours, p.limit(0)).count() == 0


@pytest.mark.parametrize("low", [False, True])
@pytest.mark.parametrize("k", [1, 2, 16, 200])
def test_octree_by_sums(spark, k, low):
    dice = random.Random(k)
    rows = []
    for group, (n, top) in {"many": (1500, 256), "dark": (400, 9), "few": (5, 256), "one": (1, 256), None: (60, 64)}.items():
        rows += [(group, *(dice.randrange(top) for _ in range(3)), dice.randrange(1, 50)) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("few", None, 1, 1, 5)], "part string, r int, g int, b int, w long")
    got = {}
    for x in T.octree(df, ["part"], k, "w", low).orderBy("part", "idx").collect():
        got.setdefault(x.part, []).append((x.r, x.g, x.b))
    for group in {x[0] for x in rows}:
        counts = {}
        for part, r, g, b, w in rows:
            if part == group:
                counts[r, g, b] = counts.get((r, g, b), 0) + w
        assert got[group] == G.octree([(*c, n) for c, n in counts.items()], k, low), group


def test_octree_of_all_rows_and_of_none(spark):
    dice = random.Random(3)
    rows = [tuple(dice.randrange(256) for _ in range(3)) for _ in range(700)]
    got = [(x.r, x.g, x.b) for x in T.octree(frame(spark, rows + rows[:90]), [], 32).orderBy("idx").collect()]
    counts = {c: 0 for c in rows}
    for c in rows + rows[:90]:
        counts[c] += 1
    assert got == G.octree([(*c, n) for c, n in counts.items()], 32)
    assert T.octree(frame(spark, []), [], 4).count() == 0 and T.octree(frame(spark, []).selectExpr("*", "1 AS p"), ["p"], 4).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 16, 40])
def test_median_cut_by_rounds(spark, k):
    dice = random.Random(k)
    rows = []
    for group, (n, top) in {"many": (900, 256), "dark": (300, 5), "few": (5, 256), "one": (1, 256), None: (60, 64)}.items():
        rows += [(group, dice.randrange(top), dice.randrange(1 + top // 3), dice.randrange(top), dice.randrange(1, 50)) for _ in range(n)]
    rows += [("chain", 2**i, 0, 0, 1) for i in range(8)] + [("heavy", 9, 9, 9, 1000), ("heavy", 10, 0, 0, 1), ("heavy", 3, 0, 0, 1)]
    df = spark.createDataFrame([*rows, ("few", None, 1, 1, 5)], "part string, r int, g int, b int, w long")
    got = {}
    for x in T.median_cut(df, ["part"], k, "w").orderBy("part", "idx").collect():
        got.setdefault(x.part, []).append((x.r, x.g, x.b))
    for group in {x[0] for x in rows}:
        counts = {}
        for part, r, g, b, w in rows:
            if part == group:
                counts[r, g, b] = counts.get((r, g, b), 0) + w
        assert got[group] == G.median_cut([(*c, n) for c, n in counts.items()], k), group


def test_median_cut_of_none(spark):
    assert T.median_cut(frame(spark, []), [], 4).count() == 0


@pytest.mark.parametrize("held", [2048, 2])
def test_median_cut_in_place_equals_that_by_joins(spark, monkeypatch, held):
    """Of unweighted bytes: no table of colours is joined or rewritten, whatever the number of boxes a task counts at once."""
    monkeypatch.setattr(T, "HELD", held)
    rows = [(i % 3 or None, i * i % 256, i * 37 % 256 // (1 + i % 3 * 60), 7 if i % 3 == 1 else i * 91 % 256) for i in range(3000)] + [(4, 9, 9, 9), (5, None, 1, 1)]
    df = spark.createDataFrame(rows, "part int, r int, g int, b int")
    want = sorted(map(tuple, T._median_cut_by_joins(df, ["part"], 7).collect()), key=str)
    with monkeypatch.context() as m:
        m.setattr(T, "_beside", None)
        assert sorted(map(tuple, T.median_cut(df, ["part"], 7).collect()), key=str) == want
    assert len(want) == 22
