"""Views of a cube as planes, games, the choice of weights, galleries, captures and look-ups against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cubelume.operators import boards as B
from cubelume.operators import cells as C
from cubelume.operators import palettes as P
from cubelume.sources import files as S
from cubelume.sources.cubes import from_rows

CELLS = "cell int, t int, y int, x int, r int, g int, b int, w long, n long"


@pytest.fixture(scope="module")
def cube():
    dice = random.Random(5)
    out = []
    for t in range(9):
        for y in range(9):
            for x in range(9):
                if dice.random() < 0.9:  # some places have few cells, some none
                    calm = y < 4
                    out.append((t * 81 + y * 9 + x, t, y, x, *(dice.randrange(100, 110) if calm else dice.choice([0, 255]) for _ in "rgb"), dice.choice([0, 3, 700]), 1))
    return [c for c in out if (c[2], c[3]) != (8, 8)]


def plain_view(cube, view):
    groups = defaultdict(list)
    for _, t, y, x, r, g, b, w, _ in cube:
        if w:
            for place in [y * 9 + x] if view == "spatial" else [t * 9 + i for i in range(9)]:
                groups[place].append((r, g, b, w))
    out = {}
    for place in range(81):
        c = groups.get(place)
        if not c:
            out[place] = (0.0, 0.0)
            continue
        w = sum(v[3] for v in c)
        m = [sum(v[i] * v[3] for v in c) / w for i in range(3)]
        var = sum((v[i] - m[i]) ** 2 for v in c for i in range(3)) / (3 * len(c))
        out[place] = (sum(m) / 765, min(1.0, var / 16384))
    return out


@pytest.mark.parametrize("view", ["spatial", "temporal"])
def test_planes_of_views(spark, cube, view):
    e = B.encoded(B.place_stats(spark.createDataFrame(cube, CELLS), view)).collect()
    want = plain_view(cube, view)
    assert len(e) == 1 and len(e[0].planes) == 22 and {len(p) for p in e[0].planes} == {81} and len(e[0].globals) == 19
    p = e[0].planes
    for place, (i, v) in want.items():
        assert p[0][place] == 1
        assert p[1][place] == (v > 0.5) and p[2][place] == (v < 0.25)
        assert [p[k][place] for k in (3, 4, 5)] == pytest.approx([i, v, i * v], abs=1e-8)
    assert not any(any(q) for q in p[6:])
    assert e[0].globals == [{"spatial": 5.5, "temporal": 7.0}[view] / 14] + [0.0] * 18
    if view == "spatial":
        assert sum(p[1]) and sum(p[2]) and p[2][80] == 1 and p[3][80] == 0


def test_views_of_an_empty_cube(spark):
    e = B.encoded(B.place_stats(spark.createDataFrame([], CELLS), "spatial")).first()
    assert sum(e.planes[2]) == 81 and sum(e.planes[3]) == 0


def test_planes_of_games(spark):
    dice = random.Random(3)
    games = {g: [(k, dice.randrange(81), "black" if dice.random() < bias else "white") for k in range(1, n + 1)] for g, n, bias in [(1, 300, 0.5), (2, 1, 1.0), (3, 7, 0.0), (4, 30, 0.9)]}
    rows = [(g, *m) for g, ms in games.items() for m in ms]
    dice.shuffle(rows)
    got = {(r.game, r.plane, r.place): r.value for r in B.game_planes(spark.createDataFrame(rows, "game long, k long, place int, colour string"), "game", F.when(F.col("game") == 1, 7.5).otherwise(5.5)).collect()}
    want = {}
    for g, ms in games.items():
        for place, c in {place: c for _, place, c in ms}.items():
            want[g, 1 if c == "black" else 2, place] = 1.0
        seen = Counter()
        for _, place, c in ms[-10:]:
            if seen[c] < 5:
                want[g, (3 if c == "black" else 8) + seen[c], place] = 1.0
                seen[c] += 1
        komi = 7.5 if g == 1 else 5.5
        for place, v in enumerate((komi / 14, float(komi >= 7), float(ms[-1][2] == "black"))):
            want[g, 22, place] = v
    assert got == pytest.approx(want)


def test_long_games_are_cut_before_the_shuffle(spark):
    m = spark.range(1000).select((F.col("id") % 3).alias("game"), F.col("id").alias("k"), (F.col("id") % 81).cast("int").alias("place"), F.lit("black").alias("colour"))
    plan = B.game_planes(m, "game", F.lit(7.0))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_choice_of_weights(spark):
    pool = spark.createDataFrame([(1, "a", 0.5, [1.0, 0.0]), (2, "a", 0.9, [2.0, 0.0]), (3, "b", 0.9, [0.0, 4.0]), (4, "b", 0.9, [9.0, 9.0]), (5, "c", 0.95, [7.0, 7.0])], "id long, kind string, fitness double, weights array<double>")
    scores = [("sure", "a", 0.6), ("sure", "b", 0.4), ("blend", "b", 0.3), ("blend", "a", 0.5), ("weak", "a", 0.5), ("weak", "b", 0.2), ("weak", "c", 0.1), ("alone", "b", 0.1), ("unknown", "z", 0.8), ("tie", "b", 0.4), ("tie", "a", 0.4)]
    s = spark.createDataFrame(scores, "item string, kind string, score double")
    got = {r["item"]: (r["first"], r["choice"], [round(x, 9) for x in r["weights"]]) for r in B.chosen(s, pool, "item").collect()}
    mixed = [2.0 + (0.0 - 2.0) * 0.3, 4.0 * 0.3]
    assert got == {"sure": ("a", "special", [2, 0]), "blend": ("a", "blend", mixed), "weak": ("a", "special", [2, 0]), "alone": ("b", "special", [0, 4]), "unknown": ("z", "special", [7, 7]), "tie": ("a", "blend", mixed)}
    assert {(r.choice, tuple(r.weights)) for r in B.chosen(s, pool, "item", active=[5, 6]).collect()} == {("active", (5.0, 6.0))}
    assert B.chosen(s.limit(0), pool, "item").count() == 0


def test_galleries(spark):
    items = [(1, 80, 5, 10, 2), (2, 128, 4, 10, 3), (3, 100, 3, 30, 9), (4, None, 9, 1, 1), (5, 40, 5, 7, 9)]
    g = spark.createDataFrame(items, "id long, width int, created int, bytes long, frames int")
    ids = lambda **k: [r.id for r in S.gallery(g, **k).collect()]
    assert sorted(ids(size="small")) == [1, 5] and ids(size="large") == [2] and len(ids()) == 5
    assert ids(order="date_newest") == [4, 1, 5, 2, 3] and ids(order="date_oldest") == [3, 2, 1, 5, 4]
    assert ids(order="size_smallest") == [4, 5, 1, 2, 3] and ids(order="size_largest") == [3, 1, 2, 5, 4]
    assert ids(order="frame_count") == [3, 5, 2, 1, 4]
    top = {r.id: r for r in S.places(g, "id", S.gallery_orders(), 1).collect()}
    assert set(top) == {4, 3} and (top[4].date_newest, top[4].frame_count, top[3].size_largest) == (1, 5, 1)


def test_captures_and_common_indices(spark):
    e = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2020-01-01 00:00:00'), (1, TIMESTAMP_NTZ'2020-01-01 00:00:01.5'), (1, NULL), (2, TIMESTAMP_NTZ'2020-01-01 00:00:00'), (3, NULL) AS t(u, ts)")
    got = {r.u: (r.frames, r.complete, r.seconds, r.fps) for r in S.capture_statistics(e, "u", "ts", 3).collect()}
    assert got == {1: (3, True, 1.5, 2.0), 2: (1, False, 0.0, 0.0), 3: (1, False, 0.0, 0.0)}
    i = spark.createDataFrame([(v,) for v in [7, 7, 3, 3, 9, 1]], "idx int")
    assert P.most_common(i, 3).first().common == "[3]=2, [7]=2, [1]=1"
    assert P.most_common(i.limit(0), 3).first().common == ""
    assert P.not_black(spark.createDataFrame([(0, 5, 5), (0, 6, 0), (255, 0, 0)], "r int, g int, b int")).first().not_black == 2


def test_lookups_and_frames(spark, cube):
    cells = spark.createDataFrame(cube, CELLS)
    keys = spark.createDataFrame([(0, 0, 0), (-1, 0, 0), (9, 8, 8), (None, 1, 1), (4, 8, 8)], "t int, y int, x int")
    known = {c[1:4]: c[4:8] for c in cube}
    for r in C.looked_up(keys, cells, (1, 2, 3)).collect():
        assert (r.r, r.g, r.b, r.w) == known.get((r.t, r.y, r.x), (1, 2, 3, 0))
    v = spark.createDataFrame([(80, 40, 13, 1, 2, 3), (80, 40, 13, 1, 2, 3), (7, 0, 0, 9, 9, 250)], "f int, y int, x int, r int, g int, b int")
    w = {c[0]: c[7] for c in cube}
    assert {r.cell: r.cell_weight for r in C.with_cell_weight(v, cells).collect()} == {c: w.get(c, 0) for c in (8 * 81 + 4 * 9 + 1, 0)}
    s = C.rgb_summary(v).first()
    assert (s.n, s.colours, s.min_b, s.max_b) == (3, 2, 3, 250) and s.mean_b == round(256 / 3, 6) and s.deviation_r == pytest.approx(8 * (2 / 9) ** 0.5, abs=1e-6)
    assert tuple(C.whole_capture(v).first()) == (2, 79, 0, False)
    assert tuple(C.whole_capture(v, 8).first()) == (1, 7, 1, False)


def test_frames_out_of_strided_rows(spark):
    data = [bytes(range(200, 200 + n)) for n in (0, 2, 3, 24, 30)] + [None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "id int, d binary")
    for r in d.select("id", from_rows(F.col("d"), 2, 3, 10).alias("rgb")).collect():
        x = data[r.id] or b""
        want = b""
        for y in range(3):
            for c in range(2):
                at = y * 10 + c * 4
                want += x[at : at + 3][::-1] if at + 3 <= len(x) else b"\0\0\0"
        assert bytes(r.rgb) == want
