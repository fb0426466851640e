"""Queries over whole tables against brute force."""

from collections import Counter, defaultdict

import pytest

from cubelume.operators import nearest as N
from cubelume.operators import palettes as P
from cubelume.plans import catalog
from cubelume.plans.palette_queries import palette
from cubelume.sources.cubes import voxels


@pytest.fixture(scope="module")
def near(spark, sf_dir):
    """Voxels as tuples, and idx and squared distance by colour."""
    v = [(r.f, r.r, r.g, r.b) for r in voxels(spark, sf_dir).select("f", "r", "g", "b").collect()]
    p = [(r.idx, r.r, r.g, r.b) for r in palette(spark, sf_dir).collect()]
    best = {c: min((sum((a - b) ** 2 for a, b in zip(c, q[1:], strict=True)), q[0]) for q in p) for c in {x[1:] for x in v}}
    return v, best


def test_nearest_colours_of_all_frames(spark, sf_dir, near):
    v, best = near
    rows = catalog.QUERIES["q_nearest"](spark, sf_dir).collect()
    assert len(rows) == len(best) and {(r.r, r.g, r.b): (r.dist, r.idx) for r in rows} == best
    n = catalog.QUERIES["q_lut_vs_nn"](spark, sf_dir).first()
    assert n.colours == len(best) and 0 < n.differ < n.colours
    e = catalog.QUERIES["q_reconstruct_error"](spark, sf_dir).first()
    assert e.n == len(v) and e.mse == pytest.approx(sum(best[x[1:]][0] for x in v) / (3 * len(v)), abs=1e-5)


def test_frames_beyond_the_ninth(spark, sf_dir, near):
    v, best = near
    error, moved = defaultdict(list), Counter()
    for f, *c in v:
        dist, idx = best[tuple(c)]
        error[f].append(dist**0.5)
        moved[f, (idx + f * 3) % 64] += 1
    mean = {f: sum(x) / len(x) for f, x in error.items()}
    assert max(mean) > 8
    rows = catalog.QUERIES["q_quantisation_error"](spark, sf_dir).collect()
    assert {r.f for r in rows} == set(mean) and all(r.error == pytest.approx(mean[r.f], abs=1e-5) and r.over == (mean[r.f] > 20) for r in rows)
    assert {(r.f, r.idx): r.n for r in catalog.QUERIES["q_conveyor"](spark, sf_dir).collect()} == moved
    assert sorted(r.f for r in catalog.QUERIES["q_hybrid_palettes"](spark, sf_dir).collect()) == sorted(f for f in mean if mean[f] > 30)[:4]


def test_frames_colours_and_vectors_whole(spark, sf_dir):
    v = voxels(spark, sf_dir).collect()
    q = catalog.QUERIES
    assert {r.f: r.n for r in q["q_raw_frames"](spark, sf_dir).collect()} == Counter(r.f for r in v)
    assert Counter(tuple(r) for r in q["q_channel_order"](spark, sf_dir).collect()) == Counter((r.f, r.y, r.x, r.b, r.g, r.r) for r in v)
    packed = q["q_pack_unpack"](spark, sf_dir).collect()
    assert all(r.same for r in packed) and Counter((r.r, r.g, r.b) for r in packed) == Counter((r.r, r.g, r.b) for r in v)
    n, red = Counter(), Counter()
    for r in v:
        cell = r.f // 9 * 81 + r.y // 9 * 9 + r.x // 9
        n[cell] += 1
        red[cell] += r.r
    assert {r.cell: (r.n, r.r) for r in q["q_range_lineage"](spark, sf_dir).collect()} == {c: (n[c], red[c]) for c in n}
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert vectors.where("vec_id >= 100").count() > 0 and q["q_low_rank"](spark, sf_dir).count() == vectors.count()


def test_every_move_is_written(spark, sf_dir):
    moves = defaultdict(list)
    for e in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id").collect():
        moves[e.user_id].append((e.ts, e.event_id))
    assert max(map(len, moves.values())) > 20
    want = {u: "(;GM[1]SZ[9]" + "".join(f";{'BW'[k % 2]}[{chr(97 + i % 9)}{chr(97 + i // 9 % 9)}]" for k, (_, i) in enumerate(sorted(m))) + ")" for u, m in moves.items()}
    assert {r.user_id: r.sgf for r in catalog.QUERIES["q_move_text"](spark, sf_dir).collect()} == want


def test_no_palette_is_cut(spark):
    def colours(n):
        return spark.range(n).selectExpr("cast(id as int) AS idx", "cast(id % 256 as int) AS r", "cast(id div 256 as int) AS g", "0 AS b")

    assert N.nearest(colours(3).drop("idx"), colours(256)).count() == 3
    assert N.nearest(colours(300).drop("idx"), colours(300)).where("dist = 0").count() == 300 and N.lookup_table(colours(300)).count() == 4096
    with pytest.raises(Exception, match="more than 256 colours"):
        N.distances(colours(300)).collect()


def test_small_palettes_meet_voxels_in_place(spark):
    """No shuffle and no interpreted lambda; equals go to the least idx, colours beyond a byte and rows without one as before, other columns stay."""
    v = spark.createDataFrame([(1, "a", 0, 0, 0), (2, None, 10, 0, 0), (3, "c", 300, -5, 7), (4, "d", None, 1, 1), (1, "a", 0, 0, 0)], "f int, name string, r int, g int, b int")
    p = spark.createDataFrame([(9, 0, 0, 0), (4, 20, 0, 0), (2, 255, 0, 0), (1, None, 9, 9)], "idx int, r int, g int, b int")
    found = N.nearest(v, p)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "lambda" not in plan and "Aggregate" not in plan
    assert sorted((r.f, r.name or "", r.idx, r.dist) for r in found.collect()) == [(1, "a", 9, 0), (1, "a", 9, 0), (2, "", 4, 100), (3, "c", 2, 45**2 + 25 + 49)]
    assert N.nearest(v, p.limit(0)).count() == 0 and N.best(v.select("r", "g", "b").distinct(), p).count() == 3


@pytest.mark.parametrize("name", ["q_quantisation_error", "q_lut_vs_nn", "q_nearest"])
def test_no_lambda_and_no_join_of_voxels(spark, sf_dir, name):
    """At most the joins with a look-up table of 4 096 rows are left."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("Join") == (name == "q_lut_vs_nn")


def test_transitions_by_bits(spark):
    """Over borders of blocks of frames, gaps, null colours and rows without a frame; neither join nor sort."""
    f = [0, 0, 1, 1, 60, 61, 61, 62, 62, 63, 123, 124, 125, 200, 61, 62, None, -3, 2, 1]
    r = [1, 2, 2, 3, 5, 5, 6, 5, 7, 300, 7, 7, 8, 1, None, None, 4, 1, None, 2]
    df = spark.createDataFrame([(i, c, 0, 1) for i, c in zip(f, r, strict=True)], "f int, r int, g int, b int")
    sets = {i: {(c if c is not None else (i, None)) for j, c in zip(f, r, strict=True) if j == i} for i in range(-3, 202)}
    want = [(i, len(sets[i] ^ sets[i - 1]), len(sets[i] | sets[i - 1])) for i in range(1, 201) if sets[i] | sets[i - 1]]
    found = P.transitions(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan
    assert sorted((x.f, x.changed, x.of) for x in found.collect()) == want
    assert P.transitions(df.limit(0)).count() == 0
