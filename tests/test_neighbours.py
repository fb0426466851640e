import numpy as np
import pytest

from cubelume.operators import neighbours as N

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, blend):
    out = {}
    for i, x in rows:
        x, found = np.array(x), []
        for j, y in rows:
            if i != j:
                y = np.array(y)
                far = np.sqrt(((x - y) ** 2).sum())
                size = np.linalg.norm(x) * np.linalg.norm(y)
                found.append((round(float(far * (2 - (x @ y / size if size else 0))) if blend else float(far), 9), j))
        out[i] = sorted(found)[:k]
    return out


def held(spark, rows, k, blend=True):
    got = {}
    for r in N.all_neighbours(spark.createDataFrame(rows, SCHEMA), k, blend).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.score, r.neighbour))
    want = plain(rows, k, blend)
    assert {i: [n for _, n in v] for i, v in got.items()} == {i: [n for _, n in v] for i, v in want.items()}
    assert all(s == pytest.approx(w, abs=1e-8) for i in want for (s, _), (w, _) in zip(got[i], want[i], strict=True))


@pytest.mark.parametrize("blend", [True, False])
def test_all_against_brute_force(spark, monkeypatch, blend):
    monkeypatch.setattr(N, "BLOCK", 40)
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(150, 8)), r.normal(size=(8,)) * 5 + r.normal(size=(150, 8)) * 0.1])
    held(spark, [(i * 3, v.tolist()) for i, v in enumerate(x)], 4, blend)


def test_copies_zeros_and_few(spark):
    held(spark, [(i, [1.0, 2.0]) for i in range(6)] + [(10, [0.0, 0.0]), (11, [-1.0, 0.5]), (12, [0.0, 0.0])], 3)
    held(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], 5)


def test_rows_that_take_no_part(spark):
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([*odd, (6, [1.0, 1.0]), (7, [1.0, 3.0]), (8, [0.0, 1.0])], SCHEMA)
    assert {(r.query, r.neighbour) for r in N.all_neighbours(df, 1).collect()} == {(6, 8), (7, 6), (8, 6)}
    assert N.all_neighbours(df.where("vec_id < 3"), 2).count() == 0


def test_far_clusters(spark):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(10, 6)) * 100, 40, 0) + r.normal(size=(400, 6)) * 0.05
    held(spark, [(i, v.tolist()) for i, v in enumerate(x)], 3)


def test_some_that_ask(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(400, 6)), np.repeat(r.normal(size=(2, 6)), 150, 0), r.normal(size=(100, 6)) * 1e-7])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for q in N.knn(spark.createDataFrame(rows, SCHEMA), "id % 50 = 0", 5, digits=6).orderBy("query", "rank").collect():
        got.setdefault(q.query, []).append((q.score, q.neighbour))
    # scores that agree in six digits are ordered by id, however many there are
    want = {i: sorted((round(s, 6), j) for s, j in v)[:5] for i, v in plain(rows, len(rows), True).items() if i % 50 == 0}
    assert {i: [j for _, j in v] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}


def test_blocks_hold_few_of_equals(spark):
    ids, x = np.array([1, 1, 2, 3, 4, 5, 6, 7]), np.array([[1.0], [1.0], [1.0], [0.0], [1.0], [1.0], [-0.0], [1.0]])
    assert N._few_of_equals(ids, x, 1).tolist() == [0, 1, 2, 3, 6]
    assert N._few_of_equals(ids[:0], x[:0], 1).tolist() == []


def test_no_vector_is_written_for_each_cell(spark):
    r = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 4)))]
    plan = N.all_neighbours(spark.createDataFrame(rows, SCHEMA), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_sizes_that_single_precision_does_not_hold(spark):
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(40, 4)) * 1e-5, r.normal(size=(40, 4)) * 1e6, r.normal(size=(40, 4)), r.normal(size=(40, 4)) * 1e-3 + 1e4])
    held(spark, [(i, v.tolist()) for i, v in enumerate(x)], 3, False)


@pytest.mark.parametrize("blend", [True, False])
def test_least_cosine_is_below_all_that_meet_the_bound(blend):
    r = np.random.default_rng(11)
    own, size, c = r.lognormal(0, 2, 2000), r.uniform(1.0, 1.1, 2000), r.uniform(-1, 1, 2000)
    own[:5], c[:5] = 0, 0
    for cosine in (c, 1 - np.abs(c) * 1e-9):
        score = np.sqrt((own - size) ** 2 + 2 * own * size * (1 - cosine)) * ((2 - cosine) if blend else 1)
        least = N._least_cosine(own, 1.0, 1.1, score * (1 + 1e-9) + 1e-9, blend)
        assert (least <= cosine).all()
    assert np.isinf(N._least_cosine(np.array([5.0]), 1.0, 1.1, np.array([3.5]), blend)).all()
    assert N._least_cosine(np.array([1.0]), 1.0, 1.0, np.array([1.0]), False) == pytest.approx(0.5, abs=1e-6)


@pytest.mark.parametrize("blend", [True, False])
def test_vectors_of_all_sizes_in_one_block(spark, blend):
    r = np.random.default_rng(13)
    x = r.normal(size=(200, 6)) * r.lognormal(0, 3, size=(200, 1))
    held(spark, [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x[:20] * 2, np.zeros((2, 6)), x[:3] * 1e-145]))], 4, blend)
