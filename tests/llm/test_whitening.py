import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelume.llm import op11_whitening as op

SCHEMA = "vec_id long, embedding array<double>, label int"


def held(df, rows, k=16):
    """Rows of the operator against plain Python numbers and numpy's eigenvectors."""
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, []).append(r)
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], object)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(fit), fit.sum(0)
    y = (n * fit - s).astype(np.longdouble) / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov.astype(np.float64))
    e, u = e[::-1], u[:, ::-1]
    mean_errors = {r.identity_error for v in got.values() for r in v}
    assert len(mean_errors) == 1 and mean_errors.pop() <= 1e-4
    assert set(got) == {i for i, _ in rows}
    for (i, _), row in zip(rows, x, strict=True):
        found = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in found] == list(range(1, min(k, len(found)) + 1))
        deviation = int(((n * row - s) ** 2).sum())
        for r in found:
            assert r.n == n and int(r.deviation_wide) == deviation and r.deviation == (deviation if deviation < 1 << 63 else None)
            assert r.explained == pytest.approx(float(e[r.component - 1] / cov.trace()), rel=1e-4)
    found = np.array([[r.whitened for r in sorted(got[i], key=lambda r: r.component)] for i, _ in rows])
    plain = ((n * x - s).astype(np.float64) / n) @ (u[:, : found.shape[1]] / np.sqrt(e[: found.shape[1]]))
    signs = np.sign((found * plain).sum(0))
    np.testing.assert_allclose(found, plain * signs, rtol=1e-6, atol=1e-6)
    return found


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert held(op.op11_whitening(spark, sf_dir), rows).shape[1] == 16


def test_large_and_small_spreads_and_copies(spark):
    dice = np.random.default_rng(4)
    x = dice.normal(size=(300, 7)) * np.array([2e4, 3e3, 70, 9, 2, 1, 0.5]) + 1e10
    rows = [(i, list(map(float, v))) for i, v in enumerate(np.concatenate([x, x[:50], x[:50]]))]
    held(op.whiten(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)), rows)


def test_spreads_beyond_a_double(spark):
    dice = np.random.default_rng(7)
    rows = [(i, list(map(float, v))) for i, v in enumerate(dice.normal(size=(200, 3)) * np.array([1e12, 1e3, 0.5]))]
    got = op.whiten(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).toPandas()
    assert set(got.component) == {1, 2, 3} and got.identity_error.max() <= 1e-4
    for _, w in got.groupby("component"):
        assert abs((w.whitened**2).mean() - 1) < 1e-9
    assert got.deviation.isna().all() and got.deviation_wide.map(int).min() > 1 << 63


def test_fewer_components_than_asked(spark):
    dice = np.random.default_rng(5)
    x = np.floor(dice.normal(size=(60, 3)) * 40)
    x = np.concatenate([x, x[:, :1], x[:, :1] + x[:, 1:2], np.full((60, 1), 7.0)], 1)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    assert held(op.whiten(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)), rows).shape[1] == 3


def test_rows_that_have_no_place(spark):
    inf, nan = float("inf"), float("nan")
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1e300, 1.0]), (7, [1.0, 2.0, 3.0])]
    good = [(None, [1.0, 2.0]), (8, [3.0, 1.0]), (8, [3.0, 1.0]), (9, [0.5, -4.0]), (10, [0.0, 0.0])]
    got = op.whiten(spark.createDataFrame([(i, v, 0) for i, v in bad + good], SCHEMA).withColumn("x", F.lit(1)).withColumn("COMPONENT", F.lit("c"))).collect()
    assert sorted((r.vec_id, r.component) for r in got if r.vec_id) == [(8, 1), (8, 1), (8, 2), (8, 2), (9, 1), (9, 2), (10, 1), (10, 2)]
    assert {r.n for r in got} == {4} and sum(r.vec_id is None for r in got) == 2


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)]])
def test_too_few_vectors(spark, rows):
    df = op.whiten(spark.createDataFrame(rows, SCHEMA))
    assert df.count() == 0 and df.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_digits_sum_to_the_number():
    v = np.array([0, 1, -1, 2047, 2048, -2048, -2049, 1 << 40, -(1 << 40), (1 << 60) + 12345, -(1 << 60)])
    for bits in (12, 21):
        count = op._count(int(np.abs(v).max()), bits)
        parts = op.digits(v, bits, count)
        assert sum(p.astype(object) << (bits * i) for i, p in enumerate(parts)).tolist() == v.tolist()
        assert max(np.abs(p).max() for p in parts) <= 1 << (bits - 1)


def test_jacobi_finds_small_eigenvalues_to_relative_accuracy():
    scale = np.array([1e8, 1e3, 1.0, 1e-4, 1e-7], np.longdouble)
    inner = np.eye(5, dtype=np.longdouble) + np.longdouble(0.3) / (1 + np.abs(np.subtract.outer(np.arange(5), np.arange(5))))
    e, u = op.components_of(scale[:, None] * inner * scale)
    assert np.abs(u.T @ u - np.eye(5)).max() < 1e-15
    left = (u.T @ (scale[:, None] * inner * scale) @ u).diagonal()
    assert (np.abs(e[:2] / left[:2] - 1) < 1e-15).all()
    product = np.prod(e) / np.prod(scale**2)
    assert abs(float(product / np.longdouble(np.linalg.det(inner.astype(np.float64)))) - 1) < 1e-12
