import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelume.operators import training as T
from cubelume.plans.score_queries import samples
from cubelume.streaming.stateful import with_state_store


def plain(rows):
    """rows (type, total, perceptual, variances) over the gate in order -> {type: (steps, weights)}, sample by sample."""
    genes = {}
    for b in range(len(rows) // 10):
        types = {}
        for r in rows[b * 10 : b * 10 + 10]:
            if r[0] is not None:
                types.setdefault(r[0], []).append(r)
        for kind, some in types.items():
            g, f, n = [0.0] * 12, [0.0] * 12, len(some)
            for _, total, seen, variances in some:
                push = [(total - 0.5) * (0.1 if v > 0.1 else -0.1) for v in variances] + [(total - 0.5) * 0.02, (seen - 0.5) * 0.01, -(seen - 0.5) * 0.01]
                g = [x + p / n for x, p in zip(g, push, strict=True)]
                f = [x + p * p / n for x, p in zip(f, push[:10] + [seen * 0.01] * 2, strict=True)]
            w, v, old, anchor, steps = genes.get(kind, (T.START, [0.0] * 12, [0.0] * 12, T.START, 0))
            g = [x - (0.5 * o * (a - c) if o > 0.001 else 0.0) for x, o, a, c in zip(g, old, w, anchor, strict=True)]
            v = [0.9 * a + 0.1 * x for a, x in zip(v, g, strict=True)]
            size = math.sqrt(sum(x * x for x in v))
            w = [min(h, max(lo, a + 0.01 * x * min(1.0, 1.0 / size if size else 1.0))) for a, x, lo, h in zip(w, v, T.LOW, T.HIGH, strict=True)]
            genes[kind] = (w, v, [0.99 * o + x for o, x in zip(old, f, strict=True)], w, steps + 1)
    return {k: (g[4], g[0]) for k, g in genes.items()}


@pytest.fixture(scope="module")
def want(spark, sf_dir):
    rows = samples(spark, sf_dir).where(F.round("total", 9) >= T.GATE).orderBy("ts", "id").collect()
    return plain([(r.content, r.total, r.perceptual, r.variances) for r in rows])


def same(got, want):
    assert got.keys() == want.keys()
    for k, (steps, weights) in got.items():
        assert steps == want[k][0] and weights == pytest.approx(want[k][1], abs=1e-8)


def test_training_against_plain_steps(spark, sf_dir, want):
    g = T.batch_gradients(samples(spark, sf_dir), "content", "ts", "id")
    same({r.content: (r.steps, r.weights) for r in T.trained(g, "content").collect()}, want)


def test_a_stream_that_is_restarted_learns_the_same(spark, sf_dir, tmp_path, want):
    with_state_store(spark)
    g = T.batch_gradients(samples(spark, sf_dir), "content", "ts", "id").cache()
    cut = g.agg(F.max("batch")).first()[0] // 2
    found = {}
    for part in (f"batch <= {cut}", f"batch > {cut}"):
        g.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = T.training_stream(spark.readStream.schema(g.schema).parquet(f"{tmp_path}/in"), "content")
        q = stream.writeStream.outputMode("update").foreachBatch(lambda d, _: found.update({r.key: (r.steps, r.weights) for r in d.collect()})).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    same(found, want)


def test_bounds_clip_and_order():
    s = T.fresh_state()
    big = np.full(12, 1000.0)
    after = T.step(s, big, np.full(12, 0.01))
    assert np.sqrt((((after["weights"] - s["weights"]) / T.RATE) ** 2).sum()) == pytest.approx(T.MOST)  # clipped after momentum
    assert after["velocity"][0] == pytest.approx(100.0) and (after["anchor"] == after["weights"]).all()
    for _ in range(3000):
        s = T.step(s, np.array([1.0] * 10 + [-1.0, 1.0]), np.zeros(12))
    assert s["weights"][0] == 1.0 and s["weights"][-2] > s["weights"][-1]
