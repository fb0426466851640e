import hashlib
import random

import numpy as np
import pytest

from cubelume.operators import hashes as H
from cubelume.operators import matching as M


def greedy(pairs):
    taken, out = set(), []
    for a in sorted({p[0] for p in pairs}):
        for _, b, d in sorted((round(d, 9), b, d) for x, b, d in pairs if x == a):
            if b not in taken:
                taken.add(b)
                out.append((a, b, d))
                break
    return out


@pytest.mark.parametrize("n", [0, 1, 40, 400])
def test_matching_is_the_greedy_one(spark, n):
    dice = random.Random(n)
    pairs = list({(a, b): (a, b, dice.choice([1.0, 2.0, dice.random()])) for a, b in ((dice.randrange(n // 3 + 1), dice.randrange(n // 4 + 1)) for _ in range(n))}.values())
    df = spark.createDataFrame([*pairs, (None, 1, 0.0), (1, None, 0.0), (2, 2, None)], "a long, b long, delta double")
    assert sorted(map(tuple, M.one_to_one(df).collect())) == greedy(pairs)


def test_a_chain_of_rivals(spark):
    pairs = [(i, i, 1.0) for i in range(6)] + [(i + 1, i, 0.5) for i in range(6)]
    assert sorted(map(tuple, M.one_to_one(spark.createDataFrame(pairs, "a long, b long, delta double")).collect())) == greedy(pairs)


def radius(points, chosen):
    return np.sqrt(((points[:, None] - points[chosen][None]) ** 2).sum(2)).min(1).max()


def test_spread_is_exact_in_one_task_and_near_in_many(spark, monkeypatch):
    r = np.random.default_rng(2)
    points = np.concatenate([r.integers(0, 256, (300, 3)), r.integers(0, 30, (900, 3))])
    df = spark.createDataFrame([(i, *map(int, p), 0.0) for i, p in enumerate(points)] + [(5000, None, 1, 1, 0.0)], "idx int, r int, g int, b int, score double")
    exact = [x.idx for x in M.spread(df, 12).orderBy("pick").collect()]
    want = [0]
    while len(want) < 12:
        want.append(int(np.round(np.sqrt(((points[:, None] - points[want][None]) ** 2).sum(2)).min(1), 9).argmax()))
    assert exact == want
    monkeypatch.setattr(M, "ROWS_A_TASK", 100)
    many = [x.idx for x in M.spread(df, 12).orderBy("pick").collect()]
    assert len(set(many)) == 12 and radius(points, many) <= 4 * radius(points, exact) and many == [x.idx for x in M.spread(df, 12).orderBy("pick").collect()]
    assert M.spread(df.limit(0), 3).count() == 0 and M.spread(df.limit(2), 3).count() == 2


def test_scores_come_first(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 0.1), (2, 9, 9, 9, 0.9), (3, 200, 0, 0, 0.0), (4, 0, 0, 190, 0.5)], "idx int, r int, g int, b int, score double")
    assert [x.idx for x in M.spread(df, 3).orderBy("pick").collect()] == [2, 4, 3]


def plain_root(items, levels):
    level = {}
    for k, v in items:
        level.setdefault(k, []).append(hashlib.sha256(v.encode()).hexdigest())
    level = {k: v[0] if len(v) == 1 else hashlib.sha256("".join(sorted(v)).encode()).hexdigest() for k, v in level.items()}
    for _ in range(levels):
        above = {}
        for k in sorted(level):
            above.setdefault(k >> 4, []).append(level[k])
        level = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in above.items()}
    return level[0]


def test_roots_and_proofs(spark):
    dice = random.Random(7)
    items = [(dice.randrange(5000), f"text {i} é") for i in range(900)] + [(77, "same"), (77, "same"), (77, "other")]
    df = spark.createDataFrame([("x", *i) for i in items] + [("x", 3, None), ("x", None, "no key"), (None, 5, "alone")], "part string, k long, v string")
    tree = H.hash_tree(df, "k", "v", "part", levels=4).cache()
    found = {r.part: (r.leaves, r.root) for r in H.roots(tree, "part").collect()}
    assert found == {"x": (len({k for k, _ in items}), plain_root(items, 4)), None: (1, plain_root([(5, "alone")], 4))}
    single = [i for i in items if sum(i[0] == j[0] for j in items) == 1][:5]
    steps = {}
    for r in H.proofs(tree, spark.createDataFrame([("x", k) for k, _ in single] + [("x", 5001)], "part string, node long"), "part", levels=4).collect():
        steps.setdefault(r.node, {})[r.level] = (r.at, r.hashes)
    for k, v in single:
        proof = [steps[k][n] for n in range(1, 5)]
        assert H.proved(v.encode(), proof, found["x"][1]) and not H.proved(b"forged", proof, found["x"][1]) and not H.proved(v.encode(), proof, "0" * 64)
    with pytest.raises(Exception, match="keys of a tree"):
        H.hash_tree(spark.createDataFrame([(70000, "v")], "k long, v string"), "k", "v", levels=4).collect()
