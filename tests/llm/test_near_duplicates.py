import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelume.llm import op04_minhash as O4
from cubelume.llm import op06_embeddings as O6
from cubelume.llm.components import connected_components


def label(nodes, pairs):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(texts, k=5, least=0.8):
    """Classes by weighted Jaccard similarity of the counts of shingles."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        if w:
            sets[i] = Counter(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))
    ids, n = sorted(sets), {i: s.total() for i, s in sets.items()}
    at = defaultdict(list)
    for i in ids:
        for e in sets[i]:
            at[e].append(i)
    met = {(a, b) for e in at.values() for x, a in enumerate(e) for b in e[x + 1 :] if min(n[a], n[b]) >= least * max(n[a], n[b])}
    return label(texts, [(a, b) for a, b in met if (c := (sets[a] & sets[b]).total()) >= least * (n[a] + n[b] - c) - 1e-9])


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(120)]
    texts, n = {}, 0
    for _ in range(6):  # chains and stars of near copies
        base = [word() for _ in range(r.randrange(30, 200))]
        for _ in range(r.randrange(2, 12)):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = word()
            texts[n], n = " ".join(t), n + 1
            if r.random() < 0.5:
                base = t
    for _ in range(25):  # one passage that many share, with a fifth of their own
        texts[n], n = " ".join(passage + [word() for _ in range(r.randrange(20, 40))]), n + 1
    for _ in range(10):
        texts[n], n = " ".join(word() for _ in range(r.randrange(1, 8))), n + 1
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_are_those_of_brute_force(spark, seed):
    texts = corpus(seed)
    texts[900], texts[901], texts[902] = texts[0], None, ""
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in O4.near_duplicates(df).collect()} == brute(texts)


def test_a_large_group_of_near_copies_and_a_common_passage(spark, monkeypatch):
    """One bucket holds most documents, and one run of shingles begins many of them; their blocks are small here."""
    monkeypatch.setattr(O4, "BLOCK", 8)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base, passage, texts = [word() for _ in range(100)], [word() for _ in range(60)], {}
    for i in range(160):
        t = list(base)
        for _ in range(r.randrange(0, 5)):
            t[r.randrange(len(t))] = word()
        texts[i] = " ".join(t)
    for i in range(160, 260):  # the passage with a part that they share in pairs
        texts[i] = " ".join(passage + [word() for _ in range(r.randrange(3, 16))])
    texts[300] = "\n".join([" ".join(base[:12])] * 9)  # the same line again and again
    texts[301] = "\n".join([" ".join(base[:12])] * 10)
    texts[302] = " ".join(base[:12] + passage[:3])
    got = {x.doc_id: x.class_id for x in O4.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts) and got[301] == got[300] != got[302]


def test_texts_under_one_id_are_documents_of_their_own(spark):
    one, two = "the first text under this id is about rivers and hills", "quite another one that speaks of engines and their wheels"
    rows = [(3, one, "x"), (3, two, "y"), (3, one, "z"), (4, two, "w"), (5, one + " and more of such things", "v"), (None, one, "u"), (None, one, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id string").withColumn("__gone", F.lit(1)).withColumn("h", F.lit(2))
    kept = O4.deduplicated(df)
    got = sorted(((r.doc_id or 0), r.text) for r in kept.collect())
    assert kept.columns == df.columns
    assert got == sorted([(0, one), (0, one), (3, one), (3, two), (5, one + " and more of such things")])
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, O4.deduplicated(df).collect()), key=str)
    rows = sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in O4.near_duplicates(df).collect())
    assert rows == [(0, 0, True), (0, 0, True), (3, 3, True), (3, 3, True), (4, 3, False), (5, 5, True)]


def test_dart_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    common, own = r.integers(0, 2**63, 300, dtype=np.uint64), r.integers(0, 2**63, (2, 100), dtype=np.uint64)
    a, b = np.concatenate([common, own[0]]), np.concatenate([common, own[1]])
    sig = O4.signatures(np.concatenate([a, b]), np.ones(800), np.array([400, 400]), 1024)
    assert np.mean(sig[0] == sig[1]) == pytest.approx(300 / 500, abs=0.06)
    w = np.concatenate([np.full(300, 3.0), np.full(100, 1.0), np.full(300, 1.0), np.full(100, 1.0)])
    sig = O4.signatures(np.concatenate([a, b]), w, np.array([400, 400]), 1024)
    assert np.mean(sig[0] == sig[1]) == pytest.approx(300 / (900 + 200), abs=0.06)  # weighted Jaccard
    one = O4.signatures(a[:1], np.ones(1), np.array([1]))
    assert (one == O4.signatures(a[:1], np.ones(1), np.array([1]))).all()


def test_agreed(spark):
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, (20, O4.K), dtype=np.uint64)
    b = a.copy()
    for i in range(20):
        b[i, : i * 4] ^= np.uint64(0x55)
    rows = list(zip(O4._packed(a).tolist(), O4._packed(b).tolist(), strict=True))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a array<long>, b array<long>")
    assert [x.n for x in df.select("i", O4.agreed(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()] == [O4.K - 4 * i for i in range(20)]


def test_odd_rows(odd, empty):
    rows = {(r.doc_id, r.class_id, r.kept) for r in O4.near_duplicates(odd).collect()}
    assert {(1, 1, True), (2, 2, True), (4, 4, True), (None, None, True)} <= rows
    assert O4.near_duplicates(empty).count() == 0
    kept = O4.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id IS NULL").count() == 1


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    assert {x.node: x.component for x in got.collect()} == label(nodes, [p for p in pairs if p[0] != p[1]])


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 64))
    x = np.concatenate([base, base[:20] + r.normal(size=(20, 64)) * 0.2, np.repeat(base[:1], 70, 0) + r.normal(size=(70, 64)) * 0.25, base[:3]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] + [1.0] * 63), (903, []), (904, [1.0] * 63 + [None]), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {g.vec_id: (g.n_links, g.component_id) for g in O6.links(df).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = label(range(len(x)), list(zip(*np.nonzero(near), strict=True)))
    links = sum(got[i][0] for i in range(len(x)))
    assert 0.98 * near.sum() <= links <= near.sum() and all(got[i][0] <= near[i].sum() for i in range(len(x)))
    assert np.mean([got[i][1] == want[i] for i in range(len(x))]) > 0.98
    assert all(got[i] == (0, i) for i in range(900, 906))
    assert O6.links(df.where("vec_id < 0")).count() == 0


def test_components_of_any_size(spark):
    rows = [[1e200, 2e200], [1e200, 2e200], [1e200, 2.1e200], [1e-200, 2e-200], [1e-200, 2.1e-200], [5e-324, 1e-323], [-1e308, -1.7e308], [-1e308, -1.7e308], [0.0, -0.0], [1e308, float("inf")]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {g.vec_id: (g.n_links, g.component_id) for g in O6.links(df).collect()}
    assert got == {i: (5, 0) if i < 6 else (1, 6) if i < 8 else (0, i) for i in range(10)}


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(O6, "BLOCK", 16)
    r = np.random.default_rng(6)
    x = (r.normal(size=(1, 32)) + r.normal(size=(100, 32)) * 0.05).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert {(g.n_links, g.component_id) for g in O6.links(df).collect()} == {(99, 0)}


def test_recall_at_the_threshold():
    r = np.random.default_rng(7)
    a = r.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for k in (2, 3):
        x, y = O6.codes(a, k), O6.codes(b, k)
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y, strict=True)]) > 0.9


def at_the_threshold(n, d, seed):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    return a, 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)


@pytest.mark.parametrize("d", [64, 384])
def test_recall_stays_with_more_hashes(d):
    a, b = at_the_threshold(2000, d, 8)

    def recall(k):
        return np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(O6.codes(a, k), O6.codes(b, k), strict=True)])

    two = recall(2)
    assert two > 0.96 and recall(3) > two - 0.005 and recall(4) > two - 0.005


@pytest.mark.parametrize("k", [3, 4])
def test_links_with_more_hashes_against_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(O6, "wide", lambda n: k)
    a, b = at_the_threshold(400, 64, 9)
    x = np.concatenate([a, b * 1.0001 + a * 0.001]).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {g.vec_id: g.n_links for g in O6.links(df).collect()}
    assert near.sum() >= 800 and all(got[i] <= near[i].sum() for i in got)
    assert sum(got.values()) >= 0.99 * near.sum()
