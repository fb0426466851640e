import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cubelume.llm import op01_mixing as O1
from cubelume.llm import op05_sharding as O5


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until none is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, left = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]


def test_targets(spark):
    for seed in range(6):
        r = random.Random(seed)
        sizes = {f"s{i}": r.choice([0, 1, 10, 1000, 100_000]) for i in range(9)} | {None: 50, "big": 500}
        got = O1.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
        assert {r.source: r.target for r in got.collect()} == pytest.approx(water(sizes))


def test_mix(spark, sf_dir):
    rows = O1.op1_mixing(spark, sf_dir).collect()
    assert rows == O1.op1_mixing(spark, sf_dir).collect() and all(r.taken <= 3 * r.size for r in rows)
    per = defaultdict(int)
    for r in rows:
        per[r.target, r.source_size] += r.taken
    assert sum(per.values()) == pytest.approx(sum(r.size for r in rows), rel=0.15)


def test_mix_of_odd_rows(odd, empty):
    out, names = O1.with_copies(odd)
    assert out.count() == 9 and names["size"] != "mix_size"
    assert set(O1.emit(odd).columns) == set(odd.columns)
    assert O1.emit(empty).count() == 0


def test_emit_keeps_clashing_columns(spark, odd):
    for c in ("mix_target_s", "mix_target_n", "MIX_COPY", "mix_copies"):
        odd = odd.withColumn(c, F.lit("y"))
    out = O1.emit(odd)
    assert out.columns == odd.columns and {r["mix_target_s"] for r in out.collect()} == {"y"}


def test_emit_by_a_shuffle_join(spark, monkeypatch):
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('w ', 10 + id % 7) AS text", "concat('s', id % 40) AS source")
    want = sorted(r.doc_id for r in O1.emit(docs).collect())
    monkeypatch.setattr(O1, "BROADCAST_SOURCES", 3)
    assert sorted(r.doc_id for r in O1.emit(docs).collect()) == want


def simple_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        best = min((r, i) for i, r in enumerate(room) if r >= s) if any(r >= s for r in room) else None
        if best is None:
            room.append(max(capacity, s))
            best = (room[-1], len(room) - 1)
        room[best[1]] -= s
        out.append(best[1])
    return out


def one_by_one(runs, placed):
    return [k for p in placed for k, n in p for _ in range(n)]


def test_best_fit_of_runs_is_that_of_single_groups():
    for seed in range(60):
        r = random.Random(seed)
        sizes = sorted((r.randrange(1, r.choice([12, 60, 130])) for _ in range(r.randrange(0, 200))), reverse=True)
        runs = [(s, sizes.count(s)) for s in sorted({*sizes}, reverse=True)]
        assert one_by_one(runs, O5.best_fit_decreasing(runs, 100)) == simple_fit(sizes, 100)


def test_shards_are_best_fit_decreasing(spark):
    r = random.Random(6)
    texts = ["y" * r.choice([5, 5, 5, 60, r.randrange(1, 400)]) + str(i) for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(i, "a" * 3000) for i in range(5000, 5020)], "doc_id long, text string")
    shards = O5.pack(docs, 20_000).collect()
    groups = defaultdict(lambda: [0, set()])
    for x in shards:
        g = groups[x.size, x.text_crc32]
        g[0] += x.size
        g[1].add(x.shard)
    assert len(shards) == 2020 and all(len(s) == 1 for _, s in groups.values())
    sizes = sorted((b for b, _ in groups.values()), reverse=True)
    want, got = defaultdict(list), defaultdict(list)
    for b, k in zip(sizes, simple_fit(sizes, 20_000), strict=True):
        want[k].append(b)
    for b, s in groups.values():
        got[min(s)].append(b)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_one_size_of_very_many_groups_is_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(O5, "ROWS_A_BLOCK", 50)
    docs = spark.range(3000).selectExpr("id AS doc_id", "lpad(id, 8, '0') AS text")
    rows = O5.shard(docs, 7).collect()
    per = defaultdict(list)
    for x in rows:
        per[x.shard].append(x.slot)
    assert len(rows) == 3000 and set(per) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 10


def test_shards(spark, sf_dir):
    rows = O5.op5_sharding(spark, sf_dir).collect()
    size, slots, home = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        home[r.text_crc32, r.size].add(r.shard)
    assert all(len(v) == 1 for v in home.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(size) == set(range(24))
    whole = defaultdict(int)
    for r in rows:
        whole[r.text_crc32, r.size] += r.size
    assert max(size.values()) - min(size.values()) <= max(max(whole.values()), 0.02 * max(size.values()))


def test_shards_are_near_equal(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, "x" * r.randrange(10, 900)) for i in range(3000)], "doc_id long, text string")
    size = defaultdict(int)
    for row in O5.shard(docs, 6).collect():
        size[row.shard] += row.size
    assert max(size.values()) <= 1.02 * min(size.values())


def test_shards_of_odd_rows(odd, empty):
    rows = O5.shard(odd, 3).collect()
    assert len(rows) == 9 and len({(r.shard, r.slot) for r in rows}) == 9
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1  # null is the empty text
    assert O5.shard(empty, 3).count() == 0
    packed = O5.pack(odd, 1000).collect()
    assert len(packed) == 9
