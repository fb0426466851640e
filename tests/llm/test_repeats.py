import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelume.llm import op12_repeats as op

W = op.WINDOW


def expected(texts):
    """(n_bytes, n_removed, n_spans, hash) of each text, by counting all windows."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + W] for b in data for i in range(len(b) - W + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, np.int32)
        for i in range(len(b) - W + 1):
            if counts[b[i : i + W]] > 1:
                gone[i] += 1
                gone[i + W] -= 1
        gone = np.cumsum(gone)[:-1] > 0 if len(b) else np.zeros(0, bool)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def held(df, texts):
    """df's doc_id numbers the texts; null ids are compared as a bag."""
    want = Counter((i, *w) for (i, _), w in zip(texts, expected([t for _, t in texts]), strict=True))
    got = Counter(tuple(r) for r in op.without_repeats(df).drop("kept_text").collect())
    assert got == want


def test_suffixes_in_order():
    dice = random.Random(1)
    for _ in range(200):
        letters, depth = dice.choice([b"ab", b"abc", bytes(range(256)), b"a", b"\0a"]), dice.choice([8, 16, 24, 200])
        s = np.frombuffer(bytes(dice.choice(letters) for _ in range(dice.randrange(1, 300))), np.uint8)
        wanted = np.array(sorted(dice.sample(range(len(s)), dice.randrange(0, len(s)))), dtype=np.int64)
        order = op.two_stage(s, wanted, depth)
        keys = [(bytes(s[i:]) + b"\0" * depth)[:depth] for i in order]
        assert sorted(order.tolist()) == wanted.tolist() and keys == sorted(keys)


def test_common_prefixes():
    s = np.frombuffer(b"abcdefgh12345678x" + b"abcdefgh12345679y" + b"abcdefgz", np.uint8)
    order = op.two_stage(s, np.array([0, 17, 34]), 16)
    assert order.tolist() == [0, 17, 34] and op.common_prefixes(s, order, 16).tolist() == [0, 8, 0]


def test_windows_that_repeat():
    dice = random.Random(2)
    for _ in range(100):
        letters = dice.choice([b"ab", b"abcd"])
        contexts = [bytes(dice.choice(letters) for _ in range(dice.randrange(4, 60))) for _ in range(dice.randrange(1, 10))]
        contexts += [contexts[0][3:]] * dice.randrange(2)
        counts = Counter(c[i : i + 8] for c in contexts for i in range(len(c) - 7))
        for c, flags in zip(contexts, op.repeated(contexts, 8), strict=True):
            assert flags.tolist() == [counts[c[i : i + 8]] > 1 for i in range(len(c) - 7)]


def test_segments_hold_every_window_once_and_equal_windows_have_one_key():
    dice = random.Random(3)
    for _ in range(60):
        letters = dice.choice([b"ab", b"abcdefghij", b"a"])
        passage = bytes(dice.choice(letters) for _ in range(60))
        texts = [bytes(dice.choice(letters) for _ in range(dice.randrange(0, 300))) + passage * dice.randrange(2) for _ in range(6)]
        b, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        begin, length, key, twice = op.segments(b, ends, 1 << 16, window=40, gram=8)
        of: dict[bytes, set] = {}
        places: dict[bytes, list] = {}
        for k, (a, n, h) in enumerate(zip(begin, length, key, strict=True)):
            for i in range(a, a + n):
                of.setdefault(bytes(b[i : i + 40]), set()).add(int(h))
                places.setdefault(bytes(b[i : i + 40]), []).append(k)
        assert sum(length) == sum(max(0, len(t) - 39) for t in texts) and all(len(h) == 1 for h in of.values())
        keys = Counter(key.tolist()) + Counter(twice.tolist())
        assert all(keys[int(key[k[0]])] > 1 for k in places.values() if len(k) > 1)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = op.op12_repeats(spark, sf_dir)
    assert df.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = Counter((i, *w) for (i, _), w in zip(rows, expected([t for _, t in rows]), strict=True))
    assert Counter(tuple(r) for r in df.collect()) == want and sum(w[2] > 0 for w in want) > 10


def prose(dice, n):
    return "".join(dice.choice("abcdefghij klmnopé ") for _ in range(n))


@pytest.mark.parametrize("settings", [{}, {"CHUNK": 1500, "ARRAY": 3000}, {"GROUP": 3}])
def test_planted_passages(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(op, k, v)
    dice = random.Random(4)
    passage, shorter, other = prose(dice, 450), prose(dice, 150), prose(dice, 700)
    texts = [prose(dice, dice.randrange(50, 900)) + p + prose(dice, dice.randrange(0, 400)) for p in [passage] * 40 + [shorter] * 5 + [other, other[100:500]] * 4 + [""] * 20]
    texts += [texts[0], texts[0], texts[3][:260], texts[5][100:], "x" * 3000, "ab" * 700, "abc" * 90, prose(dice, 199), "y" * 200, "z" * 201, prose(dice, 5000) * 2]
    rows = list(enumerate(texts))
    held(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    held(odd.withColumn("text_key", F.lit(1)).withColumn("REMOVED", F.lit(1)).withColumn("h", F.lit(1)), rows)
    assert op.without_repeats(empty).count() == 0


def test_kept_bytes():
    text = memoryview(bytes(range(100)))
    first, stop = np.array([50, 0, 3]), np.array([51, 2, 4])
    assert op.kept(text, first, stop, 10)[:2] == (23, 2)
    assert b"".join(op.kept(text, first, stop, 10)[2]) == bytes([*range(13, 50), *range(60, 100)])
    assert op.kept(text, np.array([0, 10]), np.array([1, 11]), 10)[:2] == (20, 1)
