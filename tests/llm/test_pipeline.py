import hashlib
import os
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_mixing_sharding import water
from test_near_duplicates import brute

import corpus_pipeline as C

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    n, columns = docs.count(), docs.columns
    assert [name for name, _ in C.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_ids"]
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        if name != "mixing":
            assert 0.8 * n <= docs.count() <= n
    out = C.STAGES[-1][1](spark, docs, sf_dir)
    rows = sorted((r.start, r.n_tokens, r.doc_id) for r in out.collect())
    assert [r[0] for r in rows] == [sum(x[1] for x in rows[:i]) for i in range(len(rows))]
    assert len(rows) == docs.count()


def test_run(spark, sf_dir):
    out = C.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_odd_rows(spark, sf_dir, odd, empty):
    for docs in (odd, empty):
        for _, stage in C.STAGES:
            stage(spark, docs, sf_dir).collect()


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage's rows by plain Python, from what the stage before kept."""
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    stages, docs = dict(C.STAGES), spark.read.parquet(f"{sf_dir}/documents.parquet")
    have = lambda df: sorted((r.doc_id, r.text, r.source) for r in df.collect())
    words = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()))
    rows, df = have(docs), docs

    df = stages["language"](spark, df, sf_dir).cache()
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert have(df) == rows

    df = stages["near_duplicates"](spark, df, sf_dir).cache()
    of = brute({i: t for i, t, _ in rows})
    rows = [r for r in rows if of[r[0]] == r[0]]
    assert have(df) == rows

    df = stages["decontamination"](spark, df, sf_dir).cache()
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(f" {i} " in f" {words(r[1])} " for i in items if i)]
    assert have(df) == rows

    df = stages["mixing"](spark, df, sf_dir).cache()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    per = Counter()
    for i, _, s in rows:
        per[s] += size[i]
    target, copies = water(per), {}
    for i, _, s in rows:
        rate = target[s] / per[s]
        draw = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        copies[i] = min(int(rate) + (draw < rate - int(rate)), 3)
    rows = sorted(r for r in rows for _ in range(copies[r[0]]))
    assert have(df) == rows

    tok = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want, start = [], 0
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in stages["token_ids"](spark, df, sf_dir).collect()) == sorted(want)


def test_clashing_names_and_rows_without_id(spark, sf_dir, odd):
    names = ("gone_id", "language_label", "language_found", "mix_target_s", "mix_copy", "__language", "__gone")
    docs = odd.withColumns({n: F.lit("z") for n in names})
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == [*odd.columns, *names] and all(r[n] == "z" for r in docs.collect() for n in names), name
    assert C.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_a_session_without_a_checkpoint_folder(sf_dir, tmp_path):
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as e
for name in ("op1_mixing", "op5_sharding", "op8_token_ids", "q_components"):
    assert e.queries()[name](s, "{sf_dir}").count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
