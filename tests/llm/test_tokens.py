import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubelume.llm import op02_tokens as O2
from cubelume.llm import op08_token_ids as O8
from cubelume.llm import simple8b

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

TRICKY = ["a" * 9000 + " b" + "1" * 5000, "<|endoftext|>" * 900, "\n\n  x  \n" * 900, "日本語" * 3000 + " é " * 900, "it's  we're\t\t they'll " * 700, "", "  a", " a", "a ", "a  ", "a \n b", "x\x1c y", "\0 a b\0", " <|endoftext|> b", "a. b, c., it's. x_. 5. ²., \n. .", "É. Σ. İ, Ünï. ÀÉ, <|ENDOFTEXT|>, <|startoftext|>. x", "\na. \nb,\n.\n, a1.", "\n\na", " .", "²."]


@pytest.fixture(scope="module")
def texts(sf_dir):
    import duckdb

    return TRICKY + [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' LIMIT 120").fetchall()]


def test_counts(texts):
    path = P.path(O2.VOCABULARY)
    tok = tokenizers.Tokenizer.from_file(path)
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    for chunk, overlap in ((O2.CHUNK, O2.OVERLAP), (500, 50), (97, 5)):
        assert O2.count_tokens(texts, path, chunk, overlap) == want


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab 1.,'\n\té<|endoftext|>日", max_size=400), st.sampled_from([(40, 8), (64, 2)]))
def test_splices(text, size):
    path = P.path(O2.VOCABULARY)
    tok = O2.tokenizer(path)
    assert O2.count_tokens([text], path, *size) == [len(tok.encode(text, add_special_tokens=False).ids)]


def test_ids(texts):
    path = P.path(O8.VOCABULARY)
    tok = tokenizers.Tokenizer.from_file(path)
    for _ in range(2):  # from the cache, too
        ids, ends = O8.encode_texts(texts, path)
        start = 0
        for t, end in zip(texts, ends, strict=True):
            assert ids[start:end].tolist() == [*tok.encode(t, add_special_tokens=False).ids, O8.END], t[:40]
            start = end


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB 1.,'\n\té<|endoftext|>Σ", max_size=200))
def test_ids_of_any_text(text):
    path = P.path(O8.VOCABULARY)
    assert O8.encode_texts([text], path)[0].tolist()[:-1] == O2.tokenizer(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700), st.sampled_from([16, 128, 1024]))
def test_simple8b(values, block):
    v = np.array(values, np.uint64)
    data = simple8b.encode(v, block)
    assert (simple8b.decode(data) == v).all()
    for b in range(-(-len(v) // block)):
        assert (simple8b.decode_block(data, b) == v[b * block : (b + 1) * block]).all()


def test_simple8b_packs():
    assert len(simple8b.encode(np.zeros(120_000, np.uint64))) < 120_000 / 13
    v = np.array([random.Random(1).randrange(50_000) for _ in range(10_000)], np.uint64)
    assert len(simple8b.encode(v)) < 2.7 * len(v)
    with pytest.raises(ValueError):
        simple8b.decode(b"x" * 64)


def test_round_trip_of_odd_rows(odd, empty):
    rows = O8.round_trip(odd).orderBy("start").collect()
    tok = O2.tokenizer(P.path(O8.VOCABULARY))
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7]
    texts = {1: "", 2: "", 3: "the of and " * 20_000, 4: "only two", 5: "", 6: "x" * 50_000, 7: "été \U0001f600 日本語", None: "no id here at all"}
    start = 0
    for r in rows:
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert O8.round_trip(empty).count() == 0


def test_counts_of_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in O2.token_counts(odd).collect()}
    assert (1, 0, 0) in got and (2, 0, 0) in got and (6, 50_000, O2.count_tokens(["x" * 50_000], P.path(O2.VOCABULARY))[0]) in got
    assert O2.token_counts(empty).count() == 0


def test_other_vocabularies_are_encoded_whole(tmp_path):
    import shutil

    from cubelume.llm import op02_tokens as T2
    from cubelume.llm import op08_token_ids as T8

    texts = ["The  quick brown fox, a/b c.", None, "", "x" * 300]
    for module, name in ((T2, T2.VOCABULARY), (T8, T8.VOCABULARY)):
        other = shutil.copy(T2.vocabulary_path(name), tmp_path / f"other-{name[:4]}.json")
        path = str(other)
        want = [len(T2.tokenizer(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
        if module is T2:
            assert T2.count_tokens(texts, path) == want
        else:
            ids, ends = T8.encode_texts(texts, path)
            assert np.diff(ends, prepend=0).tolist() == [n + 1 for n in want] and len(ids) == ends[-1]


def test_limit(spark):
    from cubelume.llm import op02_tokens as T2

    df = spark.createDataFrame([(1, " a" * 512), (2, " a" * 513)], "doc_id long, text string")
    rows = {r.doc_id: r.n_tokens > T2.LIMIT for r in T2.token_counts(df).collect()}
    assert rows == {1: False, 2: True}


def test_ids_of_rows_without_doc_id_in_many_parts(spark):
    from cubelume.llm import op08_token_ids as T8
    from cubelume.llm.common import scratch_path

    df = spark.range(400).selectExpr("CAST(IF(id % 2 = 0, NULL, id) AS long) AS doc_id", "repeat('word ', 1 + id % 50) AS text")
    at = scratch_path(spark, "test-ids")
    T8.write(df, at, parts=8)
    rows = T8.read(spark, at).collect()
    rows.sort(key=lambda r: r.start)
    assert len(rows) == 400 and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(400)]
    ids = [r.doc_id for r in rows]
    assert ids[:200] == [None] * 200 and ids[200:] == sorted(ids[200:])
