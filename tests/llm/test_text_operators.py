import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelume.llm import op03_toxicity as O3
from cubelume.llm import op07_decontamination as O7
from cubelume.llm import op09_licenses as O9
from cubelume.llm import op10_language as O10
from cubelume.llm.words import shingles, word_hashes

WORDS = ["stupid", "moron", "river", "table", "green", "window", "people", "yesterday", "something", "the", "and", "of", "idiot", "house"]


def model_of(words):
    counts = np.zeros(O3.SYMBOLS**3)
    for w in words:
        counts += sum(np.bincount(x, minlength=O3.SYMBOLS**3) for x in O3.trigrams(" ".join([w] * 30)))
    return O3.language_model(counts)


@pytest.mark.parametrize("hidden, word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("$tup!d", "stupid"), ("i.d.i.o.t", "idiot"), ("m-o-r-o-n", "moron"), ("st*pid", "stupid")])
def test_restores(hidden, word):
    assert word in O3.Restorer(model_of(WORDS)).token(hidden)


def test_restores_spaced_letters_and_leaves_plain_words():
    r = O3.Restorer(model_of(WORDS))
    assert "idiot" in r.words("you i d i o t there") and r.words("The river, people.") == {"the", "river", "people"}
    assert r.words(None) == set() and r.words("!!! 123") == set()


@pytest.mark.parametrize("hidden, word", [("+rash", "trash"), ("(lown", "clown"), ("|diot", "idiot"), ("*diot", "idiot"), ("alib!", "alibi"), ("(|diot)", "idiot"), ("stuupid", "stupid"), ("mooron", "moron"), ("stuppid!", "stupid")])
def test_restores_signs_at_the_ends_and_doubled_letters(hidden, word):
    assert word in O3.Restorer(model_of([*WORDS, "trash", "clown", "alibi"])).token(hidden)


@pytest.mark.parametrize("text, word", [("you id iot there", "idiot"), ("the stu pid house", "stupid"), ("the mor on table", "moron"), ("st u pid", "stupid"), ("a stup id river", "stupid"), ("the 1d iot", "idiot"), ("people $tu pid", "stupid")])
def test_restores_words_in_short_pieces(text, word):
    m = model_of(WORDS)
    assert word in O3.Restorer(m).words(text)
    scored = O3.Model(m, {word: 3.0}, (-2.0, 2.0, 0.0))
    assert scored.score(text) > 0.9 > 0.5 > scored.score("the green river") and scored.score(text) == scored.score(text)


def test_gaps_one_by_one_read_as_viterbi_does():
    lm, r = model_of(WORDS), random.Random(5)
    restorer = O3.Restorer(lm)
    for _ in range(300):
        run = r.choice("aeimnoprstu") + r.choice("ido")
        for _ in range(r.randrange(1, 4)):
            run += r.choice([" ", " ", "-", ". "]) + "".join(r.sample("stupidmorne", r.randrange(1, 5)))
        parts = [m[0] for m in O3._PART.finditer(run)]
        want = set(O3.viterbi(run, lm).split())
        assert want <= restorer.pieces(run) | set(parts)
        assert len(parts) > 2 or restorer.pieces(run) <= want


def test_viterbi_is_the_least_cost_path():
    lm, r = model_of(WORDS), random.Random(3)
    table = O3._symbol_table()

    def cost(choices):
        (a, b), total = (0, 0), 0.0
        for what, c in choices:
            total += c
            for ch in what:
                s = int(table[ord(ch)])
                if s or b:
                    total += float(lm[a, b, s])
                a, b = (b, s) if s else (0, 0)
        return total

    def every(rest):
        if not rest:
            yield []
        else:
            for c in rest[0]:
                for t in every(rest[1:]):
                    yield [c, *t]

    for _ in range(40):
        s = "".join(r.choice("ido10.s$t") for _ in range(6))
        best = min(every([*O3.lattice(s), [(" ", 0.0)]]), key=lambda p: (round(cost(p), 6), "".join(w for w, _ in p)))
        assert cost(best) == pytest.approx(min(cost(p) for p in every([*O3.lattice(s), [(" ", 0.0)]])))
        got = O3.viterbi(s, lm)
        assert any("".join(w for w, _ in p) == got and cost(p) == pytest.approx(cost(best), abs=1e-5) for p in every([*O3.lattice(s), [(" ", 0.0)]]))


def test_toxicity_learns(spark, odd, empty):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(WORDS[2:12], k=30) + (["moron"] if i % 4 == 0 else []))) for i in range(300)]
    rows += [(1000, "such a m0r0n walks"), (1001, "a green river")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(301, None)], "doc_id long, toxic int")
    m = O3.train(docs, labels)
    score = {x.doc_id: x.s for x in docs.select("doc_id", O3.toxicity(F.col("text"), m, spark).alias("s")).collect()}
    assert all((score[i] >= O3.THRESHOLD) == (i % 4 == 0) for i in range(300)) and score[1000] >= O3.THRESHOLD > score[1001]
    assert odd.select(O3.toxicity(F.col("text"), m, spark).alias("s")).where("s >= 0 AND s <= 1").count() == 9
    nothing = O3.train(empty, labels)
    assert nothing.beta is None and nothing.score("x") == 0.0


def test_held_out_toxicity(spark, sf_dir):
    out = O3.op3_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    assert out.where("predicted = 1 AND toxic = 0").count() <= 0.1 * out.count()


def test_held_out_rates(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest one has nine toxic texts to learn from
    out = O3.op3_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out")
    n = {r.toxic: (r.hit, r.n) for r in out.groupBy("toxic").agg(F.sum("predicted").alias("hit"), F.count("*").alias("n")).collect()}
    assert n[0][0] <= 0.1 * n[0][1] and n[1][0] >= 0.3 * n[1][1]


def test_lexicon_and_scores_against_plain_python(spark):
    r = random.Random(11)
    toxic, clean = ["moron", "idiots", "idiotic"], [w for w in WORDS if w not in ("moron", "idiot", "stupid")]
    rows = []
    for i in range(240):
        bad = i % 4 == 0
        words = r.choices(clean, k=20) + ([r.choice(toxic)] if bad and r.random() < 0.9 or not bad and r.random() < 0.03 else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    m = O3.train(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    restorer = O3.Restorer(m.lm)
    said = [restorer.words(text) for _, text, _ in rows]
    label = np.array([t for *_, t in rows])
    n_t, n_c = label.sum(), (1 - label).sum()
    have: dict[str, list[int]] = {}
    for i, words in enumerate(said):
        for k in {k for w in words for k in O3.keys(w)}:
            have.setdefault(k, []).append(i)

    def weight(t, c, n_t, n_c, e):
        return np.log((t + 0.5) / (n_t + 1)) - np.log((c + 0.5) / (n_c + 1)) - e * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))

    counts = {k: (label[v].sum(), (1 - label[v]).sum()) for k, v in have.items()}
    counts = {k: x for k, x in counts.items() if x[0] >= 2}
    want = {k: w for k, (t, c) in counts.items() if (w := weight(t, c, n_t, n_c, m.errors)) > O3.LEAST}
    assert m.lexicon == pytest.approx(want) and want
    losses = []
    for e in O3.ERRORS:
        top, n = np.zeros(len(rows)), np.zeros(len(rows))
        for i, words in enumerate(said):
            own = [max((weight(counts[k][0] - label[i], counts[k][1] - 1 + label[i], n_t - label[i], n_c - 1 + label[i], e) for k in O3.keys(w) if k in counts and weight(counts[k][0], max(counts[k][1] - 1, 0), n_t, n_c, O3.ERRORS[0]) > O3.LEAST), default=0) for w in words]
            own = [x for x in own if x > O3.LEAST]
            top[i], n[i] = max(own, default=0), len(own)
        losses.append(O3._fitted(label.astype(float), top, n))
    least = min(losses, key=lambda x: x[0])
    best = max(i for i, x in enumerate(losses) if x[0] <= least[0] + least[1])
    assert m.errors == O3.ERRORS[best] and m.beta == pytest.approx(losses[best][2], rel=1e-4)
    for words, (_, text, _) in zip(said, rows, strict=True):
        w = [x for word in words if (x := m.word_weight(word)) > 0]
        want = 1 / (1 + np.exp(-(m.beta[0] + m.beta[1] * max(w, default=0) + m.beta[2] * np.log1p(len(w)))))
        assert m.score(text) == pytest.approx(want)


def test_what_is_passed_over_has_no_weighted_reading():
    lm, r = model_of(WORDS), random.Random(12)
    restorer = O3.Restorer(lm)
    lexicon = {"idiot": 2.0, "5:stupi": 1.5, "4:moro": 1.2, "fool": 1.1, "as": 1.3}
    m = O3.Model(lm, lexicon, (-2.0, 2.0, 0.1))
    for _ in range(1500):
        run = ""
        for _ in range(r.randrange(2, 6)):
            run += "".join(r.choice(["stu", "pid", "id", "iot", "mo", "ron", "fo", "ol", "a", "s", "oo", "the", "ss", "t"])[:4]) + r.choice([" ", "-", ". "])
        run = run.rstrip(" -.")
        most = max((x for _, x in m.token_weights(restorer.pieces(run))), default=0.0)
        assert most <= max(m.hits(run).values(), default=0.0), run
        for t in run.split():
            assert m.token_weights(restorer.token(t)) == () or m.may(t), t


@pytest.mark.parametrize("text, word", [("stupi d man", "stupid"), ("the s tupid", "stupid"), ("yesterd ay", "yesterday"), ("a yest-erday", "yesterday"), ("some\nthing", "something"), ("$tupi  d", "stupid"), ("the yes.terd. ay house", "yesterday"), ("y e s t e r d a y", "yesterday"), ("peopl 3", "people")])
def test_pieces_of_any_length_are_joined(text, word):
    m = O3.Model(model_of(WORDS), {word: 3.0}, (-2.0, 2.0, 0.0))
    assert word in m.hits(text) and m.score(text) > 0.9
    assert m.hits("the green river, people") == {w: 3.0 for w in ["people"] if w == word}


def test_search_of_pieces_against_every_stretch():
    """Every stretch of neighbouring tokens' pieces is read; each first word that is longer than its first piece and has a weight is found."""
    lm, r = model_of(WORDS), random.Random(21)
    m = O3.Model(lm, {"idiot": 2.0, "5:stupi": 1.5, "6:yester": 1.2, "something": 1.1, "moron": 1.3, "of": 1.4}, (-2.0, 2.0, 0.1))
    costs, found = lm.ravel().tolist(), 0
    for _ in range(600):
        said = []
        for _ in range(r.randrange(2, 6)):
            w = r.choice([*WORDS, "1d10t", "m0ron", "st*pid", "yesterrday"])
            cut = r.randrange(1, len(w))
            said += [w[:cut], w[cut:]] if r.random() < 0.6 else [w]
        text = "".join(x + r.choice([" ", " ", "-", ". ", ", "]) for x in said)
        got = m.hits(text)
        for run in O3._STRETCH.finditer(text):
            spans = [x.span() for x in O3._PART.finditer(text, *run.span())]
            for i in range(len(spans)):
                for j in range(i + 1, len(spans)):
                    words = O3.best_reading(text[spans[i][0] : spans[j][1]], costs).split()
                    if words and len(O3.once(words[0])) > spans[i][1] - spans[i][0] and (x := m.word_weight(words[0])) > 0:
                        found += 1
                        # where the first piece has the weighted beginning, the word may be found under a shorter name
                        assert words[0] in got or any(words[0].startswith(w) and y >= x for w, y in got.items()), (text, words)
    assert found > 100


def test_long_stretches_take_time_in_proportion():
    import time

    lm = model_of(WORDS)
    costs, took = lm.ravel().tolist(), []
    for n in (20_000, 80_000):
        t = time.process_time()
        assert len(O3.best_reading("i-d" * (n // 3), costs)) > 0
        took.append(time.process_time() - t)
    assert took[1] < 8 * took[0]


def test_wand_finds_all_above(sf_dir):
    import duckdb

    index = max(O7.Index.of(duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()), key=lambda x: len(x.ids))
    r, n = random.Random(2), len(index.vocabulary)
    impact = np.zeros((n, len(index.ids)))
    for v, (at, x, _, _) in enumerate(index.postings):
        impact[v, at] = x
    for _ in range(300):
        item = r.randrange(len(index.ids))
        own = np.flatnonzero(impact[:, item]).tolist()
        query = sorted({*r.sample(own, r.randint(1, len(own))), *r.sample(range(n), r.randint(0, min(n, 200)))})
        least = r.choice([0.1, 0.3, 0.5, 0.7, 0.9])
        score = impact[query].sum(0)
        assert {i for i, _ in index.search(query, least)} == set(np.flatnonzero(score >= least - 1e-9))


def test_leaks_against_brute_force(spark, sf_dir, odd, empty):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    texts = {r.doc_id: f" {' '.join(words(r.text))} " for r in docs.collect()}
    want = {(d, i.item_id) for i in items.collect() for d, t in texts.items() if f" {' '.join(words(i.text))} " in t}
    got = {(r.doc_id, r.item_id) for r in O7.leaks(docs, items).collect()}
    assert want == got
    assert O7.leaks(odd, items).count() == 0 and O7.leaks(empty, items).count() == 0 and O7.leaks(docs, items.where("item_id < 0")).count() == 0


def test_a_changed_item_is_found_and_half_of_one_is_not(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    q, a = [word() for _ in range(20)], [word() for _ in range(8)]
    item, noise = " ".join(q) + ". " + " ".join(a) + ".", [word() for _ in range(400)]
    index = O7.Index.of([(1, item), (2, None), (3, " ".join(word() for _ in range(30)))])
    changed = [*q[:5], word(), *q[6:], *a]
    assert [x[:2] for x in O7.leaks_of(index, [" ".join(noise[:200] + changed + noise[200:]), " ".join(noise + q), " ".join(noise), None, ""])] == [(0, 1)]


def test_short_items_beside_a_long_one_are_found_in_one_place_only(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    short, noise = [[word() for _ in range(10)] for _ in range(5)], [word() for _ in range(9000)]
    items = [(0, " ".join(word() for _ in range(5000))), *((i + 1, " ".join(x)) for i, x in enumerate(short))]
    scattered = list(noise)
    for k, w in enumerate(short[0]):
        scattered[700 * k + 5] = w
    whole = noise[:4321] + short[1] + noise[4321:]
    docs = spark.createDataFrame([(1, " ".join(scattered)), (2, " ".join(whole)), (3, "x y " + items[0][1] + " z")], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x) for x in O7.leaks(docs, table).collect())
    assert [x[:2] for x in got] == [(2, 2), (3, 0)]


def test_slices_change_no_score(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(tuple(x) for x in O7.leaks(docs, items).collect())
    flags = sorted((x.doc_id, x.l) for x in docs.select("doc_id", O7.is_leaked(F.col("text"), items).alias("l")).collect())
    assert [d for d, f in flags if f] == sorted({x[0] for x in want})
    monkeypatch.setattr(O7, "SLICE_WORDS", 100)
    assert sum(1 for _ in O7.index_slices(items)) > 2
    got = sorted(tuple(x) for x in O7.leaks(docs, items).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.array(got) == pytest.approx(np.array(want))


def test_is_leaked_of_odd_texts(spark, sf_dir, odd, empty):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for docs in (odd, empty):
        assert docs.where(O7.is_leaked(F.col("text"), items)).count() == 0
    assert odd.where(~O7.is_leaked(F.col("text"), items)).count() == 9


def test_in_order():
    r = random.Random(4)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = [r.randrange(5) for _ in range(r.randrange(0, 15))], [r.randrange(5) for _ in range(r.randrange(0, 30))]
        assert O7.in_order(a, b) == plain(a, b)


def test_word_hashes():
    texts = ["The quick brown", None, "", "quick, THE!", "é日 x1"]
    h, n = word_hashes(texts)
    assert n.tolist() == [3, 0, 0, 2, 2] and h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 5
    s, k = shingles(h, n, 5)
    assert k.tolist() == [1, 0, 0, 1, 1] and len(s) == 3


def test_licenses_of_odd_rows(spark, odd, empty):
    rows = {(r.doc_id, r.n_words, r.n_base) for r in O9.scan(odd).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 60_000, 0), (4, 2, 0), (5, 0, 0), (6, 1, 0)} <= rows and O9.scan(odd).count() == 9
    assert O9.scan(empty).count() == 0
    df = spark.createDataFrame([(1, "x UNDER the MIT license, under the mit license CC by-nc"), (2, O9.TEMPLATES[1][1].replace("without limitation", "")), (3, "under the mit")], "doc_id long, text string")
    got = {r.doc_id: r for r in O9.scan(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 1, 9, "cc-by-nc,mit")
    assert got[2].labels == "mit" and got[2].n_base == 0 and 0.6 < got[2].score < 1 and got[3].labels == ""


def test_languages(spark, sf_dir, odd, empty):
    out = O10.op10_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang_pred = lang").count() >= 0.95 * held.count()
    m = O10.train(odd)
    rows = {(r.doc_id, r.lang_pred) for r in O10.with_language(odd, m, "lang_pred", "p").collect()}
    assert {(1, "und"), (2, "und"), (5, "und")} <= rows
    assert O10.train(empty).languages == [] and O10.train(empty).predict(["abc"]) == (["und"], [0.0])


def test_kernel_model_equals_its_parts(spark):
    """The scores by matrix products against the dual form: kernels counted from sets of n-grams, Nystroem map, ridge regression."""
    r, flags = random.Random(9), np.zeros(O10.WIDTH, bool)
    texts = [(lang, " ".join(r.choices(words, k=20))) for _ in range(20) for lang, words in (("a", ["aba", "abba", "caba"]), ("b", ["xyz", "zyx", "yyxz"]), ("c", ["aba", "xyz"]))]
    rows = [(lang, O10.grams(t, flags)) for lang, t in texts]
    m = O10.fit(rows, landmarks=10)
    sets = [set(g.tolist()) for _, g in rows]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = sets[:10]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = values > 1e-6
    half = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.array([[kernel(a, b) for b in marks] for a in sets]) @ half
    y = np.array([[1.0 if lang == x else -1.0 for x in "abc"] for lang, _ in texts])
    weight = np.linalg.solve(phi.T @ phi + O10.RIDGE * len(sets) * np.eye(phi.shape[1]), phi.T @ y)
    labels, scores = m.predict([t for _, t in texts])
    for margin, label, score in zip(phi @ weight, labels, scores, strict=True):
        assert "abc"[int(margin.argmax())] == label
        assert score == pytest.approx(1 / np.exp(8 * (margin - margin.max())).sum(), abs=1e-3)
    assert labels[:2] == ["a", "b"]
    # a text's score doesn't depend on what is in its batch
    assert [m.predict([t])[1][0] for _, t in texts] == scores
    # the fit over Spark is the same as the one in one place
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    over = O10.train(docs, landmarks=60)
    alone = O10.fit(rows, landmarks=60)
    assert over.predict([t for _, t in texts])[0] == alone.predict([t for _, t in texts])[0]
    assert over.predict(["aba xyz"])[1][0] == pytest.approx(alone.predict(["aba xyz"])[1][0], abs=1e-6)
    long = "abc def. " * 300_000
    assert set(O10.grams(long, flags).tolist()) == set(O10.grams(long[:90], flags).tolist())


def test_language_of_rows_without_id_and_of_clashing_names(spark, sf_dir):
    df = spark.createDataFrame([(None, "the river runs", "en", 1), (5, "der Fluss", "de", 2)], "doc_id long, text string, lang string, language_found int")
    out = O10.with_language(df, O10.train(df), "l", "s")
    assert out.columns == [*df.columns, "l", "s"] and sorted(r.language_found for r in out.collect()) == [1, 2]


def plain_leaks(items, texts):
    """Every window of every text against every item: BM25 shares, then subsequences in stretches of twice the item's length."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    both = {i: [words(x) for x in O7.parts(t)] for i, t in items.items()}
    of = {i: q + a for i, (q, a) in both.items() if q + a}
    mean, n, found = sum(map(len, of.values())) / len(of), len(of), {}
    idf = {w: np.log(1 + (n - c + 0.5) / (c + 0.5)) for w in {w for x in of.values() for w in x} for c in [sum(w in x for x in of.values())]}
    weight = {i: {w: idf[w] * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in x} for i, x in of.items()}

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1] / len(a) if a else 1.0

    kind = lambda x: max(5, (len(x) - 1).bit_length())
    for i, x in of.items():
        longest, m = max(len(y) for y in of.values() if kind(y) == kind(x)), len(x)
        for d, t in texts.items():
            said = words(t)
            for at in range(-longest, len(said), longest):
                passage = said[max(at, 0) : at + 2 * longest] if at >= 0 else []
                score = sum(v for w, v in weight[i].items() if w in set(passage)) / sum(weight[i].values())
                if score < 0.7 - 1e-9:
                    continue
                for b in range(0, max(len(passage) - m, 1), -(-m // 2)):
                    shares = tuple(common(y, passage[b : b + 2 * m]) for y in both[i])
                    if min(shares) >= 0.8:
                        found[d, i] = max(found.get((d, i), (0.0,)), (score, *shares))
    return found


def test_changed_items_against_plain_scores(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghijklm") for _ in range(4)) for _ in range(150)]
    said = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {i: " ".join(said(r.randrange(4, 45))) + ". " + " ".join(said(r.randrange(1, 12))) + "?" for i in range(40)}
    items[40] = items[3]
    items[41] = " ".join(said(9))
    texts = {}
    for d in range(120):
        x = items[r.randrange(42)].split()
        for _ in range(int(len(x) * r.choice([0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.5]))):
            at = r.randrange(len(x))
            what = r.randrange(4)
            if what == 0:
                x[at] = r.choice(vocabulary)
            elif what == 1:
                x.insert(at, r.choice(vocabulary))
            elif what == 2 and len(x) > 1:
                del x[at]
            else:
                x[at], x[-1 - at] = x[-1 - at], x[at]
        texts[d] = " ".join(said(r.randrange(0, 120)) + x + said(r.randrange(0, 90)))
    want = plain_leaks(items, texts)
    docs, table = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.score, x.question, x.answer) for x in O7.leaks(docs, table).collect()}
    assert got.keys() == want.keys() and 30 < len(got) < 120
    for k, v in got.items():
        assert v == pytest.approx(want[k], abs=1e-6)


def test_the_sample_stays_within_its_bound(spark):
    """One clean id has thousands of texts, and one of them thousands of times."""
    rows = [(1, f"plain words number {i % 700}") for i in range(3000)] + [(2, "plain words")] * 2000 + [(i, "you moron" if i % 2 else "fine day") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 and i > 2)) for i in range(1, 60)], "doc_id long, toxic int")
    seen = []
    fitted = O3._fitted

    def watched(y, top, n):
        seen.append((int(y.sum()), len(y)))
        return fitted(y, top, n)

    O3._fitted = watched
    try:
        m = O3.train(docs, labels, most_toxic=50, most_clean=100)
    finally:
        O3._fitted = fitted
    assert seen and all(t == 29 and n == 129 for t, n in seen)
    assert m.score("you moron") > 0.5 > m.score("fine day")
