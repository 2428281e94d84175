"""Trained operators: held-out accuracy, exactness of their parts, odd tables."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm import language, ngram_lm, quality, samples, toxicity
from nightloom.llm import wordhash as W
from nightloom.llm.elias_fano import EliasFano
from tests.compare import duck
from tests.llm import helpers as H

SF = "/root/testdata/sf0.01"
ODD = {1: None, 2: "", 3: " \n", 4: "123 456", 5: "Ωmega Ünï", 6: "word " * 3000}


def against_labels(rows, column, threshold_share):
    labels = dict(duck(SF).sql(f"SELECT doc_id, {column} FROM labels").fetchall())
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= threshold_share * len(held)


def test_quality_held_out(spark):
    rows = quality.op2_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (H.fold(r.doc_id, 3) == 1) for r in rows)
    against_labels(rows, "quality", 0.95)


def test_toxicity_held_out(spark):
    rows = toxicity.op3_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (H.fold(r.doc_id, 4) == 2) for r in rows)
    against_labels(rows, "toxic", 0.95)
    labels = dict(duck(SF).sql("SELECT doc_id, toxic FROM labels").fetchall())
    toxic = [r.predicted for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    clean = [r.predicted for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    assert sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_toxicity_neighbours_are_the_nearest_by_whole_vectors(spark):
    """The evidence of every document of a table against dense vectors over all terms."""
    docs = C.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    model = toxicity.train(docs, C.table(spark, "/root/testdata/sf0.001", "labels"))
    column = pa.array([r.text for r in docs.orderBy("doc_id").collect()], pa.string())
    index = model["index"]
    dense = np.zeros((len(index.ids), len(model["terms"])))
    for e in range(len(index.ids)):
        part = slice(index.edge[e], index.edge[e + 1])
        dense[e, index.terms[part]] = index.weights[part]
    assert np.allclose((dense**2).sum(axis=1), 1)
    ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: r.evidence for r in toxicity.score_toxicity(docs, model).collect()}
    some = 0
    for row, terms, weight in toxicity._vectors(model["terms"], model["weight"], column):
        cosine = dense[:, terms] @ weight
        order = np.lexsort((index.ids, -np.round(cosine, 9)))[: toxicity.NEAREST]
        assert got[ids[row]] == index.ids[order[cosine[order] > 0]].tolist()
        some += 1
    assert some > 150


def test_language_held_out(spark):
    rows = language.op9_language(spark, SF).collect()
    lang = dict(duck(SF).sql("SELECT doc_id, lang FROM documents").fetchall())
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.98 * len(held)


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 0, 0), (99, 0, 1)]])
def test_classifiers_without_enough_labels(spark, labels):
    docs = H.table(spark, ODD).select("doc_id", "text")
    some = spark.createDataFrame(labels, LABELS)
    for module, score in ((quality, quality.score_quality), (toxicity, toxicity.score_toxicity)):
        got = score(docs, module.train(docs, some)).collect()
        assert sorted(r.doc_id for r in got) == sorted(ODD) and all(0 <= r.score <= 1 for r in got)
        assert score(H.empty(spark), module.train(docs, some)).count() == 0


def test_block_max_is_exact():
    rng = np.random.default_rng(0)
    examples = []
    for i in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(t))
        examples.append((i * 3, int(rng.integers(2)), t, w / np.sqrt((w**2).sum())))
    index = toxicity.BlockMax(examples, 40)
    dense = np.zeros((500, 40))
    for n, (_, _, t, w) in enumerate(examples):
        dense[n, t] = w
    for _ in range(50):
        t = np.sort(rng.choice(40, rng.integers(1, 10), replace=False))
        w = rng.random(len(t))
        cosine = dense[:, t] @ w
        order = np.lexsort((np.arange(500), -np.round(cosine, 9)))[:8]
        order = order[cosine[order] > 0]
        near, score = index.nearest(t, w)
        assert index.ids[near].tolist() == [examples[n][0] for n in order] and np.allclose(score, cosine[order])


def test_language_odd_tables(spark):
    docs = H.table(spark, ODD).select("doc_id", "text")
    learn = [(10 + i, t, la) for i, (t, la) in enumerate([("the and with", "en"), ("der die das und", "de"), ("le la les et", "fr"), ("nothing", None)] * 6)]
    rows = spark.createDataFrame(learn, "doc_id long, text string, lang string")
    for some, known in ((rows, {"en", "de", "fr"}), (rows.where("lang = 'en'"), {"en"}), (rows.limit(0), set())):
        got = {r.doc_id: r for r in language.identify(docs, language.train(some)).collect()}
        assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4
        assert {got[i].lang_pred for i in (5, 6)} <= (known or {"und"})


def test_language_learns_from_its_rows_only(spark, tmp_path):
    """Other texts and languages of held-out rows leave the model and all other predictions as they were."""
    table = C.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    held = C.fold(F.col("doc_id"), 4) == 2
    other = table.withColumns({"text": F.when(held, F.concat(F.lit("qqq zzz xxx "), F.reverse("text"))).otherwise(F.col("text")), "lang": F.when(held, F.lit("xx")).otherwise(F.col("lang"))})
    models, found = [], []
    for k, t in enumerate((table, other)):
        t.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        models.append(language.train(t.where(~held)))
        found.append({r.doc_id: r for r in language.op9_language(spark, f"{tmp_path}/{k}").collect()})
    for name in ("weights", "idf", "temperature"):
        assert np.array_equal(models[0][name], models[1][name])
    assert all(found[1][i] == r for i, r in found[0].items() if not r.held_out) and "xx" not in {r.lang_pred for r in found[1].values()}


def test_language_scores_spread(spark):
    table = C.table(spark, SF, "documents")
    model = language.train(table.where(C.fold(F.col("doc_id"), 4) != 2))
    assert np.exp(-7) < model["temperature"] < np.exp(7)
    whole = duck(SF).sql("SELECT lang, arg_min(text, doc_id) FROM documents WHERE length(text) > 500 AND lang IS NOT NULL GROUP BY lang ORDER BY lang").fetchall()
    texts = [t[k : k + 3000] for _, t in whole for k in (0,)] + [whole[0][1][:300] + " " + whole[1][1][:300]] + [t[20:26] for _, t in whole] + ["x", "aa 1"]
    got = {r.doc_id: r.score for r in language.identify(H.table(spark, dict(enumerate(texts))), model).collect()}
    n = len(whole)
    assert len({round(s, 4) for s in got.values()}) > n and max(got.values()) < 1
    assert np.mean([got[i] for i in range(n)]) > np.mean([got[i] for i in range(n + 1, 2 * n + 1)]) and got[n] < max(got[i] for i in range(n))


def test_temperature_of_separated_rows_is_inside_its_bounds():
    y = np.arange(90) % 3
    for scale in (0.1, 1, 50):
        t = language.temperature(scale * np.eye(3)[y], y)
        p = np.exp(scale / t) / (np.exp(scale / t) + 2)
        assert p == pytest.approx(91 / 93, abs=1e-3)


def test_repeated_rows_ties_and_long_texts(spark):
    """Every row is scored by its own text, rows that share all of doc_id and text alike, whatever the length."""
    long = "lorem ipsum dolor " * 40_000
    rows = [(1, "same text here"), (1, "same text here"), (1, None), (2, long), (None, "same text here")]
    docs = H.table(spark, rows, extra=True)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], LABELS)
    learn = H.table(spark, [(i, ("good words about things " if i % 2 else "bad bad stuff ") * 30) for i in range(1, 9)])
    langs = spark.createDataFrame([(i, "the and" if i % 2 else "der und", "en" if i % 2 else "de") for i in range(30)], "doc_id long, text string, lang string")
    for got in (
        quality.score_quality(docs, quality.train(learn, labels)),
        toxicity.score_toxicity(docs, toxicity.train(learn, labels)),
        language.identify(docs, language.train(langs)),
        ngram_lm.score(docs, ngram_lm.train(docs)),
    ):
        got = got.collect()
        assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "None"]
        assert len({round(r.score, 12) for r in got if r.doc_id == 1}) <= 2 and all(math.isfinite(r.score) for r in got)
    tie = {"languages": ["aa", "bb"], "weights": np.zeros((language.FEATURES + 1, 2)), "idf": np.ones(language.FEATURES), "temperature": 1.0}
    assert {(r.lang_pred, r.score) for r in language.identify(docs, tie).where("doc_id = 2").collect()} == {("aa", 0.5)}


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(1)
    examples = [(np.append(rng.choice(50, 5, replace=False) + 50 * y, language.FEATURES), np.append(np.full(5, 0.4), 1.0), y) for y in rng.integers(0, 3, 300)]
    w = language.ftrl(examples, 3)
    assert all((x @ w[f]).argmax() == y for f, x, y in examples) and (w[200:-1] == 0).all()


@pytest.mark.parametrize(("n", "universe"), [(0, 1), (1, 1), (1, 2**64 - 1), (300, 300), (300, 400), (2000, 2**40), (5000, 2**63)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n, dtype=np.uint64)) if n != universe else np.arange(n, dtype=np.uint64)
    e = EliasFano.decode(EliasFano.encode(v, universe).arrays())
    assert (e.access(np.arange(len(v))) == v).all()
    x = np.concatenate([v, v + np.uint64(1), rng.integers(0, universe, 500, dtype=np.uint64)])
    x = x[x < universe]
    rank, found = e.successor(x)
    assert (rank == np.searchsorted(v, x)).all() and (found == np.isin(x, v)).all()


def test_word_hashes():
    texts = ["Hello  WORLD\tfoo", None, "", " é x\n", "hello"]
    got = []
    for i, j, data, off in W.slices(pa.array(texts)):
        w = W.Words(data, off)
        got += [w.hash[a:b].tolist() for a, b in zip(w.text_at, w.text_at[1:], strict=False)]
    assert got == [[W.word_hash(x) for x in H.words(t)] for t in texts]
    assert len({W.word_hash(f"{a}{b}") for a in range(300) for b in "xyz"}) == 900


def parity_words(n=1024):
    """Words that every sum of powers modulo a power of two hashes alike."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 256, 264, 1024, 2048, 4096])
def test_words_by_bit_parity_differ(n):
    a, b = parity_words(n)
    assert W.word_hash(a) != W.word_hash(b) and W.word_hash(a) == W.word_hash(a.upper())


def test_words_by_bit_parity_in_the_models(spark):
    a, b = parity_words()
    docs = H.table(spark, {1: a, 2: b}).select("doc_id", "text")
    got = {r.doc_id: r for r in ngram_lm.score(docs, ngram_lm.train(docs.where("doc_id = 1"))).collect()}
    assert (got[1].n_known, got[2].n_known) == (2, 1)
    columns = [W.Words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)])) for x in (a, b)]
    terms = [set(toxicity._terms(w)[0].tolist()) for w in columns]
    assert not terms[0] & terms[1]


def brute_scores(texts, train, prune, order):
    """id -> (n_tokens, n_known, base, score) by the formula, from plain counters of all n-grams."""
    grams = [Counter() for _ in range(order + 1)]
    tokens = {i: ["<s>", *H.words(t), None] for i, t in texts.items()}
    for i in train:
        t = tokens[i]
        for k in range(1, order + 1):
            grams[k].update(tuple(t[j : j + k]) for j in range(max(0, 2 - k), len(t) - k + 1))
        grams[1][("<s>",)] += 1
    n = sum(c for (w,), c in grams[1].items() if w != "<s>")
    v = len(grams[1]) - (1 if train else 0)
    p1 = lambda w: (grams[1][(w,)] + 0.1) / (n + 0.1 * (v + 1))
    took, kept = [Counter() for _ in range(order + 1)], [{}, grams[1]]
    for k in range(2, order + 1):
        kept.append({g: c for g, c in grams[k].items() if c >= prune})
        for g, c in kept[k].items():
            took[k][g[:-1]] += c - 0.75

    def p(context, w):
        if not context:
            return p1(w)
        k = len(context) + 1
        if context not in took[k]:
            return p(context[1:], w)
        of = grams[k - 1][context]
        return (max(kept[k].get((*context, w), 0) - 0.75, 0)) / of + (1 - took[k][context] / of) * p(context[1:], w)

    out = {}
    for i, t in tokens.items():
        score = sum(math.log10(p(tuple(t[max(0, j - order + 1) : j]), t[j])) for j in range(1, len(t)))
        out[i] = len(t) - 1, sum(grams[1][(w,)] > 0 for w in t[1:]), sum(math.log10(p1(w)) for w in t[1:]), score
    return out, n, v


@pytest.mark.parametrize(("prune", "order"), [(2, 3), (1, 3), (3, 2), (2, 4)])
def test_language_model(spark, prune, order):
    texts = dict(duck().sql("SELECT doc_id, text FROM documents").fetchall()) | {5000: None, 5001: "", 5002: "the the unseenword the", 5003: "unseenword " * 40}
    docs = H.table(spark, texts, extra=True).select("doc_id", "text")
    train = [i for i in texts if H.fold(i, 10) != 0]
    model = ngram_lm.train(docs.where(docs.doc_id.isin(train)), prune, order)
    want, n, v = brute_scores(texts, train, prune, order)
    assert (model["n"], model["v"]) == (n, v) and len(model["above"]) == order - 1
    off = 0.0
    for r in ngram_lm.score(docs, model).collect():
        n_tokens, n_known, base, score = want[r.doc_id]
        off += abs(r.score - score)
        assert (r.n_tokens, r.n_known) == (n_tokens, n_known) and r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(score, abs=0.05 * n_tokens)
    assert off < 0.003 * sum(x[0] for x in want.values())  # 8 bits a probability


def test_counts_of_large_numbers():
    rng = np.random.default_rng(3)
    for most in (50, 2**33, 2**62):
        c, w = (rng.integers(0, 6, 400) * (most // 6) for _ in range(2))
        got = ngram_lm._counted(c, w)
        assert dict(zip(zip(*(x.tolist() for x in got[:2]), strict=True), got[2].tolist(), strict=True)) == Counter(zip(c.tolist(), w.tolist(), strict=True))
        again = ngram_lm._counted(*(np.concatenate([x, x]) for x in got))
        assert (again[0] == got[0]).all() and (again[1] == got[1]).all() and (again[2] == 2 * got[2]).all()


def test_language_model_of_nothing(spark):
    docs = H.table(spark, ODD).select("doc_id", "text")
    got = ngram_lm.score(docs, ngram_lm.train(H.empty(spark).select("doc_id", "text"))).collect()
    assert sorted(r.doc_id for r in got) == sorted(ODD) and all(r.n_known == 0 for r in got)


def test_samples_are_bounded(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 10 = 0 AS INT) AS label")
    some, counts = samples.sample_by_class(rows, 100)
    got = Counter(r.label for r in some.collect())
    assert counts == {0: 4500, 1: 500} and all(60 < n < 140 for n in got.values())
