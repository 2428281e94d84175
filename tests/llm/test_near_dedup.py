"""Near copies against all pairs."""

import random

from nightloom.llm import near_dedup
from nightloom.llm import common as C
from tests.compare import DATA, duck
from tests.llm import helpers as H


def made():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[n] = " ".join(w)
            n += 1
    texts |= {n: None, n + 1: "", n + 2: "   ", n + 3: "two Words", n + 4: "two words", n + 5: "Two\twords\n", n + 6: "word", n + 7: " ".join(["same"] * 50), n + 8: " ".join(["same"] * 70)}
    return texts


def test_components(spark):
    texts = made()
    sets = {i: H.shingles(t, 4) for i, t in texts.items()}
    want = H.linked(sets)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(H.table(spark, texts, extra=True)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in texts}


def test_whole_table(spark):
    texts = {r[0]: r[1] for r in duck().sql("SELECT doc_id, text FROM documents").fetchall()}
    want = H.linked({i: H.shingles(t, 4) for i, t in texts.items()})
    rows = near_dedup.op5_near_dedup(spark, DATA).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_odd_tables(spark):
    assert near_dedup.near_duplicates(H.empty(spark)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(H.table(spark, rows)).collect())
    assert got == sorted([("1", 3, 1), ("1", 3, 1), ("2", 3, 1), ("None", 3, None), ("None", 0, None)])


def test_rows_that_share_an_id(spark):
    """Each row goes by its own text, whatever the order of rows."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (3, a + " more"), (4, b + " more"), (9, b)]
    for some in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(H.table(spark, some)).collect())
        assert got == [(3, 3), (4, 4), (5, 3), (5, 4), (9, 4)]


def test_crowded_cells_are_cut(spark, monkeypatch):
    """The same crowd when a cell holds few postings."""
    monkeypatch.setattr(near_dedup, "BLOCK_POSTINGS", 300)
    texts = crowd()
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(H.table(spark, texts), near=1, least_alike=0.7).collect()}
    assert got == {i: i - i % 2 for i in texts}


def test_words_by_bit_parity_are_not_alike(spark):
    a = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    rows = {1: a, 2: a.translate(str.maketrans("ab", "ba")), 3: a.upper()}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(H.table(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_long_chains_contract(spark):
    n = 120
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 10 + n)] + [(500, 501), (501, 500), (502, 502)], "a long, b long")
    got = {r.node: r.label for r in near_dedup.components(links, C.shared_dir(spark)).collect()}
    assert got == {i: 10 for i in range(10, 11 + n)} | {500: 500, 501: 500}


def crowd():
    """Documents that share two thirds of their words, so prefixes but not enough likeness for a pair, and pairs of near copies among them."""
    rng = random.Random(5)
    word = lambda: f"x{rng.randrange(10**9)}"
    common = [word() for _ in range(78)]
    texts = {}
    for i in range(0, 500, 2):
        own = [word() for _ in range(42)]
        texts[i] = " ".join(common + own)
        for k in (8, 20, 32):
            own[k] = word()
        texts[i + 1] = " ".join(common + own)
    return texts


def test_crowded_prefixes_lose_no_partner(spark):
    texts = crowd()
    want = H.linked({i: H.shingles(t, 4) for i, t in texts.items()})
    assert want == {i: i - i % 2 for i in texts}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(H.table(spark, texts), near=1, least_alike=0.7).collect()}
    assert got == want
