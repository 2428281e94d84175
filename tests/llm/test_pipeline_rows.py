"""Pipeline stages and line dedup judge rows, not ids: rows that share an id, copies without one, and texts with very many lines."""

import time

from pyspark.sql import functions as F

import corpus_pipeline as P
from nightloom.llm import common as C
from nightloom.llm import line_dedup, near_dedup, quality
from tests.compare import DATA, duck
from tests.llm import helpers as H
from tests.llm.test_native import deduped

TEXT = "one two three four five six seven eight nine ten eleven twelve"
OTHER = "a wholly different text which shares none of those words with the first"


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def stage(name):
    return dict(P.STAGES)[name]


def test_near_dedup_keeps_unlike_texts_under_one_id(spark):
    docs = [(3, TEXT), (7, TEXT + " more"), (7, OTHER)]
    assert rows(stage("near_dedup")(spark, H.table(spark, docs, extra=True), DATA)) == [(3, TEXT), (7, OTHER)]


def test_near_dedup_leaves_one_of_copies(spark):
    docs = [(None, TEXT), (None, TEXT), (4, TEXT), (4, TEXT), (9, TEXT + " more"), (None, OTHER), (None, OTHER), (1, None), (1, None), (2, ""), (None, " ")]
    got = rows(stage("near_dedup")(spark, H.table(spark, docs, extra=True), DATA))
    assert got == sorted([(4, TEXT), (None, OTHER), (1, None), (1, None), (2, ""), (None, " ")], key=str)


def test_near_dedup_against_brute_force_over_rows(spark):
    texts = duck().sql("SELECT doc_id % 70, text FROM documents ORDER BY doc_id").fetchall()  # ids shared by several rows
    want = H.linked({k: H.shingles(t, 5) for k, (_, t) in enumerate(texts)})
    least = {}
    for k, c in want.items():
        least[c] = min(least.get(c, (1 << 60, 0)), (texts[k][0], k))
    got = rows(near_dedup.keep_one(H.table(spark, texts).coalesce(1)))
    assert sorted(i for i, _ in got) == sorted(i for i, _ in least.values())
    sets = [H.shingles(t, 5) for _, t in got]
    assert sum(1 for s in sets if s) == sum(1 for k in {k for _, k in least.values()} if H.shingles(texts[k][1], 5))


def test_decontamination_keeps_clean_rows_under_a_leaking_id(spark):
    item = duck().sql("SELECT text FROM benchmark WHERE length(text) > 40 ORDER BY item_id LIMIT 1").fetchall()[0][0]
    docs = [(1, item), (1, OTHER), (2, "a " + item + " b"), (None, item), (None, OTHER), (None, None), (5, "")]
    got = rows(stage("benchmark_decontamination")(spark, H.table(spark, docs, extra=True), DATA))
    assert got == sorted([(1, OTHER), (None, OTHER), (None, None), (5, "")], key=str)


def test_all_stages_on_odd_rows(spark):
    docs = H.table(spark, [(1, None), (2, ""), (None, TEXT), (None, TEXT), (3, OTHER), (3, OTHER), (3, TEXT), (8, "z" * 3000), (8, "\n\n")], extra=True)
    plain = C.documents_only(docs)
    labels = C.table(spark, DATA, "labels").where(C.fold(F.col("doc_id"), 3) != 1)
    model = quality.train(plain, labels)
    want = sorted(((r.doc_id) for r in quality.score_quality(plain, model).collect() if r.score >= P.LEAST_QUALITY), key=str)
    good = stage("quality_classifier")(spark, docs, DATA)
    assert good.columns == docs.columns and [i for i, _ in rows(good)] == want
    out = docs
    for name, run in P.STAGES[1:4]:
        out = C.stored(run(spark, out, DATA), f"{C.shared_dir(spark)}/{name}")
        assert out.columns == docs.columns
    assert sorted(i or 0 for i, _ in rows(out)) == [1, 2, 3, 3, 8, 8]
    pieces = P.STAGES[4][1](spark, out, DATA).collect()
    assert len(pieces) == 6 and all(r.exact for r in pieces)


def test_line_dedup_of_many_lines(spark):
    """Three documents share 100,000 lines: the work grows with lines, not with their square."""
    shared = "\n".join(f"a line of the log that is long enough {k}" for k in range(100_000))
    docs = [(1, shared), (2, shared + "\nlast line"), (3, shared), (4, "own")]
    began = time.time()
    got = {r.doc_id: (r.lines, r.dropped_lines, r.kept_text) for r in line_dedup.dedup_lines(H.table(spark, docs)).collect()}
    assert got == {1: (100_000, 100_000, ""), 2: (100_001, 100_000, "last line"), 3: (100_000, 0, shared), 4: (1, 0, "own")}
    assert time.time() - began < 60


def test_line_dedup_rows_under_one_id(spark):
    line = "a line that is surely longer than twenty"
    docs = [(None, f"{line}\nx"), (None, f"y\n{line}"), (None, f"{line}\nx"), (1, f"{line}\n{line}"), (2, f"z\n{line}")]
    got = [(r.doc_id, r.kept_text) for r in line_dedup.dedup_lines(H.table(spark, docs)).collect()]
    assert sorted(got, key=str) == sorted([(None, "x"), (None, "y"), (None, "x"), (1, ""), (2, f"z\n{line}")], key=str)


def test_line_dedup_batches_from_bytes(spark, monkeypatch):
    texts = duck().sql("SELECT doc_id, text FROM documents").fetchall()
    monkeypatch.setattr(line_dedup, "BATCH_BYTES", sum(len((t or "").encode()) for _, t in texts) // 7)
    made = []
    monkeypatch.setattr(line_dedup.LineRuns, "_compact", lambda self, level, old=line_dedup.LineRuns._compact: (made.append(level), old(self, level)))
    got = sorted((r.doc_id, r.lines, r.kept_text) for r in line_dedup.dedup_lines(H.table(spark, texts)).collect())
    assert got == deduped(texts) and made
