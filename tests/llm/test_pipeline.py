"""Each stage of the corpus pipeline against brute force on what the stage before it kept."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from nightloom.llm import common as C
from nightloom.llm import quality
from tests.compare import DATA, duck
from tests.llm import helpers as H
from tests.llm.test_native import deduped


def test_stages(spark):
    docs = C.table(spark, DATA, "documents")
    columns = docs.columns
    items = [H.shingles(t, 5) for (t,) in duck().sql("SELECT text FROM benchmark").fetchall()]
    texts = dict(duck().sql("SELECT doc_id, text FROM documents").fetchall())
    for k, (name, stage) in enumerate(P.STAGES):
        out = C.stored(stage(spark, docs, DATA), f"{C.shared_dir(spark)}/{k}")
        rows = out.collect()
        if name != P.STAGES[-1][0]:
            assert out.columns == columns and all(r.n_chars == len(r.text) for r in rows)
            got = {r.doc_id: r.text for r in rows}
        if name == "quality_classifier":
            labels = C.table(spark, DATA, "labels").where(C.fold(F.col("doc_id"), 3) != 1)
            plain = C.documents_only(docs)
            scores = quality.score_quality(plain, quality.train(plain, labels)).collect()
            assert set(got) == {r.doc_id for r in scores if r.score >= P.LEAST_QUALITY} and 0.5 * len(texts) < len(got) < len(texts)
        elif name == "line_dedup":
            assert got == {i: t for i, _, t in deduped(list(texts.items()))}
        elif name == "near_dedup":
            want = H.linked({i: H.shingles(t, 5) for i, t in texts.items()})
            assert set(got) == {i for i, c in want.items() if i == c}
        elif name == "benchmark_decontamination":
            assert set(got) == {i for i, t in texts.items() if not any(b and len(H.shingles(t, 5) & b) >= 0.8 * len(b) for b in items)}
        else:
            assert {r.doc_id for r in rows} == set(texts) and all(r.exact for r in rows)
        texts, docs = got, out


def test_odd_rows(spark):
    docs = H.table(spark, [(1, None), (2, ""), (None, "some text of a null id"), (3, "good words here"), (3, "other words there")], extra=True)
    for _, stage in P.STAGES[1:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert out.count() == 5
    for _, stage in P.STAGES[:4]:
        assert stage(spark, H.empty(spark), DATA).count() == 0
