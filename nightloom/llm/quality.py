"""Quality by compression: which of two Zstandard dictionaries, of good and of bad text, fits a text better.

The dictionaries are trained on blocks of a bounded sample of labelled documents. A text is cut into blocks, each
block is compressed under both dictionaries, and the difference of the two total sizes over the text's bytes is
the measure. Two more go with it: the difference in the worst quarter of the blocks, so that a bad stretch inside a
long text shows, and the size in the smallest quarter, which is low for text that repeats itself. A logistic
regression on labelled documents that the dictionaries have not seen makes them a score.

Defined results: a null or empty text has a measure of 0 and so the score of a text that fits both alike; without
labels of both classes every score is the share of label 1 (0.5 without any); rows that share a doc_id are
scored each by its own text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm import samples as S

BLOCK = 1024
#: Bounds of the labelled sample: documents a class, and blocks of each that are kept for training a dictionary.
DOCS_A_CLASS, BLOCKS_A_DOC = 1500, 8
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: Bytes added to every length that a size is divided by, so that very short texts are not judged by a few bytes.
STEADY = 64
MEASURES = ["whole", "worst", "tight"]


def blocks_of(raw: bytes) -> list[bytes]:
    """The text's blocks; the last is not left much shorter than the others."""
    n = max(1, round(len(raw) / BLOCK))
    size = -(-len(raw) // n) if raw else 0
    return [raw[i : i + size] for i in range(0, len(raw), size)] if size else []


class Measure:
    """Compressors for the two dictionaries of a model."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[float, float, float]:
        """In bits a byte: what the good dictionary saves over the bad one, in all blocks and in their worst quarter,
        and the size under the good one in the smallest quarter (of a text of ordinary size where there is none)."""
        blocks = blocks_of((text or "").encode())
        if not blocks:
            return 0.0, 0.0, 4.0
        good = np.array([len(self.by[0].compress(b)) for b in blocks], float)
        saved = np.array([len(self.by[1].compress(b)) for b in blocks], float) - good
        size, few = len(blocks[0]) + STEADY, max(1, len(blocks) // 4)
        tight = np.sort(good)[:few].mean() + 0.5 * STEADY
        return 8 * float(saved.sum()) / (sum(map(len, blocks)) + STEADY), 8 * float(np.sort(saved)[:few].mean()) / size, 8 * float(tight) / size


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Dictionaries and calibration from a bounded sample of labelled documents. docs: doc_id, text."""
    chosen, counts = S.sample_by_class(S.labelled(labels, "quality"), DOCS_A_CLASS)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return {"share": share}
    # At most a few thousand ids, see sample_by_class.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, label, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                blocks = blocks_of((text or "").encode())
                step = max(1, -(-len(blocks) // BLOCKS_A_DOC))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([label], pa.int32()), pa.array([blocks[doc_id % step :: step]], pa.list_(pa.binary()))], ["doc_id", "label", "blocks"])

    got = rows.mapInArrow(cut, "doc_id long, label int, blocks array<binary>").collect()  # DOCS_A_CLASS x BLOCKS_A_DOC x BLOCK bytes a class
    got.sort(key=lambda r: (r.doc_id, len(r.blocks)))
    fit = [r for r in got if r.doc_id % 3]
    dictionaries = []
    for label in (1, 0):
        some = [bytes(b) for r in fit if r.label == label for b in r.blocks]
        try:
            dictionaries.append(zstandard.train_dictionary(DICTIONARY_BYTES, some, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            dictionaries.append(b"".join(some)[-DICTIONARY_BYTES:])
    model = {"share": share, "good": dictionaries[0], "bad": dictionaries[1]}
    held = rows.where(F.pmod("doc_id", F.lit(3)) == 0)
    measured = held.mapInArrow(_measurer(model), "doc_id long, label int, whole double, worst double, tight double").collect()
    measured.sort(key=lambda r: (r.doc_id, r.whole))
    y = np.array([r.label for r in measured])
    if len(set(y.tolist())) < 2:
        return {"share": share}
    x = np.array([[r[k] for k in MEASURES] for r in measured])
    # The sample is balanced; weights restore the labels' shares.
    w = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
    return model | {"logit": S.logistic(x, y, w, ridge=1e-2).tolist()}


def _measurer(model: dict):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Measure(model["good"], model["bad"])
        for batch in batches:
            got = np.array([by(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, got.T.copy())], [*batch.schema.names[:-1], *MEASURES])

    return measure


def _score(model: dict):
    *slopes, start = model["logit"]
    logit = sum((F.lit(b) * F.col(f"`{_NEW}`.{k}") for b, k in zip(slopes, MEASURES, strict=True)), F.lit(start))
    return 1 / (1 + F.exp(-logit))


#: The name of the column of measures beside a table's own columns.
_NEW = "nightloom measures"


def _measured(docs: DataFrame, model: dict) -> DataFrame:
    """docs with a column of measures of the text."""
    kinds = "struct<whole: double, worst: double, tight: double>"

    @F.pandas_udf(kinds)
    def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by = Measure(model["good"], model["bad"])
        for text in texts:
            yield pd.DataFrame([by(t) for t in text], columns=MEASURES, dtype=float)

    return docs.withColumn(_NEW, measures(F.col("text").cast("string")))


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1) of every row of docs (doc_id, text)."""
    if "logit" not in model:
        return docs.select("doc_id", F.lit(float(model["share"])).alias("score"))
    return _measured(docs.select("doc_id", "text"), model).select("doc_id", _score(model).alias("score"))


def keep_good(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`."""
    if "logit" not in model:
        return docs.where(F.lit(float(model["share"]) >= least))
    return _measured(docs, model).where(_score(model) >= least).drop(_NEW)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents_only(C.table(spark, sf_dir, "documents"))
    labels = C.table(spark, sf_dir, "labels").where(C.fold(F.col("doc_id"), 3) != 1)
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", (C.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
