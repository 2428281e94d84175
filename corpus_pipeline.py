"""The corpus pipeline: documents through quality, line dedup, near-dedup, decontamination and encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. Its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm import decontaminate, line_dedup, near_dedup, quality, sentence_pieces

#: A document goes when its quality score is below this.
LEAST_QUALITY = 0.5


def _text(docs: DataFrame) -> DataFrame:
    return C.documents_only(docs)


def _like(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order, whatever their names hold."""
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores as good. A null doc_id or text is scored like any other."""
    labels = C.table(spark, sf_dir, "labels").where(C.fold(F.col("doc_id"), 3) != 1)
    return quality.keep_good(docs, quality.train(_text(docs), labels), LEAST_QUALITY)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the lines that a larger doc_id keeps; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, carry=True)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _like(kept, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word shingles): that with the smallest doc_id."""
    return near_dedup.keep_one(docs, width=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark item (0.8 of its five-word shingles)."""
    return decontaminate.drop_leaks(docs, C.table(spark, sf_dir, "benchmark"))


def sentence_piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256, exact of every document that is left."""
    return sentence_pieces.round_trip(_text(docs), sentence_pieces.load())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentence_pieces", sentence_piece_encoding),
]

#: Compression, signatures and pieces are not expressible in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    path = C.shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
