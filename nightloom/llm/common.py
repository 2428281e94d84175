"""Helpers shared by the text operators: word rules, folds, shared storage, size checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words: space and \x09-\x0D.
BLANKS = " \t\n\x0b\f\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() is exact, and far faster, where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def strip_blanks(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def words(col: Column) -> Column:
    """The words of a text, lower-cased, as an array; empty where there are none."""
    return F.filter(F.split(ascii_lower(F.coalesce(col, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(k)


def once(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; set here only where it is unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/nightloom-checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/nightloom-{uuid.uuid4().hex}"


def delete_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keep_only(spark: SparkSession, path: str, *names: str) -> None:
    """Deletes all that is in a folder but `names`: tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(p):
        if status.getPath().getName() not in names:
            store.delete(status.getPath(), True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to a shared folder and read again: cuts the lineage so that a lost executor costs no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents_only(docs: DataFrame) -> DataFrame:
    """doc_id and text under these names and types, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
