"""Frame streams: the gate and the running mean over files of frames as they come, with state by session."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import monitors


def file_stream(spark: SparkSession, path: str, schema: str, name_glob: str = "*.parquet", files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name_glob).option("maxFilesPerTrigger", files_a_batch).parquet(path)


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State of several kinds and timers need the RocksDB store; the session's own choice comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and writes its rows as Parquet. Updates are written batch by batch, each with its
    number, and a batch that runs twice replaces itself."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch_of={number}")

        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def gate(frames: DataFrame, out: str, checkpoint: str) -> None:
    drain(monitors.gate_stream(frames), out, checkpoint)


def running_mean(samples: DataFrame, out: str, checkpoint: str) -> None:
    drain(monitors.running_mean_stream(samples), out, checkpoint, "update")


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event counts by tumbling window and type, with a watermark; the time is cast, as streams take no zone-less times."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
