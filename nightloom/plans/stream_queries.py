"""Streaming queries over the events file, drained once into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import geometry as G
from nightloom.operators import live, monitors, pointing
from nightloom.operators import registration as R
from nightloom.plans import frame_queries as Q
from nightloom.plans import geometry_queries as GQ
from nightloom.sources.store import shared_folder
from nightloom.streaming import frames as S

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.file_stream(spark, sf_dir, EVENTS, "events.parquet")


def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "stream")
    frames = Q._gate_columns(_events(spark, sf_dir).selectExpr(*Q.FRAME_COLUMNS))
    S.gate(frames, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema("session long, idx long, accepted boolean, reason string").parquet(f"{out}/rows")


def stream_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "stream")
    f = _events(spark, sf_dir).selectExpr(*Q.FRAME_COLUMNS).select("session", "ts", "idx", "hfr")
    S.drain(monitors.residual_stream(f, "hfr"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(monitors.RESIDUAL_SCHEMA).parquet(f"{out}/rows")


def stream_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "stream")
    f = _events(spark, sf_dir).selectExpr(*Q.FRAME_COLUMNS).select("session", "ts", "idx", "hfr", "star_count")
    S.drain(monitors.focus_stream(f, 1.2), f"{out}/rows", f"{out}/checkpoint")
    rows = spark.read.schema("session long, idx long, median_hfr double, status string").parquet(f"{out}/rows")
    return rows.withColumn("median_hfr", F.round("median_hfr", 9))


def stream_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "stream")
    f = _events(spark, sf_dir).selectExpr(*Q.FRAME_COLUMNS)
    S.running_mean(f.select("session", "ts", "idx", F.when(F.col("accepted"), F.col("sharpness")).alias("value")), f"{out}/rows", f"{out}/checkpoint")
    rows = spark.read.schema("session long, n long, mean double, batch int").parquet(f"{out}/rows/*")
    last = rows.groupBy("session").agg(F.max_by(F.struct("n", "mean"), "batch").alias("m"))
    return last.select("session", "m.n", F.round("m.mean", 6).alias("mean"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete windows of a drained stream: the last one may still be open, so that one is left to the next run."""
    out = shared_folder(spark, "stream")
    S.drain(S.windowed_counts(_events(spark, sf_dir)), f"{out}/rows", f"{out}/checkpoint", "update")
    rows = spark.read.schema("start timestamp, event_type string, n long, total double, batch int").parquet(f"{out}/rows/*")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("m"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "m.n", F.round("m.total", 4).alias("total"))


def stream_common_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "stream")
    S.drain(R.common_area_stream(GQ.area_motions(_events(spark, sf_dir)), GQ.AREA_WIDTH, GQ.AREA_HEIGHT), f"{out}/rows", f"{out}/checkpoint", "update")
    rows = spark.read.schema("session long, frames long, fraction double, batch int").parquet(f"{out}/rows/*")
    last = rows.groupBy("session").agg(F.max_by(F.struct("frames", "fraction"), "batch").alias("m"))
    return last.select("session", "m.frames", F.round("m.fraction", 6).alias("fraction"))


def stream_gyro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as exposures of six hours, views as gyro samples, as two streams: the samples that fall into each exposure."""
    out = shared_folder(spark, "stream")
    e = _events(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))
    gyro = e.where("event_type = 'view'").select("user_id", "t", F.col("value").alias("tilt"))
    spans = e.where("event_type = 'click'").select("user_id", "event_id", F.col("t").alias("t_start"), (F.col("t") + F.expr("INTERVAL 6 HOURS")).alias("t_end"))
    S.drain(monitors.interval_join_stream(gyro, spans, ["user_id"], "t", "t_start", "t_end", "6 HOURS", "1 hour"), f"{out}/rows", f"{out}/checkpoint")
    rows = spark.read.schema("user_id long, event_id long, t_start timestamp, t_end timestamp, t timestamp, tilt double").parquet(f"{out}/rows")
    return rows.groupBy("event_id").agg(F.count("*").alias("n_samples"), F.min("tilt").alias("low"), F.max("tilt").alias("high"))


def pointing_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as directions: an average by user that takes a sample every six hours at most."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros((F.col("ts") - F.lit("2000-01-01").cast("timestamp_ntz") + F.lit("2000-01-01 00:00:00+00:00").cast("timestamp")))
    turn, up = F.radians(F.col("value") * 3), F.radians(F.col("event_id") % 80)
    s = e.select(F.col("user_id").alias("session"), us.alias("ts"), F.col("event_id").alias("idx"), (F.cos(up) * F.sin(turn)).alias("x"), (F.cos(up) * F.cos(turn)).alias("y"), F.sin(up).alias("z"))
    got = pointing.average(s, interval_ms=6 * 3_600_000, block_ms=90 * 86_400_000, ticks=1000)
    return got.select("session", "idx", *[F.round(c, 6).alias(c) for c in "xyz"])


LIVE_FRAMES, SENSOR = 10, (4096, 3072)


def _live_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten frames of every label's stars, as a session: too few stars, the reference, six turned and moved copies, two stars over a
    plane that was moved around, two stars and no plane. The plane is that of lineitem, one row of a fixed size."""
    stars = F.transform(F.array_sort(F.collect_list(F.struct("rank", "x", "y", "flux"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["flux"].alias("flux")))
    base = G.brightest(GQ._stars(spark, sf_dir)).groupBy(F.col("frame").alias("session")).agg(stars.alias("all"))
    cells = GQ._plane(spark, sf_dir).select((F.col("y") * 64 + F.col("x")).cast("int").alias("i"), "v")
    plane = cells.agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))  # 64 by 48 cells

    def rolled(dx: int, dy: int):
        at = lambda i: F.pmod(F.floor(i / 64) - dy, F.lit(48)) * 64 + F.pmod(i % 64 - dx, F.lit(64))
        return F.transform(F.sequence(F.lit(0), F.lit(64 * 48 - 1)), lambda i: F.coalesce(F.try_element_at("m", at(i).cast("int")), F.lit(0.0)).cast("float"))

    planes = plane.select(rolled(0, 0).alias("still"), rolled(3, -2).alias("moved"))
    f = base.crossJoin(F.broadcast(planes)).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(LIVE_FRAMES - 1)))).withColumn("idx", F.col("idx").cast("long"))
    cx, cy = ((n - 1) / 2 for n in SENSOR)
    t = F.radians(F.col("idx") * 0.75)
    moved = F.transform("all", lambda s: F.struct(
        ((s["x"] - cx) * F.cos(t) - (s["y"] - cy) * F.sin(t) + cx + F.col("idx") * 11 - 30).alias("x"), ((s["x"] - cx) * F.sin(t) + (s["y"] - cy) * F.cos(t) + cy + 7 - F.col("idx") * 5).alias("y"), s["flux"].alias("flux")))
    k = F.col("idx")
    return f.select(
        "session", F.timestamp_seconds(k).alias("ts"), "idx", F.when(k == 0, F.slice("all", 1, 5)).when(k == 1, F.col("all")).when(k < 8, moved).otherwise(F.slice("all", 1, 2)).alias("stars"),
        F.when(k < 8, F.col("still")).when(k == 8, F.col("moved")).alias("plane"), F.when(k < 9, 64).alias("plane_width"), F.lit(2.0).alias("bin"), F.lit(SENSOR[0]).alias("width"), F.lit(SENSOR[1]).alias("height"),
    )


def _outcomes(rows: DataFrame) -> DataFrame:
    # A correlated shift is read to the pixel.
    near = lambda c: F.when(F.col("outcome") == "CORRELATED", F.round(c, 0)).otherwise(F.round(c, 4)) + 0.0
    return rows.select("session", "idx", "outcome", *[near(c).alias(c) for c in ("rotation_deg", "dx", "dy")], (F.col("inliers") >= 8).alias("fitted"), "verdict", "reason")


def live_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(live.register(_live_frames(spark, sf_dir)))


def stream_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as a stream in three micro-batches: files of the shared folder, in order of frames."""
    out = shared_folder(spark, "stream")
    frames = _live_frames(spark, sf_dir)
    for n, (a, b) in enumerate(((0, 2), (2, 6), (6, LIVE_FRAMES))):
        frames.where((F.col("idx") >= a) & (F.col("idx") < b)).withColumn("n", F.lit(n)).repartition(1).write.mode("append").partitionBy("n").parquet(f"{out}/frames")
    schema = spark.read.parquet(f"{out}/frames").drop("n").schema
    with S.rocks(spark):
        for n in range(3):  # each run takes what is there and goes on from the checkpoint
            source = spark.readStream.schema(schema).parquet(f"{out}/frames/n={{{','.join(map(str, range(n + 1)))}}}")
            S.drain(live.register_stream(source), f"{out}/rows", f"{out}/checkpoint")
    return _outcomes(spark.read.schema(live.OUTCOME).parquet(f"{out}/rows"))


# What was planted: the outcome, the motion and, after five residuals, the verdict of each frame.
LIVE = f"""WITH s AS (SELECT label::BIGINT AS session, count(*) >= 8 AS able FROM embeddings GROUP BY 1), f AS (SELECT session, able, range AS idx FROM s, range({LIVE_FRAMES})),
o AS (SELECT *, CASE WHEN NOT able OR idx = 0 THEN 'STARVED' WHEN idx = 1 THEN 'REFERENCE' WHEN idx < 8 THEN 'ASTERISM' WHEN idx = 8 THEN 'CORRELATED' ELSE 'FAILED' END AS outcome FROM f)
SELECT session, idx, outcome, CASE outcome WHEN 'ASTERISM' THEN round(idx * 0.75::DOUBLE, 4) WHEN 'CORRELATED' THEN 0.0::DOUBLE END AS rotation_deg, CASE outcome WHEN 'ASTERISM' THEN idx * 11 - 30.0::DOUBLE WHEN 'CORRELATED' THEN 6.0::DOUBLE END AS dx,
  CASE outcome WHEN 'ASTERISM' THEN 7.0::DOUBLE - idx * 5 WHEN 'CORRELATED' THEN -4.0::DOUBLE END AS dy, outcome = 'ASTERISM' AS fitted, CASE WHEN outcome = 'ASTERISM' AND idx >= 7 THEN 'STEADY' ELSE 'UNKNOWN' END AS verdict,
  CASE WHEN outcome IN ('CORRELATED', 'FAILED') THEN '{live.NO_MATCH}' END AS reason FROM o"""
# Every sample in order; the state moves on where one counts.
POINTING = """WITH RECURSIVE v AS (SELECT user_id AS session, event_id AS idx, ts, cos(radians(event_id % 80)) * sin(radians(value * 3)) AS x, cos(radians(event_id % 80)) * cos(radians(value * 3)) AS y, sin(radians(event_id % 80)) AS z FROM events),
s AS (SELECT session, idx, ts, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z, row_number() OVER (PARTITION BY session ORDER BY ts, idx) AS n FROM v),
r AS (SELECT session, n, idx, ts AS last, x, y, z, true AS counts FROM s WHERE n = 1
  UNION ALL
  SELECT s.session, s.n, s.idx, CASE WHEN s.ts >= r.last + INTERVAL 6 HOUR THEN s.ts ELSE r.last END, CASE WHEN s.ts >= r.last + INTERVAL 6 HOUR THEN r.x + 0.2::DOUBLE * (s.x - r.x) ELSE r.x END, CASE WHEN s.ts >= r.last + INTERVAL 6 HOUR THEN r.y + 0.2::DOUBLE * (s.y - r.y) ELSE r.y END,
    CASE WHEN s.ts >= r.last + INTERVAL 6 HOUR THEN r.z + 0.2::DOUBLE * (s.z - r.z) ELSE r.z END, s.ts >= r.last + INTERVAL 6 HOUR FROM r JOIN s ON s.session = r.session AND s.n = r.n + 1)
SELECT session, idx, round(x / sqrt(x * x + y * y + z * z), 6) AS x, round(y / sqrt(x * x + y * y + z * z), 6) AS y, round(z / sqrt(x * x + y * y + z * z), 6) AS z FROM r WHERE counts"""
QUERIES = {"stream_gyro": stream_gyro, "pointing_average": pointing_average, "live_registration": live_registration, "stream_registration": stream_registration, "stream_common_area": stream_common_area, "stream_gate": stream_gate, "stream_residual": stream_residual, "stream_focus": stream_focus, "stream_running_mean": stream_running_mean, "stream_windows": stream_windows}
ORACLES = {
    "stream_gyro": """SELECT c.event_id, count(*)::BIGINT AS n_samples, min(g.value) AS low, max(g.value) AS high FROM events c JOIN events g ON g.user_id = c.user_id AND g.event_type = 'view' AND c.event_type = 'click' AND g.ts > c.ts AND g.ts <= c.ts + INTERVAL 6 HOUR GROUP BY 1""",
    "pointing_average": POINTING,
    "live_registration": LIVE, "stream_registration": LIVE, "stream_common_area": GQ.AREA,
    "stream_gate": Q.GATE, "stream_residual": Q.SPIKES, "stream_focus": Q.ORACLES["focus_monitor"],
    "stream_running_mean": Q.ORACLES["preview_mean"],
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
