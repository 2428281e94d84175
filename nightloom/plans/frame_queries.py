"""Frame-log queries bound to events: session = user_id, order = (ts, event_id), metric = value, kind = event_type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import grading, monitors

#: The frames table, in expressions that Spark and DuckDB read alike.
FRAME_COLUMNS = [
    "user_id AS session",
    "event_id AS idx",
    "ts",
    "CASE WHEN event_type = 'signup' THEN 'DARK' ELSE 'LIGHT' END AS kind",
    "CASE WHEN value > 1 THEN value / 20 END AS hfr",
    "CAST(event_id % 60 AS INT) AS star_count",
    "CAST(100 + (event_id * 7) % 50 AS DOUBLE) AS background",
    "value AS sharpness",
    "event_type <> 'error' AS accepted",
    "CASE WHEN event_type = 'purchase' THEN true WHEN event_type = 'click' THEN event_id % 2 = 0 END AS included",
]
FRAMES_SQL = "f AS (SELECT " + ", ".join(FRAME_COLUMNS) + " FROM events)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*FRAME_COLUMNS)


def stackable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.stackable(frames(spark, sf_dir)).select("session", "idx", "hfr")


def override(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = grading.set_override(frames(spark, sf_dir), F.col("star_count") >= 30)
    return grading.overridden(f).select("session", "idx", "accepted", "included")


def frame_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.frame_scores(grading.stackable(frames(spark, sf_dir))).select("session", "idx", *[F.round(c, 9).alias(c) for c in ("sharpness_term", "transparency_term", "darkness_term", "weight")])


def lunar_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.frame_scores(grading.stackable(frames(spark, sf_dir)), lunar=True).select("session", "idx", F.round("weight", 9).alias("weight"))


def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = grading.frame_scores(grading.stackable(frames(spark, sf_dir)))
    return grading.keep_best(scored, 60).select("session", "idx", F.round("weight", 9).alias("weight"))


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, sf_dir)
    return f, grading.keep_best(grading.frame_scores(grading.stackable(f)), 60).select("session", "idx")


def kept_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.kept(*_kept(spark, sf_dir)).select("session", "idx", "kind")


def dropped_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.dropped(*_kept(spark, sf_dir)).select("session", "idx", "kind")


def weight_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return grading.with_weights(f, grading.frame_scores(grading.stackable(f))).select("session", "idx", F.round("weight", 9).alias("weight"))


def session_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.session_medians(frames(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("median_hfr", "median_sharpness")})


def integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.integration_seconds(frames(spark, sf_dir), (F.col("star_count") + 1).cast("long") * F.lit(1_500_000_000)).withColumn("integration_seconds", F.round("integration_seconds", 6))


def focus_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitors.focus_status(frames(spark, sf_dir), F.lit(1.2)).select("session", "idx", F.round("median_hfr", 9).alias("median_hfr"), "status")


def offset_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitors.accumulate_offsets(frames(spark, sf_dir), F.when(F.col("accepted"), F.col("sharpness"))).select("session", "idx", "used_delta", F.round("offset", 6).alias("offset"))


def leak_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitors.leak_trend(frames(spark, sf_dir), "star_count").withColumns({"rate": F.round("rate", 9), "median_step": F.round("median_step", 9)})


def preview_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitors.running_mean(frames(spark, sf_dir).withColumn("v", F.when(F.col("accepted"), F.col("sharpness"))), "v", "session", ("ts", "idx")).withColumn("mean", F.round("mean", 6))


def thermal(spark: SparkSession, sf_dir: str) -> DataFrame:
    headroom = F.when(F.col("star_count") % 5 != 0, F.col("star_count") / 60.0)
    temp = F.when(F.col("star_count") % 7 != 0, 20.0 + F.col("idx") % 30)
    d = monitors.thermal_decision(headroom, temp, F.col("kind") == "LIGHT")
    return frames(spark, sf_dir).select("idx", F.round(d["gap_seconds"], 6).alias("gap_seconds"), d["throttling"].alias("throttling"))


def gyro_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are exposures of two hours, views are gyro samples: the largest excursion from the last sample before."""
    f = spark.read.parquet(f"{sf_dir}/events.parquet")
    gyro = f.where("event_type = 'view'").select("user_id", F.col("ts").alias("t"), F.col("value").alias("tilt"))
    spans = f.where("event_type = 'click'").select("user_id", "event_id", F.col("ts").alias("t"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("t_end"))
    spans = monitors.as_of(spans, gyro, ["user_id"], "t", "tilt", "base").withColumnRenamed("t", "t_start")
    inside = monitors.interval_join(gyro, spans, ["user_id"], "t", "t_start", "t_end", 6 * 3600)
    peak = inside.groupBy("event_id").agg(F.count("*").alias("n_samples"), F.max(F.abs(F.col("tilt") - F.col("base"))).alias("excursion"))
    return spans.select("event_id", "base").join(peak, "event_id", "left").select("event_id", "base", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.round("excursion", 6).alias("excursion"))


def gate_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the gate's inputs made from the events' values."""
    return _gate_columns(frames(spark, sf_dir))


def _gate_columns(f: DataFrame) -> DataFrame:
    return f.select(
        "session", "ts", "idx", "star_count", "hfr",
        ((F.col("idx") * 13 % 80) / 100.0).alias("eccentricity"), F.when(F.col("idx") % 4 != 0, (F.col("idx") * 29 % 105) / 200.0).alias("tilt_deg"),
        (F.col("sharpness") > 200).alias("saturated"), (F.col("idx") % 37 == 0).alias("bumped"), (~F.col("accepted")).alias("failed"),
    )


def frame_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitors.gate_frames(gate_input(spark, sf_dir))


def residual_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitors.residual_verdicts(frames(spark, sf_dir).select("session", "ts", "idx", "hfr"), "hfr")


SCORES = """b AS (SELECT session, min(hfr) FILTER (WHERE hfr > 0) AS bh, max(star_count) FILTER (WHERE star_count > 0) AS bs, min(background) FILTER (WHERE background > 0) AS bb,
  max(sharpness) FILTER (WHERE sharpness > 0) AS bsh FROM s GROUP BY 1),
t AS (SELECT s.*, CASE WHEN bh IS NULL OR hfr IS NULL OR hfr <= 0 THEN 1.0 ELSE greatest(0.01, least(1.0, (bh / hfr) * (bh / hfr))) END AS sharpness_term,
  CASE WHEN bs IS NULL OR star_count <= 0 THEN 1.0 ELSE greatest(0.01, least(1.0, star_count::DOUBLE / bs)) END AS transparency_term,
  CASE WHEN bb IS NULL OR background <= 0 THEN 1.0 ELSE greatest(0.01, least(1.0, bb / background)) END AS darkness_term,
  CASE WHEN bsh IS NULL OR sharpness <= 0 THEN 1.0 ELSE greatest(0.01, least(1.0, sharpness / bsh)) END AS lunar_term FROM s JOIN b USING (session)),
w AS (SELECT *, greatest(0.01, least(1.0, sharpness_term * transparency_term * darkness_term)) AS weight FROM t)"""
STACKABLE = "s AS (SELECT * FROM f WHERE kind = 'LIGHT' AND coalesce(included, accepted))"
BASE = f"WITH {FRAMES_SQL}, {STACKABLE}, {SCORES}"
KEPT = f"{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY weight DESC, idx) AS rn, count(*) OVER (PARTITION BY session) AS n FROM w), k AS (SELECT * FROM r WHERE rn <= greatest(1, ceil(n * 60 / 100.0)))"

GATE = f"""WITH RECURSIVE {FRAMES_SQL}, g AS (SELECT session, idx, star_count AS n, NOT accepted AS failed, row_number() OVER (PARTITION BY session ORDER BY ts, idx) AS rn,
  CASE WHEN sharpness > 200 THEN 'SATURATED' WHEN idx % 4 <> 0 AND (idx * 29 % 105) / 200.0::DOUBLE > 0.5::DOUBLE THEN 'BUMPED'
    WHEN (hfr IS NULL OR hfr >= 1.5::DOUBLE) AND star_count > 0 AND (idx * 13 % 80) / 100.0::DOUBLE > 0.6::DOUBLE THEN 'TRAILED' WHEN idx % 37 = 0 THEN 'BUMPED' WHEN star_count < 8 THEN 'CLOUD' END AS early FROM f),
t AS (SELECT session, 0::BIGINT AS rn, 0::BIGINT AS idx, []::INT[] AS recent, NULL::VARCHAR AS reason FROM g WHERE rn = 1
  UNION ALL SELECT g.session, g.rn, g.idx, CASE WHEN early IS NULL AND NOT (len(recent) >= 3 AND n < list_sort(recent)[len(recent) // 2 + 1] * 0.5::DOUBLE) THEN list_append(recent, n)[-15:] ELSE recent END,
    CASE WHEN early IS NOT NULL THEN early WHEN len(recent) >= 3 AND n < list_sort(recent)[len(recent) // 2 + 1] * 0.5::DOUBLE THEN 'CLOUD' WHEN failed THEN 'REGISTRATION' END FROM t JOIN g ON g.session = t.session AND g.rn = t.rn + 1)
SELECT session, idx, reason IS NULL AS accepted, reason FROM t WHERE rn > 0"""
SPIKES = f"""WITH RECURSIVE {FRAMES_SQL}, g AS (SELECT session, idx, hfr AS v, row_number() OVER (PARTITION BY session ORDER BY ts, idx) AS rn FROM f),
t AS (SELECT session, 0::BIGINT AS rn, 0::BIGINT AS idx, []::DOUBLE[] AS recent, '' AS verdict FROM g WHERE rn = 1
  UNION ALL SELECT session, rn, idx, CASE WHEN verdict = 'SPIKE' OR v IS NULL OR v < 0 THEN recent ELSE list_append(recent, v)[-12:] END, verdict FROM (
    SELECT g.session, g.rn, g.idx, recent, v, CASE WHEN v IS NULL OR v < 0 OR len(recent) < 5 THEN 'UNKNOWN' WHEN v > greatest(list_sort(recent)[len(recent) // 2 + 1] * 3, list_sort(recent)[len(recent) // 2 + 1] + 0.4::DOUBLE) THEN 'SPIKE' ELSE 'STEADY' END AS verdict
    FROM t JOIN g ON g.session = t.session AND g.rn = t.rn + 1))
SELECT session, idx, verdict FROM t WHERE rn > 0"""

QUERIES = {
    "stackable": stackable, "override": override, "frame_score": frame_score, "lunar_score": lunar_score, "keep_best": keep_best, "kept_semi": kept_semi, "dropped_anti": dropped_anti,
    "weight_join": weight_join, "session_medians": session_medians, "integration": integration, "focus_monitor": focus_monitor, "offset_accumulate": offset_accumulate,
    "leak_trend": leak_trend, "preview_mean": preview_mean, "thermal": thermal, "gyro_interval": gyro_interval, "frame_gate": frame_gate, "residual_spikes": residual_spikes,
}
ORACLES = {
    "frame_gate": GATE, "residual_spikes": SPIKES,
    "stackable": f"WITH {FRAMES_SQL}, {STACKABLE} SELECT session, idx, hfr FROM s",
    "override": f"WITH {FRAMES_SQL}, o AS (SELECT session, idx, accepted, CASE WHEN kind = 'LIGHT' THEN CASE WHEN (star_count >= 30) <> accepted THEN star_count >= 30 END ELSE included END AS included FROM f) SELECT * FROM o WHERE included IS NOT NULL AND included <> accepted",
    "frame_score": f"{BASE} SELECT session, idx, round(sharpness_term, 9) AS sharpness_term, round(transparency_term, 9) AS transparency_term, round(darkness_term, 9) AS darkness_term, round(weight, 9) AS weight FROM w",
    "lunar_score": f"{BASE} SELECT session, idx, round(lunar_term, 9) AS weight FROM w",
    "keep_best": f"{KEPT} SELECT session, idx, round(weight, 9) AS weight FROM k",
    "kept_semi": f"{KEPT} SELECT session, idx, kind FROM f WHERE (session, idx) IN (SELECT session, idx FROM k)",
    "dropped_anti": f"{KEPT} SELECT session, idx, kind FROM f WHERE (session, idx) NOT IN (SELECT session, idx FROM k)",
    "weight_join": f"{BASE} SELECT f.session, f.idx, round(coalesce(w.weight, 1.0), 9) AS weight FROM f LEFT JOIN w ON f.session = w.session AND f.idx = w.idx",
    "session_medians": f"WITH {FRAMES_SQL} SELECT session, round(median(hfr), 9) AS median_hfr, round(median(sharpness), 9) AS median_sharpness, count(*)::BIGINT AS n_frames FROM f GROUP BY 1",
    "integration": f"WITH {FRAMES_SQL} SELECT session, round(sum((star_count + 1)::DOUBLE * 1500000000) / 1e9, 6) AS integration_seconds FROM f WHERE accepted GROUP BY 1",
    "focus_monitor": f"""WITH {FRAMES_SQL}, v AS (SELECT *, coalesce(hfr > 0 AND star_count >= 5, false) AS valid FROM f),
r AS (SELECT *, CASE WHEN valid THEN list(hfr) OVER (PARTITION BY session, valid ORDER BY ts, idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS recent FROM v),
m AS (SELECT *, CASE WHEN len(recent) >= 3 THEN list_median(recent) END AS m FROM r),
o AS (SELECT *, CASE WHEN NOT valid THEN NULL WHEN m IS NULL THEN 'UNKNOWN' WHEN m > 1.2 * 1.6 + 0.2 THEN 'LOST' WHEN m > 1.2 * 1.25 + 0.2 THEN 'DRIFTING' ELSE 'LOCKED' END AS own FROM m)
SELECT session, idx, round(last_value(m IGNORE NULLS) OVER w, 9) AS median_hfr, coalesce(last_value(own IGNORE NULLS) OVER w, 'UNKNOWN') AS status FROM o
WINDOW w AS (PARTITION BY session ORDER BY ts, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "offset_accumulate": f"""WITH {FRAMES_SQL}, d AS (SELECT session, idx, ts, coalesce(last_value(CASE WHEN accepted THEN sharpness END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS used_delta FROM f)
SELECT session, idx, used_delta, round(sum(used_delta) OVER (PARTITION BY session ORDER BY ts, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS "offset" FROM d""",
    "leak_trend": f"""WITH {FRAMES_SQL}, a AS (SELECT session, star_count AS v, row_number() OVER w AS rn, count(*) OVER (PARTITION BY session) - 1 AS n, lag(star_count) OVER w AS prev FROM f WINDOW w AS (PARTITION BY session ORDER BY ts, idx)),
s AS (SELECT *, greatest(2, (n + 1) // 2) AS tail FROM a WHERE rn > 1),
g AS (SELECT session, first(n) AS settled, first(tail) AS tail, arg_min(v, rn) FILTER (WHERE rn - 1 > n - tail) AS a, arg_max(v, rn) FILTER (WHERE rn - 1 > n - tail) AS b, median(v - prev) FILTER (WHERE rn > 2) AS step FROM s GROUP BY 1)
SELECT session, settled::BIGINT AS settled, CASE WHEN settled >= 20 THEN round((b - a)::DOUBLE / (tail - 1), 9) END AS rate, CASE WHEN settled >= 20 THEN round(step, 9) END AS median_step,
  CASE WHEN settled >= 20 THEN (b - a)::DOUBLE / (tail - 1) >= 0.5 OR step >= 0.5 ELSE false END AS leaking, settled >= 20 AS conclusive FROM g""",
    "preview_mean": f"""WITH {FRAMES_SQL}, g AS (SELECT session, list({{'m': CASE WHEN accepted THEN sharpness END, 'n': 1}} ORDER BY ts, idx) AS xs FROM f GROUP BY 1),
r AS (SELECT session, list_reduce(xs, lambda a, x: {{'m': CASE WHEN x.m IS NULL THEN a.m ELSE a.m + (x.m - a.m) / least(a.n + 1, 32) END, 'n': a.n + 1}}, {{'m': 0.0::DOUBLE, 'n': 0}}) AS r FROM g)
SELECT session, r.n::BIGINT AS n, round(r.m, 6) AS mean FROM r""",
    "thermal": f"""WITH {FRAMES_SQL}, d AS (SELECT idx, kind, CASE WHEN star_count % 5 <> 0 THEN star_count / 60.0::DOUBLE END AS h, CASE WHEN star_count % 7 <> 0 THEN 20.0 + idx % 30 END AS t FROM f),
e AS (SELECT *, coalesce(h >= 0.85, false) OR coalesce(t >= 42, false) AS hot FROM d)
SELECT idx, round(CASE WHEN hot AND kind = 'LIGHT' THEN 30.0 * (0.3 + 0.7 * CASE WHEN h IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, (h - 0.85) / 0.15)) END) ELSE 0.0 END, 6)::DOUBLE AS gap_seconds, hot AS throttling FROM e""",
    "gyro_interval": """WITH g AS (SELECT user_id, ts AS t, value AS tilt FROM events WHERE event_type = 'view'),
c AS (SELECT user_id, event_id, ts, ts + INTERVAL 6 HOUR AS te, (SELECT arg_max(g.tilt, g.t) FROM g WHERE g.user_id = e.user_id AND g.t <= e.ts) AS base FROM events e WHERE event_type = 'click')
SELECT event_id, any_value(base) AS base, count(g.t)::BIGINT AS n_samples, round(max(abs(g.tilt - base)), 6) AS excursion FROM c LEFT JOIN g ON g.user_id = c.user_id AND g.t > c.ts AND g.t <= c.te GROUP BY 1""",
}
