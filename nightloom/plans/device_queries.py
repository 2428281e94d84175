"""Queries on devices, flats, settings and the deferred stack, bound to part, customer, nation, events and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import devices as D
from nightloom.operators import flats as L
from nightloom.operators import planes as P
from nightloom.operators import stack as S
from nightloom.plans import frame_queries as Q
from nightloom.plans.geometry_queries import PLANE, _lines, _plane


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    o = D.optics(4.0 + k % 7, 3.0 + k % 5, F.lit(4000.0) + k % 1000, 3.0 + F.col("p_size") / 5.0, 1.4 + k % 30 / 10.0)
    level = F.get(F.array(*[F.lit(x) for x in ("FULL", "LEVEL_3", "LIMITED", "LEGACY", "FULL")]), (k % 5).cast("int"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("o", o)
    return p.select(k.alias("camera"), "p_brand", "o.*", level.alias("level"), (k % 6 != 0).alias("raw"), (k % 7 != 0).alias("manual"), F.col("p_size").cast("double").alias("max_exposure"))


def camera_optics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cameras(spark, sf_dir).select("camera", *[F.round(c, 6).alias(c) for c in ("pitch_um", "fov_deg", "equivalent_mm", "light")])


def qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.qualify(_cameras(spark, sf_dir))


def pick_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cameras(spark, sf_dir)
    return D.pick_camera(D.qualify(c).join(c.select("camera", "p_brand", "light"), "camera"), "p_brand")


def match_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    asked, applied = k * 1000 + 100_000, F.when(k % 8 != 0, k * 1000 + 100_000 + k % 7 * 700)
    focus, got = F.when(k % 5 != 0, k % 40 / 100.0), F.when(k % 6 != 0, k % 41 / 100.0)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", D.exposure_matches(asked, applied).alias("exposure"), D.focus_matches(focus, got).alias("focus"))


def black_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    levels = F.array(F.when(k % 2 == 0, k % 60 + 0.5), F.when(k % 3 == 0, k % 64 + 0.0), F.when(k % 5 == 0, F.lit(float("nan"))), F.when(k % 7 == 0, k % 61 + 0.0))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(D.black_level(levels), 9).alias("black"))


def iso_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.posexplode(D.iso_ladder(F.col("p_size") * 3, F.col("p_size") * 3 + 100 * (F.col("p_partkey") % 40))).alias("step", "iso"))


def metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor answers less than in proportion where it is bright: the gain falls with the part's size."""
    m = D.meter(F.lit(1.0), 1.0 / (1 + F.col("p_size")), 0.5, 0.45, 0.55)
    return spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("m", m).select("p_partkey", F.round("m.level", 6).alias("level"), F.col("m.probes").alias("probes"))


def lunar_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    plan = D.lunar_plan((F.col("c_acctbal") + 1000) * 5_000_000, 25_195_876, k % 90 / 1.5, k % 13 * 1.0, k % 110)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("p", plan)
    return c.select("c_custkey", F.col("p.frames").alias("frames"), F.col("p.stacked").alias("stacked"), F.round("p.seconds", 6).alias("seconds"), F.round("p.drift_px", 6).alias("drift_px"))


def frame_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("idx")
    turn = F.radians((k % 40).cast("double"))
    f = Q.frames(spark, sf_dir).select(
        "session", "ts", "idx", (k % 11 != 0).alias("exists"), (k % 13 != 0).alias("readable"), F.when(k % 17 == 0, 2000).otherwise(4096).alias("width"), F.lit(3072).alias("height"),
        F.when(k % 3 != 0, F.cos(turn)).alias("a"), F.when(k % 3 != 0, -F.sin(turn)).alias("b"), F.when(k % 3 != 0, F.sin(turn)).alias("c"),
        F.when(k % 3 != 0, F.cos(turn) * F.when(k % 19 == 0, 1.1).otherwise(1.0)).alias("d"),
    )
    return D.admit(f, "session", ["ts", "idx"]).select("idx", "skip_reason")


def focus_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    old = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("camera")).agg(F.min("value").alias("hfr"))
    new = e.where("event_type = 'click' AND value > 60").groupBy(F.col("user_id").alias("camera")).agg(F.max("value").alias("hfr"))
    return D.upsert(old, new, "camera")


def frame_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"kind": F.col("kind"), "stars": F.col("star_count"), "override": F.col("included")}
    return Q.frames(spark, sf_dir).select("idx", D.describe(parts).alias("text"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 25 rows of the log."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "event_type")


def _flat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select((F.col("l_suppkey") % 12).alias("frame"), "x", "y", (F.col("l_quantity") + F.when(F.col("l_suppkey") % 12 == 3, 45).otherwise(0)).alias("v"))


def flat_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.judge_flats(_flat_samples(spark, sf_dir), 64.0)


def flat_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _flat_samples(spark, sf_dir)
    return L.build_flat(samples, L.judge_flats(samples, 64.0))


def flat_evenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.evenness(_plane(spark, sf_dir), 64, 48, 8).withColumns({c: F.round(c, 6) for c in ("centre", "corners", "ratio")})


def flat_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("session"), F.col("c_nationkey").alias("camera"), (F.col("c_custkey") % 5 * 100).alias("width"))
    f = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey <> 4").select(F.col("n_nationkey").alias("camera"), F.col("n_name").alias("flat"), (F.col("n_regionkey") * 100).alias("flat_width"))
    return L.join_flats(s, f)


def noise_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.noise_level(_plane(spark, sf_dir), F.lit(25.0), 64).withColumn("sigma", F.round("sigma", 6))


def background_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plane(spark, sf_dir)
    return L.surface(p, P.tile_medians(p, 16), 16, 4, 3).select("x", "y", F.round("background", 6).alias("background"))


def hot_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plane(spark, sf_dir, "sum(l_quantity)")
    return L.repair(p, P.hot_pixels(p, 2.5))


def deferred_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven frames of the plane (by line number), demosaicked, moved back and combined by tiles of 32 pixels."""
    p = _lines(spark, sf_dir).groupBy(F.col("l_linenumber").cast("long").alias("frame"), "x", "y").agg(F.avg("l_quantity").alias("v"))
    cell = (F.col("y") * 64 + F.col("x")).cast("int")
    cells = p.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct(cell, "v"))).alias("m"))
    samples = F.transform(F.sequence(F.lit(0), F.lit(64 * 48 - 1)), lambda i: F.try_element_at("m", i))
    frames = cells.select(
        F.lit(0).cast("long").alias("session"), "frame", F.lit(64).alias("width"), samples.alias("samples"), F.lit(1.0).alias("weight"), (F.col("frame") / 4.0).alias("rotation_deg"),
        (F.col("frame") * 0.5).alias("dx"), (F.col("frame") * -0.25).alias("dy"),
    )
    return S.stack(frames, 32)


QUERIES = {
    "camera_optics": camera_optics, "qualify": qualify, "pick_camera": pick_camera, "match_predicates": match_predicates, "black_levels": black_levels, "iso_ladder": iso_ladder,
    "metering": metering, "lunar_plan": lunar_plan, "frame_admission": frame_admission, "focus_store": focus_store, "frame_description": frame_description, "log_tail": log_tail,
    "flat_judge": flat_judge, "flat_build": flat_build, "flat_evenness": flat_evenness, "flat_left_join": flat_left_join, "noise_level": noise_level,
    "background_surface": background_surface, "hot_repair": hot_repair, "deferred_stack": deferred_stack,
}
CAMERAS = """WITH b AS (SELECT p_partkey AS k, p_brand, p_size, 4.0::DOUBLE + p_partkey % 7 AS w, 3.0::DOUBLE + p_partkey % 5 AS h, 4000.0::DOUBLE + p_partkey % 1000 AS px, 3.0::DOUBLE + p_size / 5.0::DOUBLE AS f, 1.4::DOUBLE + p_partkey % 30 / 10.0::DOUBLE AS ap FROM part),
c AS (SELECT k AS camera, p_brand, w * 1000 / px AS pitch_um, degrees(2 * atan(sqrt(w * w + h * h) / 2 / f)) AS fov_deg, f * 43.2666::DOUBLE / sqrt(w * w + h * h) AS equivalent_mm, 1.0 / (ap * ap) AS light,
  (['FULL', 'LEVEL_3', 'LIMITED', 'LEGACY', 'FULL'])[k % 5 + 1] AS level, k % 6 <> 0 AS raw, k % 7 <> 0 AS manual, p_size AS me FROM b),
q AS (SELECT *, (level = 'LEGACY')::BIGINT + (NOT raw)::BIGINT + (NOT manual)::BIGINT + (me < 2)::BIGINT AS n_fail, (level = 'LIMITED')::BIGINT + (me >= 2 AND me < 10)::BIGINT AS n_warn FROM c),
t AS (SELECT *, CASE WHEN n_fail > 0 THEN 'UNSUPPORTED' WHEN level = 'LIMITED' THEN 'DEGRADED' WHEN n_warn > 0 THEN 'FUNCTIONAL' ELSE 'FULL' END AS tier FROM q)"""
FLATS = """WITH s AS (SELECT l_suppkey % 12 AS frame, l_partkey % 64 AS x, l_suppkey % 48 AS y, l_quantity + CASE WHEN l_suppkey % 12 = 3 THEN 45 ELSE 0 END AS v FROM lineitem),
g AS (SELECT frame, list(v ORDER BY v) AS a FROM s GROUP BY 1), j AS (SELECT frame, list_median(a) AS median, a[floor((len(a) - 1) * 0.999::DOUBLE)::INT + 1] AS peak FROM g),
u AS (SELECT *, peak < 0.85::DOUBLE * 64 AND median > 0.1::DOUBLE * 64 AS usable FROM j), l AS (SELECT list(median ORDER BY median) AS m FROM u WHERE usable), y AS (SELECT m[len(m) // 2 + 1] AS typical FROM l),
k AS (SELECT frame, median, peak, coalesce(usable AND abs(median - typical) <= 0.15::DOUBLE * typical, false) AS kept FROM u, y)"""
ORACLES = {
    "camera_optics": f"{CAMERAS} SELECT camera, round(pitch_um, 6) AS pitch_um, round(fov_deg, 6) AS fov_deg, round(equivalent_mm, 6) AS equivalent_mm, round(light, 6) AS light FROM c",
    "qualify": f"{CAMERAS} SELECT camera, n_fail, n_warn, tier FROM t",
    "pick_camera": f"{CAMERAS} SELECT p_brand, arg_max(camera, (light, -camera)) AS camera FROM t WHERE tier <> 'UNSUPPORTED' GROUP BY 1",
    "match_predicates": """WITH e AS (SELECT event_id, event_id * 1000 + 100000 AS r, CASE WHEN event_id % 8 <> 0 THEN event_id * 1000 + 100000 + event_id % 7 * 700 END AS a, CASE WHEN event_id % 5 <> 0 THEN event_id % 40 / 100.0::DOUBLE END AS f, CASE WHEN event_id % 6 <> 0 THEN event_id % 41 / 100.0::DOUBLE END AS g FROM events)
SELECT event_id, a IS NOT NULL AND abs(a - r) <= r // 100 + 1000 AS exposure, CASE WHEN f IS NULL THEN true WHEN g IS NULL THEN false ELSE abs(g - f) <= 0.02::DOUBLE END AS focus FROM e""",
    "black_levels": """WITH l AS (SELECT p_partkey AS k, list_filter([CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 60 + 0.5::DOUBLE END, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 64 + 0.0::DOUBLE END, CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 61 + 0.0::DOUBLE END], lambda v: v IS NOT NULL) AS a FROM part)
SELECT k AS p_partkey, round(CASE WHEN len(a) > 0 THEN list_avg(a) ELSE 0.0 END, 9)::DOUBLE AS black FROM l""",
    "iso_ladder": """WITH l AS (SELECT p_partkey, greatest(p_size * 3, 25) AS lo, p_size * 3 + 100 * (p_partkey % 40) AS hi FROM part), s AS (SELECT *, unnest(range(0, 25)) AS step FROM l)
SELECT p_partkey, step::INT AS step, (lo * (1::BIGINT << step))::BIGINT AS iso FROM s WHERE lo * (1::BIGINT << step) <= hi""",
    "metering": """WITH a AS (SELECT p_partkey, 1.0::DOUBLE / (1 + p_size) AS g FROM part)
SELECT p_partkey, round(CASE WHEN g BETWEEN 0.45::DOUBLE AND 0.55::DOUBLE THEN 1.0 ELSE 0.5 / g END, 6)::DOUBLE AS level, CASE WHEN g BETWEEN 0.45::DOUBLE AND 0.55::DOUBLE THEN 0 ELSE 1 END AS probes FROM a""",
    "lunar_plan": """WITH a AS (SELECT c_custkey AS k, greatest(20, least(400, floor((c_acctbal + 1000) * 5000000 * 0.25::DOUBLE / 25195876)))::BIGINT AS frames FROM customer),
b AS (SELECT *, frames * greatest(33.2::DOUBLE, k % 90 / 1.5::DOUBLE) / 1000.0 AS seconds FROM a)
SELECT k AS c_custkey, frames, greatest(1, least(frames, ceil(frames * greatest(1, least(100, k % 110)) / 100.0::DOUBLE)))::BIGINT AS stacked, round(seconds, 6) AS seconds, round(CASE WHEN k % 13 > 0 THEN seconds * 15.041::DOUBLE / (k % 13) ELSE 0.0 END, 6)::DOUBLE AS drift_px FROM b""",
    "frame_admission": f"""WITH {Q.FRAMES_SQL}, a AS (SELECT *, idx % 11 <> 0 AS ex, idx % 13 <> 0 AS re, CASE WHEN idx % 17 = 0 THEN 2000 ELSE 4096 END AS w FROM f),
b AS (SELECT *, first_value(CASE WHEN ex AND re THEN w END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fw FROM a)
SELECT idx, CASE WHEN NOT ex THEN 'missing' WHEN NOT re THEN 'unreadable' WHEN fw <> w THEN 'wrong size' WHEN idx % 3 <> 0 AND idx % 19 = 0 THEN 'not a rotation' END AS skip_reason FROM b""",
    "focus_store": """WITH o AS (SELECT user_id AS camera, min(value) AS hfr FROM events WHERE event_type = 'view' GROUP BY 1), n AS (SELECT user_id AS camera, max(value) AS hfr FROM events WHERE event_type = 'click' AND value > 60 GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE camera NOT IN (SELECT camera FROM n)""",
    "frame_description": f"WITH {Q.FRAMES_SQL} SELECT idx, concat_ws(' ', 'kind=' || kind, 'stars=' || star_count, 'override=' || included::VARCHAR) AS text FROM f",
    "log_tail": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25",
    "flat_judge": f"{FLATS} SELECT frame, median, peak, kept FROM k",
    "flat_build": f"{FLATS} SELECT x, y, median(v) AS v FROM s WHERE frame IN (SELECT frame FROM k WHERE kept) AND (SELECT count(*) FROM k WHERE kept) >= 5 GROUP BY 1, 2",
    "flat_evenness": f"""WITH {PLANE}, r AS (SELECT avg(v) FILTER (WHERE abs(x + 0.5 - 32) <= 4 AND abs(y + 0.5 - 24) <= 4) AS c, avg(v) FILTER (WHERE (x < 8 OR x >= 56) AND (y < 8 OR y >= 40)) AS k FROM p)
SELECT round(c, 6) AS centre, round(k, 6) AS corners, round(k / c, 6) AS ratio, CASE WHEN c IS NULL OR k IS NULL OR c = 0 THEN 'UNKNOWN' WHEN k / c < 0.25 THEN 'STEEP' WHEN k / c > 1.05 THEN 'INVERTED' ELSE 'EVEN' END AS verdict FROM r""",
    "flat_left_join": """SELECT c_custkey AS session, CASE WHEN n_regionkey * 100 = c_custkey % 5 * 100 THEN n_name END AS flat, CASE WHEN n_name IS NULL THEN 'no flat' WHEN n_regionkey * 100 <> c_custkey % 5 * 100 THEN 'wrong size' END AS note
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) n ON c_nationkey = n_nationkey""",
    "noise_level": f"WITH {PLANE}, l AS (SELECT list(abs(v - 25) ORDER BY abs(v - 25)) AS s FROM p WHERE (y * 64 + x) % 7 = 0) SELECT round(greatest(1e-6, 1.4826::DOUBLE * s[len(s) // 2 + 1]), 6) AS sigma FROM l",
    "background_surface": f"""WITH {PLANE}, t AS (SELECT x // 16 AS tx, y // 16 AS ty, median(v) AS m FROM p GROUP BY 1, 2), a AS (SELECT x, y, (x + 0.5::DOUBLE) / 16 - 0.5 AS ax, (y + 0.5::DOUBLE) / 16 - 0.5 AS ay FROM p),
b AS (SELECT *, greatest(0, least(2, floor(ax)))::BIGINT AS x0, greatest(0, least(1, floor(ay)))::BIGINT AS y0 FROM a), c AS (SELECT *, ax - x0 AS fx, ay - y0 AS fy FROM b),
d AS (SELECT c.*, a.m AS m00, b.m AS m10, e.m AS m01, g.m AS m11 FROM c LEFT JOIN t a ON a.tx = x0 AND a.ty = y0 LEFT JOIN t b ON b.tx = x0 + 1 AND b.ty = y0 LEFT JOIN t e ON e.tx = x0 AND e.ty = y0 + 1 LEFT JOIN t g ON g.tx = x0 + 1 AND g.ty = y0 + 1)
SELECT x, y, round((m00 + (m10 - m00) * fx) + ((m01 + (m11 - m01) * fx) - (m00 + (m10 - m00) * fx)) * fy, 6) AS background FROM d""",
    "hot_repair": """WITH p AS (SELECT l_partkey % 64 AS x, l_suppkey % 48 AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), a AS (SELECT list(v ORDER BY v) AS s FROM p), m AS (SELECT s[len(s) // 2 + 1] AS m, s FROM a),
d AS (SELECT m, list_sort(list_transform(s, lambda v: abs(v - m))) AS d FROM m), t AS (SELECT m + 2.5::DOUBLE * greatest(1.4826::DOUBLE * d[len(d) // 2 + 1], 0.5) AS t FROM d),
n AS (SELECT p.x, p.y, median(q.v) AS r FROM p JOIN p q ON (abs(p.x - q.x) = 2 AND p.y = q.y) OR (abs(p.y - q.y) = 2 AND p.x = q.x) GROUP BY 1, 2)
SELECT p.x, p.y, CASE WHEN v > t AND r IS NOT NULL THEN r ELSE v END AS v FROM p CROSS JOIN t LEFT JOIN n ON p.x = n.x AND p.y = n.y""",
}
