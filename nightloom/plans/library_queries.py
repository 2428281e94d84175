"""Library queries: sessions as in session_queries, nights and options as in orders and part."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import library as L
from nightloom.operators import pose, waiting
from nightloom.plans.session_queries import SQL, sessions
from nightloom.sources import frames
from nightloom.sources.library import FlatLibrary
from nightloom.sources.store import shared_folder
from nightloom.streaming import frames as S

LOG = "folder string, label string, lights int, started timestamp, pointing struct<altitude: double, azimuth: double>"


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs as JSON documents; those of failed sessions break off."""
    s = sessions(spark, sf_dir).withColumn("doc", F.to_json(F.struct("folder", "label", "lights", "started", F.struct("altitude", "azimuth").alias("pointing"))))
    s = s.withColumn("doc", F.when(F.col("state") == "FAILED", F.expr("left(doc, length(doc) - 5)")).otherwise(F.col("doc")))
    return L.scan(s.select("folder", "doc"), "doc", LOG)


def session_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest(_scanned(spark, sf_dir), F.col("log.started"), "folder").select("folder", F.col("log.lights").alias("lights"), "sessions", "n_unreadable")


def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of each customer's latest session, if it can be read; customers without a session look for an empty name."""
    latest = sessions(spark, sf_dir).groupBy("target").agg(F.max_by("folder", F.struct("started", "folder")).alias("folder"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    names = c.join(latest, c.c_custkey == latest.target, "left").select("c_custkey", F.coalesce("folder", F.lit("")).alias("folder"))
    return L.lookup(_scanned(spark, sf_dir), "folder", names).select("c_custkey", "folder", F.col("log.lights").alias("lights"))


def session_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's selection: the done sessions, toggled by the latest session, then what is not stacked of it."""
    s = sessions(spark, sf_dir).groupBy("target").agg(
        F.array_sort(F.collect_list(F.when(F.col("state") == "DONE", F.col("folder")))).alias("selection"),
        F.max_by("folder", F.struct("started", "folder")).alias("latest"), F.collect_list(F.when(~F.col("stacked"), F.col("folder"))).alias("existing"),
    )
    kept = L.retaining(L.toggled(F.col("selection"), F.col("latest")), F.col("existing"))
    return s.select("target", F.size(L.toggled(F.col("selection"), F.col("latest"))).alias("n_toggled"), F.array_join(F.array_sort(kept), ",").alias("kept"))


def exposure_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("exposure_set", F.col("l_returnflag"))
    return L.exposure_set(frames, "R").groupBy("l_orderkey").agg(F.count("*").alias("frames"), F.sum("l_quantity").alias("seconds"))


def state_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).withColumn("finished", F.when(F.col("stacked"), F.col("started")))
    done = F.col("lights") >= F.col("planned")
    moved = L.with_state("state", "finished", F.when(done, F.lit("DONE")).otherwise(F.col("state")), F.when(done & (F.col("state") == "CAPTURING"), F.date_add(F.col("started"), 1).cast("timestamp_ntz")))
    return s.select("folder", *moved)


def settings_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as settings: some keys absent, some values unknown or out of bounds. What was read is written and read once more."""
    k = F.col("p_partkey")
    method = F.array(*[F.lit(m) for m in (*L.METHODS, "NEWER", None)])[(k % 6).cast("int")]
    crop = F.when(k % 5 == 0, F.lit("FULL_FRAME")).when(k % 5 == 1, F.lit("COMMON_AREA")).when(k % 5 == 2, F.lit("?"))
    keep = F.when(k % 7 == 0, F.lit("many")).when(k % 7 == 1, F.lit(None)).otherwise(((k * 37) % 160 - 20).cast("string"))
    weighted = F.when(k % 4 == 0, F.lit("true")).when(k % 4 == 1, F.lit("TRUE")).when(k % 4 == 2, F.lit("false"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", L.settings_of(L.settings_map(method, crop, keep, weighted)).alias("s"))
    again = L.settings_of(L.settings_map(F.col("s.method"), F.col("s.crop"), F.col("s.keep"), F.col("s.weighted")))
    return p.select("p_partkey", "s.*", (again == F.col("s")).alias("returns"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("lights") < 20, F.lit("too few frames")).when(F.col("state") == "FAILED", F.lit("failed"))
    n = sessions(spark, sf_dir).select("target", "folder", "camera", F.col("lights").alias("frames"), F.col("integration_seconds").alias("seconds"), reason.alias("reason"))
    r = F.col("record")
    return L.provenance(n, "target").select("target", r["nights"].alias("nights"), r["camera"].alias("camera"), r["frames"].alias("frames"), r["rejected"].alias("rejected"), F.size(F.map_keys(r)).alias("n_keys"))


def camera_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as devices, parts as cameras: larger ones come first, and those that are too dear cannot expose the moon."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    options = part.select("p_brand", F.col("p_partkey").alias("camera"), F.struct(-F.col("p_size"), F.col("p_partkey")).alias("place"), (F.col("p_retailprice") % 10 < 5).alias("usable"), (F.col("p_size") * 3).alias("across"))
    return pose.camera_note(options, part.select("p_brand", F.col("p_partkey").alias("chosen")), "p_brand")


def _waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ask for an exposure, their lines are frames by the day of shipping; urgent orders give up early."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    none = F.lit(None)
    refuse = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2)
    asks = o.select(
        F.col("o_orderkey").alias("request"), F.col("o_orderdate").alias("ts"), F.lit(0).cast("long").alias("idx"), F.lit("ASK").alias("kind"), F.lit(2_000_000).cast("long").alias("exposure_ns"),
        (F.col("o_custkey") % 2).alias("generation"), refuse.alias("refuse_after"), F.lit(60 * 86_400_000 + 43_200_000).cast("long").alias("timeout_ms"),
    )
    applied = F.when(F.col("l_returnflag") == "R", 2_000_000 + F.col("l_quantity").cast("long") * 500).when(F.col("l_returnflag") == "N", F.lit(2_000_000)).cast("long")
    frames = line.select(
        F.col("l_orderkey").alias("request"), F.col("l_shipdate").alias("ts"), F.col("l_linenumber").cast("long").alias("idx"), F.lit("FRAME").alias("kind"), applied.alias("exposure_ns"),
        (F.col("l_linenumber") % 3).cast("long").alias("generation"), none.cast("int").alias("refuse_after"), none.cast("long").alias("timeout_ms"),
    )
    return asks.unionByName(frames)


def frame_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waiting.outcomes(_waits(spark, sf_dir))


def stream_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream in order of time. A row far in the future moves the watermark on, so that timers end what is open."""
    out = shared_folder(spark, "stream")
    w = _waits(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    last = spark.range(1).select(F.lit(-1).cast("long").alias("request"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("idx"), F.lit("FRAME").alias("kind"))
    w = w.unionByName(last, allowMissingColumns=True)
    cut = F.lit("1995-01-01").cast("timestamp")
    parts = [w.where(F.col("ts") < cut), w.where((F.col("ts") >= cut) & (F.col("request") >= 0)), w.where("request < 0")]
    with S.rocks(spark):
        for n, part in enumerate(parts):  # each run takes what is new and goes on from the checkpoint
            part.write.mode("append").parquet(f"{out}/waits/{n}")
            source = spark.readStream.schema(w.schema).parquet(f"{out}/waits/{{{','.join(map(str, range(n + 1)))}}}")
            S.drain(waiting.outcomes_stream(source), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(waiting.OUTCOME).parquet(f"{out}/rows")


def flat_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat for each region from the parts of its suppliers: saved, asked for at the right and at a wrong size, read again."""
    flats = FlatLibrary(spark, shared_folder(spark, "flats"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(n, "s_nationkey").groupBy("n_regionkey", (F.col("s_suppkey") % 8).alias("x"), F.floor(F.col("s_suppkey") % 48 / 8).alias("y")).agg(F.max("s_acctbal").alias("v"))
    every = spark.range(5).withColumnRenamed("id", "n_regionkey").crossJoin(spark.range(8).withColumnRenamed("id", "x")).crossJoin(spark.range(6).withColumnRenamed("id", "y"))  # 5 flats of 8 by 6
    rows = every.join(s, ["n_regionkey", "x", "y"], "left").groupBy("n_regionkey", F.col("y").cast("int").alias("top")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", F.coalesce("v", F.lit(0.0)).alias("v")))), lambda c: c["v"].cast("float")).alias("values"))
    for k in range(5):  # the regions
        flats.save(str(k), rows.where(F.col("n_regionkey") == k).select("top", "values"), 8, 6, frames=k + 1)
    parts = [flats.flat(str(k), 8, 6) for k in range(5)]
    refused = sum(flats.flat(str(k), 6, 8) is None for k in range(5))
    read = functools.reduce(DataFrame.unionByName, [frames.master_pixels(p).withColumn("camera", F.lit(str(k))) for k, p in enumerate(parts)])
    return read.join(flats.cameras().select("camera", "frames"), "camera").select("camera", "x", "y", "v", "frames", F.lit(refused).alias("refused"))


QUERIES = {
    "frame_waits": frame_waits, "stream_waits": stream_waits, "flat_library": flat_library,
    "session_scan": session_scan, "session_lookup": session_lookup, "session_selection": session_selection, "exposure_set": exposure_set, "state_transition": state_transition,
    "settings_round_trip": settings_round_trip, "provenance": provenance, "camera_note": camera_note,
}
WAITS = """WITH f AS (SELECT o_orderkey AS request, l_linenumber::BIGINT AS idx, l_shipdate AS ts, CASE l_returnflag WHEN 'R' THEN 2000000 + l_quantity::BIGINT * 500 WHEN 'N' THEN 2000000 END AS e, l_linenumber % 3 AS g, o_custkey % 2 AS least,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS refuse FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY + INTERVAL 12 HOUR),
k AS (SELECT *, coalesce(abs(e - 2000000) <= 21000, false) AS ok, row_number() OVER o AS n, sum(coalesce(abs(e - 2000000) <= 21000, false)::INT) OVER o AS island FROM f WINDOW o AS (PARTITION BY request ORDER BY ts, idx)),
r AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY request, island ORDER BY ts, idx) AS run FROM k), x AS (SELECT *, CASE WHEN ok AND g >= least THEN 'FRAME' WHEN NOT ok AND run >= refuse THEN 'REFUSED' END AS outcome FROM r),
z AS (SELECT request, arg_min({'o': outcome, 'i': idx, 'e': e, 'n': n}, n) FILTER (WHERE outcome IS NOT NULL) AS z, count(*) AS total FROM x GROUP BY 1)
SELECT o_orderkey AS request, coalesce(z.o, 'TIMEOUT') AS outcome, z.i AS idx, z.e AS applied_ns, coalesce(z.n - (z.o = 'FRAME')::INT, total, 0)::INT AS skipped FROM orders LEFT JOIN z ON request = o_orderkey"""
ORACLES = {
    "frame_waits": WAITS, "stream_waits": WAITS,
    "flat_library": """WITH s AS (SELECT n_regionkey AS k, s_suppkey % 8 AS x, s_suppkey % 48 // 8 AS y, max(s_acctbal) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3)
SELECT k.range::VARCHAR AS camera, x.range AS x, y.range AS y, CAST(coalesce(v, 0.0) AS FLOAT)::DOUBLE AS v, (k.range + 1)::INT AS frames, 5 AS refused FROM range(5) k, range(8) x, range(6) y LEFT JOIN s ON s.k = k.range AND s.x = x.range AND s.y = y.range""",
    "session_scan": f"{SQL}, c AS (SELECT count(*)::BIGINT AS sessions, (count(*) FILTER (WHERE state = 'FAILED'))::BIGINT AS n_unreadable FROM s) SELECT folder, lights, sessions, n_unreadable FROM s, c WHERE state <> 'FAILED' ORDER BY started DESC, folder LIMIT 5",
    "session_lookup": f"{SQL}, l AS (SELECT target, arg_max(folder, (started, folder)) AS folder FROM s GROUP BY 1) SELECT c_custkey, coalesce(l.folder, '') AS folder, CASE WHEN s.state <> 'FAILED' THEN s.lights END AS lights FROM customer LEFT JOIN l ON target = c_custkey LEFT JOIN s ON s.folder = l.folder",
    "session_selection": f"""{SQL}, g AS (SELECT target, coalesce(list(folder) FILTER (WHERE state = 'DONE'), []) AS sel, arg_max(folder, (started, folder)) AS latest, coalesce(list(folder) FILTER (WHERE NOT stacked), []) AS ex FROM s GROUP BY 1),
t AS (SELECT *, CASE WHEN list_contains(sel, latest) THEN list_filter(sel, lambda x: x <> latest) ELSE list_append(sel, latest) END AS tog FROM g)
SELECT target, len(tog)::INT AS n_toggled, array_to_string(list_sort(list_filter(tog, lambda x: list_contains(ex, x))), ',') AS kept FROM t""",
    "exposure_set": "SELECT l_orderkey, count(*)::BIGINT AS frames, sum(l_quantity) AS seconds FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "state_transition": f"{SQL} SELECT folder, CASE WHEN lights >= planned THEN 'DONE' ELSE state END AS state, CASE WHEN lights >= planned AND state = 'CAPTURING' THEN CAST(CAST(started AS DATE) + 1 AS TIMESTAMP) WHEN stacked THEN CAST(started AS TIMESTAMP) END AS finished FROM s",
    "settings_round_trip": """SELECT p_partkey, CASE WHEN p_partkey % 6 < 4 THEN (['SIGMA_CLIP', 'KAPPA_SIGMA', 'MEDIAN', 'MEAN'])[p_partkey % 6 + 1] ELSE 'SIGMA_CLIP' END AS method, CASE WHEN p_partkey % 5 = 0 THEN 'FULL_FRAME' ELSE 'COMMON_AREA' END AS crop,
CASE WHEN p_partkey % 7 < 2 THEN 100 ELSE greatest(1, least(100, (p_partkey * 37) % 160 - 20)) END::INT AS keep, p_partkey % 4 = 0 AS weighted, true AS returns FROM part""",
    "provenance": f"""{SQL}, n AS (SELECT *, CASE WHEN lights < 20 THEN 'too few frames' WHEN state = 'FAILED' THEN 'failed' END AS reason FROM s),
g AS (SELECT target, coalesce(string_agg(folder, ',' ORDER BY folder) FILTER (WHERE reason IS NULL), '') AS nights, arg_min(camera, folder) FILTER (WHERE reason IS NULL) AS camera, coalesce(sum(lights) FILTER (WHERE reason IS NULL), 0) AS frames,
  string_agg(folder || ': ' || reason, '; ' ORDER BY folder || ': ' || reason) FILTER (WHERE reason IS NOT NULL) AS rejected FROM n GROUP BY 1)
SELECT target, nights, camera, CAST(CAST(frames AS BIGINT) AS VARCHAR) AS frames, rejected, (3 + (camera IS NOT NULL)::INT + (rejected IS NOT NULL)::INT)::INT AS n_keys FROM g""",
    "camera_note": """WITH o AS (SELECT p_brand, p_partkey AS camera, p_size * 3 AS across, p_retailprice % 10 < 5 AS usable, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part),
f AS (SELECT p_brand, arg_min({'c': camera, 'a': across}, place) AS best, arg_min({'c': camera, 'a': across}, place) FILTER (WHERE usable) AS other FROM o GROUP BY 1),
v AS (SELECT o.*, best, other, CASE WHEN NOT usable THEN CASE WHEN other IS NULL THEN 'NONE_USABLE' ELSE 'OTHER_USABLE' END WHEN best.c <> camera THEN 'LARGER' END AS verdict FROM o JOIN f USING (p_brand)),
n AS (SELECT *, CASE verdict WHEN 'OTHER_USABLE' THEN other WHEN 'LARGER' THEN best END AS named FROM v)
SELECT p_brand, camera AS chosen, verdict, named.c AS camera, named.a AS its_across, across FROM n""",
}
