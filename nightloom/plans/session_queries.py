"""Catalogue queries bound to orders: folder = o_orderkey, camera = o_orderpriority, state from o_orderstatus, start = o_orderdate,
integration = o_totalprice, label = the customer's name (none for every seventh order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import sessions as S

COLUMNS = [
    "CAST(o_orderkey AS STRING) AS folder",
    "CASE WHEN o_orderkey % 7 <> 0 THEN c_name ELSE '' END AS label",
    "o_orderpriority AS camera",
    "CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'FAILED' ELSE 'CAPTURING' END ELSE 'AWAITING_DARKS' END AS state",
    "o_orderdate AS started",
    "o_totalprice AS integration_seconds",
    "CAST(o_orderkey % 150 AS INT) AS lights",
    "CAST(o_custkey % 120 AS INT) AS planned",
    "CAST(floor(o_totalprice) AS BIGINT) * 4099 AS size_bytes",
    "o_orderkey % 3 = 0 AS stacked",
    "o_custkey AS target",
    "CAST(o_orderkey % 90 AS DOUBLE) AS altitude",
    "CAST(o_orderkey * 7 % 360 AS DOUBLE) AS azimuth",
]
SQL = "WITH s AS (SELECT " + ", ".join(COLUMNS) + " FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").selectExpr(*COLUMNS)


def session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.matching(sessions(spark, sf_dir), " Customer#00000001 ", ["1-URGENT", "5-LOW", "2-HIGH"], ["DONE", "FAILED"]).select("folder", "label", "camera", "state")


def session_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.recent(sessions(spark, sf_dir), 50, "TARGET").select("place", "folder", "label")


def session_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ordered(S.matching(sessions(spark, sf_dir), only_stacked=True, only_attention=True), "CAMERA").select("folder", "camera", "started")


def summary_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(sessions(spark, sf_dir)).withColumn("minutes", F.round("minutes", 6))


def interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interrupted(sessions(spark, sf_dir)).select("folder", "state", "remaining")


def most_recent_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.most_recent(S.interrupted(sessions(spark, sf_dir)), "camera")


def storage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.storage_totals(sessions(spark, sf_dir))


def storage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).withColumns({"light_bytes": F.col("lights").cast("long") * F.lit(25_000_000), "dark_bytes": F.col("planned").cast("long") * F.lit(20_000_000), "master_bytes": F.when(F.col("stacked"), F.col("size_bytes")).otherwise(0)})
    return S.storage_plan(s.withColumns({c: F.col(c).cast("long") for c in ("light_bytes", "dark_bytes", "master_bytes")}))


def distinct_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).where("camera <> ''").select("camera", "state").distinct()


def day_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.day_names(sessions(spark, sf_dir))


def sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", S.sanitise(F.concat_ws("/", F.lit(" "), "p_name", "p_brand", F.lit("*"), "p_type", F.lit("?"))).alias("name"))


def night_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.night_plan(sessions(spark, sf_dir).withColumn("frames", F.col("lights") - 25), "target")


def _settings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = lambda c: c.cast("string")
    now = part.select("p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), text(F.col("p_size"))).alias("settings"))
    then = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), text(F.col("p_size") - F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)), F.lit("type"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")))
    empty = F.create_map().cast("map<string,string>")
    before = part.select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, empty).otherwise(then).alias("settings"))
    return before, now


def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.settings_diff(*_settings(spark, sf_dir), "p_partkey")


def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.staleness(*_settings(spark, sf_dir), "p_partkey")


def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir)
    return S.next_version(s.select("target", F.col("folder").cast("long").alias("id"), F.col("state").alias("label")), "target")


def format_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).select("folder", S.format_duration(F.col("integration_seconds") / 40).alias("duration"), S.format_bytes(F.col("size_bytes")).alias("size"))


def session_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session logs as JSON documents, read back under a schema; documents that do not parse are kept as unreadable."""
    s = sessions(spark, sf_dir).withColumn("doc", F.to_json(F.struct("folder", "label", "lights", "stacked", F.struct("altitude", "azimuth").alias("pointing"))))
    s = s.withColumn("doc", F.when(F.col("lights") % 10 == 3, F.expr("left(doc, length(doc) - 5)")).otherwise(F.col("doc")))
    schema = "folder string, label string, lights int, stacked boolean, pointing struct<altitude: double, azimuth: double>, corrupt string"
    got = s.select("folder", F.from_json("doc", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("d"))
    bad = F.col("d.corrupt").isNotNull()
    return got.select("folder", bad.alias("unreadable"), F.when(~bad, F.col("d.lights")).alias("lights"), F.when(~bad, F.col("d.pointing.altitude")).alias("altitude"))


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("sum_k"), F.count("*").alias("n"))


SETTINGS = """p AS (SELECT p_partkey, unnest(['brand', 'type', 'size']) AS setting, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS b,
  unnest([p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_type END, CAST(p_size - CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR)]) AS a0 FROM part),
d AS (SELECT p_partkey, setting, CASE WHEN p_partkey % 11 <> 0 THEN a0 END AS a, b FROM p)"""
QUERIES = {
    "session_filter": session_filter, "session_recent": session_recent, "session_sort": session_sort, "summary_projection": summary_projection, "interrupted": interrupted,
    "most_recent_session": most_recent_session, "storage_totals": storage_totals, "storage_plan": storage_plan, "distinct_cameras": distinct_cameras, "day_naming": day_naming,
    "sanitise": sanitise, "night_plan": night_plan, "version_diff": version_diff, "staleness": staleness, "next_version": next_version, "format_text": format_text,
    "session_json": session_json, "props_json": props_json,
}
LEFT = "s.planned - s.lights > 0 AND state IN ('CAPTURING','PAUSED','FOCUSING','AWAITING_DARKS','DARKS','FINALISING')"
ORACLES = {
    "session_filter": f"{SQL} SELECT folder, label, camera, state FROM s WHERE contains(lower(label || ' ' || folder), 'customer#00000001') AND camera IN ('1-URGENT','5-LOW','2-HIGH') AND state IN ('DONE','FAILED')",
    "session_recent": f"{SQL} SELECT row_number() OVER (ORDER BY trim(label) = '', lower(label), folder) AS place, folder, label FROM s QUALIFY place <= 50",
    "session_sort": f"{SQL} SELECT folder, camera, started FROM s WHERE stacked AND state IN ('FAILED','PAUSED','AWAITING_DARKS')",
    "summary_projection": f"""{SQL} SELECT folder, coalesce(nullif(trim(label), ''), strftime(started, '%H:%M')) AS label, lights, round(integration_seconds / 60.0::DOUBLE, 6) AS minutes, stacked,
CASE WHEN state = 'DONE' THEN CASE WHEN stacked THEN 'Stacked' ELSE 'Stack now' END WHEN state = 'FAILED' THEN 'Failed' WHEN state = 'CAPTURING' THEN 'Running' ELSE 'Unfinished' END AS badge, state IN ('FAILED','PAUSED','AWAITING_DARKS') AS needs_attention FROM s""",
    "interrupted": f"{SQL} SELECT folder, state, planned - lights AS remaining FROM s WHERE {LEFT}",
    "most_recent_session": f"{SQL} SELECT camera, arg_max(folder, (started, folder)) AS folder, max(started) AS started FROM s WHERE {LEFT} GROUP BY 1",
    "storage_totals": f"{SQL} SELECT count(*)::BIGINT AS sessions, sum(size_bytes)::BIGINT AS total_bytes, sum(CASE WHEN stacked THEN size_bytes ELSE 0 END)::BIGINT AS stacked_bytes, sum(CASE WHEN stacked THEN 0 ELSE size_bytes END)::BIGINT AS unstacked_bytes FROM s",
    "storage_plan": f"""{SQL}, b AS (SELECT folder, state, lights::BIGINT * 25000000 AS l, planned::BIGINT * 20000000 AS d, CASE WHEN stacked THEN size_bytes ELSE 0 END AS m FROM s),
c AS (SELECT *, CASE WHEN m > 0 AND state <> 'CAPTURING' AND l + d > 0 THEN l + d END AS a1, CASE WHEN m > 0 AND d > 0 THEN d END AS a2, CASE WHEN m > 0 THEN m END AS a3 FROM b),
e AS (SELECT *, greatest(a1, a2, a3) AS best FROM c)
SELECT folder, (l + d + m)::BIGINT AS total_bytes, CASE WHEN best IS NULL THEN NULL WHEN a1 = best THEN 'Delete subs, keep the master' WHEN a2 = best THEN 'Delete darks, keep the lights' ELSE 'Delete the masters, keep the subs' END AS best_action, best::BIGINT AS best_bytes FROM e""",
    "distinct_cameras": f"{SQL} SELECT DISTINCT camera, state FROM s WHERE camera <> ''",
    "day_naming": f"{SQL}, n AS (SELECT folder, strftime(started, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(started, '%Y-%m-%d') ORDER BY started, folder) AS n FROM s) SELECT folder, CASE WHEN n = 1 THEN day ELSE day || '-' || n END AS day_name FROM n",
    "sanitise": "SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(trim(' /' || p_name || '/' || p_brand || '/*/' || p_type || '/?'), '[^A-Za-z0-9._-]+', '-', 'g'), '-'), 48), ''), 'session') AS name FROM part",
    "night_plan": f"""{SQL}, n AS (SELECT *, lights - 25 AS frames FROM s), r AS (SELECT target, arg_max({{'folder': folder, 'camera': camera, 'alt': altitude, 'az': azimuth}}, (integration_seconds, folder)) AS ref FROM n WHERE frames > 0 GROUP BY 1),
j AS (SELECT n.*, ref, abs(azimuth - ref.az) AS turn FROM n LEFT JOIN r USING (target)),
k AS (SELECT *, sqrt(pow(altitude - ref.alt, 2) + pow((CASE WHEN turn > 180 THEN 360 - turn ELSE turn END) * cos(radians((altitude + ref.alt) / 2)), 2)) AS apart FROM j)
SELECT target, folder, ref.folder AS reference, CASE WHEN ref IS NULL THEN 'REJECT_EMPTY' WHEN folder = ref.folder THEN 'REFERENCE' WHEN camera <> ref.camera THEN 'REJECT_CAMERA' WHEN apart > 15 THEN 'REJECT_POINTING' WHEN frames <= 0 THEN 'REJECT_EMPTY' ELSE 'INCLUDE' END AS verdict FROM k""",
    "version_diff": f"WITH {SETTINGS} SELECT p_partkey, setting, a, b FROM d WHERE a IS DISTINCT FROM b",
    "staleness": f"WITH {SETTINGS} SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'UNKNOWN' WHEN bool_or(a IS DISTINCT FROM b) THEN 'STALE' ELSE 'CURRENT' END AS verdict FROM d GROUP BY 1",
    "next_version": f"{SQL} SELECT target, max(folder::BIGINT) + 1 AS next_id, arg_max(state, folder::BIGINT) AS current_label FROM s GROUP BY 1",
    "format_text": f"""{SQL}, t AS (SELECT folder, floor(integration_seconds / 40)::BIGINT AS t, size_bytes AS b FROM s)
SELECT folder, CASE WHEN t >= 3600 THEN printf('%dh %02dm', t // 3600, (t % 3600) // 60) WHEN t >= 60 THEN printf('%dm %02ds', t // 60, t % 60) ELSE printf('%ds', t) END AS duration,
CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN printf('%.0f MB', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN printf('%.0f KB', b / 1024.0::DOUBLE) ELSE printf('%d B', b) END AS size FROM t""",
    "session_json": f"{SQL} SELECT folder, lights % 10 = 3 AS unreadable, CASE WHEN lights % 10 <> 3 THEN lights END AS lights, CASE WHEN lights % 10 <> 3 THEN altitude END AS altitude FROM s",
    "props_json": "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k, count(*)::BIGINT AS n FROM events GROUP BY 1",
}
