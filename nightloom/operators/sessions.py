"""The catalogue of sessions: filters, orders, badges, storage, naming, multi-night plans and settings that differ.

A sessions table has folder, label, camera, state, started, integration_seconds, lights, planned, size_bytes, stacked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: States, the pointing beyond which nights are not one target, name length.
INTERRUPTED = ["CAPTURING", "PAUSED", "FOCUSING", "AWAITING_DARKS", "DARKS", "FINALISING"]
ATTENTION = ["FAILED", "PAUSED", "AWAITING_DARKS"]
MAX_POINTING_DEGREES, BACKGROUND_RATIO_WARNING, MAX_NAME = 15.0, 3.0, 48


def needs_attention(state: Column) -> Column:
    return state.isin(ATTENTION)


def badge(state: Column, stacked: Column) -> Column:
    return (
        F.when(state == "DONE", F.when(stacked, F.lit("Stacked")).otherwise(F.lit("Stack now")))
        .when(state == "FAILED", F.lit("Failed"))
        .when(state.isin("CAPTURING", "DARKS", "FINALISING"), F.lit("Running"))
        .when(state.isin("PAUSED", "AWAITING_DARKS"), F.lit("Unfinished"))
        .otherwise(F.lit("Empty"))
    )


def matching(sessions: DataFrame, query: str = "", cameras: list[str] | None = None, states: list[str] | None = None, only_stacked: bool = False, only_attention: bool = False) -> DataFrame:
    """All given conditions hold; the query is a plain substring of label and folder, without wildcards."""
    s, needle = sessions, query.strip().lower()
    if needle:
        s = s.where(F.instr(F.lower(F.concat_ws(" ", "label", "folder")), needle) > 0)
    if cameras:
        s = s.where(F.col("camera").isin(cameras))
    if states:
        s = s.where(F.col("state").isin(states))
    if only_stacked:
        s = s.where("stacked")
    return s.where(needs_attention(F.col("state"))) if only_attention else s


def ordered(sessions: DataFrame, order: str = "NEWEST") -> DataFrame:
    """NEWEST, OLDEST, TARGET (unlabelled last), CAMERA, LONGEST or LARGEST; ties by folder."""
    unlabelled = F.trim(F.coalesce("label", F.lit(""))) == ""
    keys = {
        "NEWEST": [F.desc("started")], "OLDEST": [F.asc("started")], "TARGET": [unlabelled, F.lower("label")], "CAMERA": [F.asc("camera"), F.desc("started")],
        "LONGEST": [F.desc("integration_seconds")], "LARGEST": [F.desc("size_bytes")],
    }[order]
    return sessions.orderBy(*keys, "folder")


def recent(sessions: DataFrame, limit: int, order: str = "NEWEST") -> DataFrame:
    """The first `limit` sessions in an order, with their place from 1."""
    top = ordered(sessions, order).limit(limit)
    return top.withColumn("place", F.monotonically_increasing_id() + 1)


def summary(sessions: DataFrame) -> DataFrame:
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.date_format("started", "HH:mm"))
    return sessions.select(
        "folder", label.alias("label"), "lights", (F.col("integration_seconds") / 60.0).alias("minutes"), "stacked",
        badge(F.col("state"), F.col("stacked")).alias("badge"), needs_attention(F.col("state")).alias("needs_attention"),
    )


def interrupted(sessions: DataFrame) -> DataFrame:
    """Sessions that can go on, with what is left to shoot."""
    left = F.greatest(F.col("planned") - F.col("lights"), F.lit(0))
    return sessions.withColumn("remaining", left).where(F.col("state").isin(INTERRUPTED) & (F.col("remaining") > 0))


def most_recent(sessions: DataFrame, by: str) -> DataFrame:
    return sessions.groupBy(by).agg(F.max(F.struct("started", "folder")).alias("m")).select(by, F.col("m.folder").alias("folder"), F.col("m.started").alias("started"))


def storage_totals(sessions: DataFrame) -> DataFrame:
    size = F.col("size_bytes")
    return sessions.agg(
        F.count("*").alias("sessions"), F.sum(size).alias("total_bytes"),
        F.sum(F.when(F.col("stacked"), size).otherwise(0)).alias("stacked_bytes"), F.sum(F.when(~F.col("stacked"), size).otherwise(0)).alias("unstacked_bytes"),
    )


def storage_plan(sessions: DataFrame) -> DataFrame:
    """folder, total_bytes and the action that frees most, of three, each of which may be blocked; light_bytes, dark_bytes and
    master_bytes are given."""
    has_master = F.col("master_bytes") > 0
    actions = F.array(
        F.struct((F.col("light_bytes") + F.col("dark_bytes")).alias("bytes"), F.lit(2).alias("first"), F.lit("Delete subs, keep the master").alias("action"), (has_master & (F.col("state") != "CAPTURING")).alias("free")),
        F.struct(F.col("dark_bytes").alias("bytes"), F.lit(1).alias("first"), F.lit("Delete darks, keep the lights").alias("action"), has_master.alias("free")),
        F.struct(F.col("master_bytes").alias("bytes"), F.lit(0).alias("first"), F.lit("Delete the masters, keep the subs").alias("action"), has_master.alias("free")),
    )
    best = F.array_max(F.filter(actions, lambda a: a["free"] & (a["bytes"] > 0)))
    s = sessions.withColumn("best", best)
    return s.select("folder", (F.col("light_bytes") + F.col("dark_bytes") + F.col("master_bytes")).alias("total_bytes"), F.col("best.action").alias("best_action"), F.col("best.bytes").alias("best_bytes"))


def day_names(sessions: DataFrame) -> DataFrame:
    """folder, day_name: the day a session started, with -2, -3, ... for further sessions of that day."""
    day = F.date_format("started", "yyyy-MM-dd")
    n = F.row_number().over(W.partitionBy("day").orderBy("started", "folder"))
    s = sessions.withColumn("day", day).withColumn("n", n)
    return s.select("folder", F.when(F.col("n") == 1, F.col("day")).otherwise(F.concat_ws("-", "day", F.col("n").cast("string"))).alias("day_name"))


def sanitise(text: Column) -> Column:
    """A name for a folder: runs of other characters become a hyphen, none at the ends, at most 48 characters."""
    clean = F.left(F.btrim(F.regexp_replace(F.trim(text), "[^A-Za-z0-9._-]+", "-"), F.lit("-")), F.lit(MAX_NAME))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("session"))


def separation_degrees(alt_a: Column, az_a: Column, alt_b: Column, az_b: Column) -> Column:
    """Angle between two pointings, flat about their mean altitude; null where any part is missing."""
    turn = F.abs(az_b - az_a)
    d_az = F.when(turn > 180, 360 - turn).otherwise(turn) * F.cos(F.radians((alt_a + alt_b) / 2))
    return F.hypot(alt_b - alt_a, d_az)


def night_plan(nights: DataFrame, by: str) -> DataFrame:
    """Every night with its group's reference (most integration among nights with frames, ties by folder) and a verdict; where no
    night of a group has frames, there is no reference and each is REJECT_EMPTY.

    nights: by, folder, camera, integration_seconds, frames, altitude, azimuth. The reference is one row a group."""
    reference = (
        nights.where("frames > 0").groupBy(by)
        .agg(F.max_by(F.struct("folder", "camera", "altitude", "azimuth"), F.struct("integration_seconds", "folder")).alias("ref"))
    )
    n = nights.join(reference, by, "left")
    apart = separation_degrees(F.col("ref.altitude"), F.col("ref.azimuth"), F.col("altitude"), F.col("azimuth"))
    verdict = (
        F.when(F.col("ref").isNull(), F.lit("REJECT_EMPTY"))
        .when(F.col("folder") == F.col("ref.folder"), F.lit("REFERENCE"))
        .when(F.col("camera") != F.col("ref.camera"), F.lit("REJECT_CAMERA"))
        .when(apart > MAX_POINTING_DEGREES, F.lit("REJECT_POINTING"))
        .when(F.col("frames") <= 0, F.lit("REJECT_EMPTY"))
        .otherwise(F.lit("INCLUDE"))
    )
    return n.select(by, "folder", F.col("ref.folder").alias("reference"), verdict.alias("verdict"))


def settings_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, setting, a, b of every setting that differs between two tables of key, settings (a map)."""
    left = a.select(key, F.explode("settings").alias("setting", "a"))
    right = b.select(key, F.explode("settings").alias("setting", "b"))
    return left.join(right, [key, "setting"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(key, "setting", "a", "b")


def staleness(recorded: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key, verdict: UNKNOWN where nothing was recorded, STALE where anything differs, else CURRENT."""
    changed = settings_diff(recorded, current, key).groupBy(key).agg(F.count("*").alias("n"))
    verdict = F.when(F.size("settings") == 0, F.lit("UNKNOWN")).when(F.col("n") > 0, F.lit("STALE")).otherwise(F.lit("CURRENT"))
    return recorded.join(changed, key, "left").select(key, verdict.alias("verdict"))


def next_version(versions: DataFrame, by: str) -> DataFrame:
    """by, next_id, current_label: the id that comes next, and the label of the newest version."""
    return versions.groupBy(by).agg((F.max("id") + 1).alias("next_id"), F.max_by("label", "id").alias("current_label"))


def format_duration(seconds: Column) -> Column:
    t = F.floor(seconds).cast("long")
    h, m, s = F.floor(t / 3600), F.floor((t % 3600) / 60), t % 60
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def format_bytes(n: Column) -> Column:
    b = n.cast("double")
    return (
        F.when(n >= 1 << 30, F.format_string("%.1f GB", b / float(1 << 30)))
        .when(n >= 1 << 20, F.format_string("%.0f MB", b / float(1 << 20)))
        .when(n >= 1 << 10, F.format_string("%.0f KB", b / float(1 << 10)))
        .otherwise(F.format_string("%d B", n))
    )
