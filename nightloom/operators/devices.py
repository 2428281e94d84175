"""Cameras and settings: derived optics, qualification by rules, matching of what was asked and what was applied, ladders, metering,
frame admission, stores that are updated by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the rules.
LEAST_MAX_EXPOSURE, SHORT_MAX_EXPOSURE = 2.0, 10.0
EXPOSURE_SLACK_NS, FOCUS_SLACK, FULL_FRAME_DIAGONAL = 1000, 0.02, 43.2666
MATRIX_TOLERANCE = 1e-6
MOST_LUNAR_FRAMES, LEAST_LUNAR_FRAMES, LUNAR_STORAGE_SHARE, READOUT_MS, CROSSINGS = 400, 20, 0.25, 33.2, 3.0


def optics(width_mm: Column, height_mm: Column, width_px: Column, focal_mm: Column, aperture: Column) -> Column:
    """struct(pitch_um, fov_deg, equivalent_mm, light): what follows from a camera's sizes; light is 1 / f-number squared."""
    diagonal = F.hypot(width_mm, height_mm)
    return F.struct(
        (width_mm * 1000.0 / width_px).alias("pitch_um"), F.degrees(2 * F.atan(diagonal / 2 / focal_mm)).alias("fov_deg"),
        (focal_mm * FULL_FRAME_DIAGONAL / diagonal).alias("equivalent_mm"), (1.0 / (aperture * aperture)).alias("light"),
    )


def qualify(cameras: DataFrame) -> DataFrame:
    """camera, n_fail, n_warn, tier. cameras: camera, level, raw, manual, max_exposure. The rules are rows of an array."""
    check = lambda fail, warn: F.when(fail, F.lit("FAIL")).when(warn, F.lit("WARN")).otherwise(F.lit("PASS"))
    level = check(~F.col("level").isin("FULL", "LEVEL_3", "LIMITED"), F.col("level") == "LIMITED")
    exposure = check(F.col("max_exposure") < LEAST_MAX_EXPOSURE, F.col("max_exposure") < SHORT_MAX_EXPOSURE)
    c = cameras.withColumn("checks", F.array(level, check(~F.col("raw"), F.lit(False)), check(~F.col("manual"), F.lit(False)), exposure))
    n = lambda v: F.size(F.filter("checks", lambda x: x == v)).cast("long")
    c = c.withColumns({"n_fail": n("FAIL"), "n_warn": n("WARN")})
    tier = F.when(F.col("n_fail") > 0, F.lit("UNSUPPORTED")).when(F.col("level") == "LIMITED", F.lit("DEGRADED")).when(F.col("n_warn") > 0, F.lit("FUNCTIONAL")).otherwise(F.lit("FULL"))
    return c.select("camera", "n_fail", "n_warn", tier.alias("tier"))


def pick_camera(qualified: DataFrame, by: str) -> DataFrame:
    """by, camera: the best usable camera of each group by light, ties by camera."""
    return qualified.where("tier <> 'UNSUPPORTED'").groupBy(by).agg(F.max_by("camera", F.struct("light", -F.col("camera"))).alias("camera"))


def exposure_matches(requested_ns: Column, applied_ns: Column) -> Column:
    return applied_ns.isNotNull() & (F.abs(applied_ns - requested_ns) <= F.floor(requested_ns / 100) + EXPOSURE_SLACK_NS)


def focus_matches(requested: Column, applied: Column) -> Column:
    return F.when(requested.isNull(), F.lit(True)).when(applied.isNull(), F.lit(False)).otherwise(F.abs(applied - requested) <= FOCUS_SLACK)


def black_level(levels: Column) -> Column:
    """The mean of the finite levels of an array; 0 where there is none."""
    good = F.filter(levels, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, v: a + v) / F.size(good)).otherwise(F.lit(0.0))


def iso_ladder(low: Column, high: Column) -> Column:
    """ISOs doubling from the lowest (25 at least) to the highest."""
    start = F.greatest(low, F.lit(25))
    steps = F.sequence(F.lit(0), F.lit(24))
    return F.filter(F.transform(steps, lambda k: (start * F.pow(F.lit(2), k)).cast("long")), lambda v: v <= high)


def meter(start: Column, gain: Column, target: float, low: float, high: float, probes: int = 4) -> Column:
    """struct(level, probes): an exposure is scaled by target over what it gives until that lies in the band, `probes` times at most.
    gain: brightness a unit of exposure."""
    state = F.struct(start.alias("level"), F.lit(0).alias("probes"))
    for _ in range(probes):
        s = state
        f = s["level"] * gain
        state = F.when((f >= low) & (f <= high), s).otherwise(F.struct((s["level"] * target / f).alias("level"), (s["probes"] + 1).alias("probes")))
    return state


def lunar_plan(free_bytes: Column, frame_bytes: int, exposure_ms: Column, arcsec_per_pixel: Column, keep_percent: Column, drift: float = 15.041) -> Column:
    """struct(frames, stacked, seconds, drift_px): as many frames as a quarter of the storage holds, within 20 and 400."""
    frames = F.greatest(F.lit(LEAST_LUNAR_FRAMES), F.least(F.lit(MOST_LUNAR_FRAMES), F.floor(free_bytes * LUNAR_STORAGE_SHARE / frame_bytes)))
    seconds = frames * F.greatest(F.lit(READOUT_MS), exposure_ms) / 1000.0
    stacked = F.greatest(F.lit(1), F.least(frames, F.ceil(frames * F.greatest(F.lit(1), F.least(F.lit(100), keep_percent)) / 100.0)))
    return F.struct(frames.alias("frames"), stacked.alias("stacked"), seconds.alias("seconds"), F.when(arcsec_per_pixel > 0, seconds * drift / arcsec_per_pixel).otherwise(F.lit(0.0)).alias("drift_px"))


def admit(frames: DataFrame, by: str, order: list[str]) -> DataFrame:
    """frames with skip_reason: a missing or unreadable file, another size than the first readable frame, or a matrix that is no
    rotation. frames: exists, readable, width, height, a, b, c, d (the matrix, all null without one)."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    size = F.struct("width", "height")
    first = F.first(F.when(F.col("exists") & F.col("readable"), size), True).over(w)
    rigid = (F.abs(F.col("a") - F.col("d")) <= MATRIX_TOLERANCE) & (F.abs(F.col("b") + F.col("c")) <= MATRIX_TOLERANCE) & (F.abs(F.col("a") * F.col("d") - F.col("b") * F.col("c") - 1) <= MATRIX_TOLERANCE)
    f = frames.withColumn("first_size", first)
    reason = (
        F.when(~F.col("exists"), F.lit("missing")).when(~F.col("readable"), F.lit("unreadable")).when(F.col("first_size") != size, F.lit("wrong size"))
        .when(F.col("a").isNotNull() & ~rigid, F.lit("not a rotation"))
    )
    return f.withColumn("skip_reason", reason).drop("first_size")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new rows, and the old ones whose key has no new row."""
    return old.join(new, key, "left_anti").unionByName(new)


def describe(parts: dict[str, Column]) -> Column:
    """key=value words, those without a value left out."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])
