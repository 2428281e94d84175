"""Bracketed sessions: a moon and a ground stacked apart, and the moon set into the ground where it stood at one instant.

The moon moves against the ground while the long frames are taken. Its bright disc in each of them gives a track; a straight line
through the track says where it stood at the ground stack's epoch, and the moon master is moved there. Centres are compared, not
edges: an overexposed disc blooms, so its size only tells whether both are the same object.

Everything is by session; samples are folded by sums, and a session's placing is one row that its pixels meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.operators import planes as P
from nightloom.operators import pose

#: Discs that a track needs; with fewer their mean place is taken.
TRACK = 3


def place_moon(samples: DataFrame, moons: DataFrame, epochs: DataFrame, width: float, height: float) -> DataFrame:
    """session, verdict, dx, dy, at_x, at_y, drift_px_s, fitted, radius of every session of epochs.

    samples: session, epoch_ms, centroid_x, centroid_y, pixels of the disc in each ground frame that shows one; moons: session,
    centroid_x, centroid_y, pixels of the disc in the moon master; epochs: session, epoch_ms of the ground stack. Verdicts: NO_DISC (in
    the moon master), NO_SAMPLES, AREA (sizes differ too much), SHIFT (too far apart), MATCHED."""
    t = samples.join(epochs.select("session", F.col("epoch_ms").alias("epoch")), "session").withColumn("t", F.col("epoch_ms") - F.col("epoch"))
    s = t.groupBy("session").agg(
        F.count("*").alias("n"), F.avg("pixels").alias("area"), F.avg("t").alias("mt"), F.var_pop("t").alias("vt"), F.avg("centroid_x").alias("mx"), F.avg("centroid_y").alias("my"),
        F.regr_slope("centroid_x", "t").alias("sx"), F.regr_slope("centroid_y", "t").alias("sy"),
    )
    m = moons.select("session", F.col("centroid_x").alias("moon_x"), F.col("centroid_y").alias("moon_y"), F.col("pixels").alias("moon_pixels"))
    j = epochs.select("session").join(m, "session", "left").join(s, "session", "left")
    fitted = F.coalesce((F.col("n") >= TRACK) & (F.col("vt") > 0), F.lit(False))
    at = lambda mean, slope: F.when(fitted, F.col(mean) - F.col(slope) * F.col("mt")).otherwise(F.col(mean))
    j = j.withColumns({"fitted": fitted, "at_x": at("mx", "sx"), "at_y": at("my", "sy"), "drift_px_s": F.when(fitted, F.hypot("sx", "sy") * 1000)})
    ratio = F.when(F.col("moon_pixels") > 0, F.col("area") / F.col("moon_pixels"))
    dx, dy = F.col("at_x") - F.col("moon_x"), F.col("at_y") - F.col("moon_y")
    most = pose.MASTER_AREA_RATIO
    verdict = (
        F.when(F.col("moon_x").isNull(), "NO_DISC").when(F.col("n").isNull(), "NO_SAMPLES").when(ratio.isNull() | (ratio > most) | (ratio < 1.0 / most), "AREA")
        .when(F.hypot(dx, dy) > pose.MOST_SHIFT_FRACTION * pose.MASTER_SHIFT_FACTOR * min(width, height), "SHIFT").otherwise("MATCHED")
    )
    j = j.withColumn("verdict", verdict)
    matched = lambda c: F.when(F.col("verdict") == "MATCHED", c)
    return j.select("session", "verdict", matched(dx).alias("dx"), matched(dy).alias("dy"), "at_x", "at_y", "drift_px_s", "fitted", F.sqrt(F.col("moon_pixels") / F.acos(F.lit(-1.0))).alias("radius"))


def set_in(ground: DataFrame, moon: DataFrame, placed: DataFrame) -> DataFrame:
    """session, x, y, channel, v, touched: each session's ground with its moon where it was placed, under a radial feather. A session
    whose moon was not placed keeps its ground. ground, moon: session, x, y, channel, v."""
    g = ground.join(placed.select("session", "at_x", "at_y", "dx", "dy", "radius"), "session", "left")
    feather = F.greatest(F.lit(P.LEAST_FEATHER), F.col("radius") * P.FEATHER)
    far = F.hypot(F.col("x") - F.col("at_x"), F.col("y") - F.col("at_y"))
    alpha = F.when(F.col("dx").isNull() | (far > F.col("radius") + feather), 0.0).when(far <= F.col("radius"), 1.0).otherwise(1.0 - (far - F.col("radius")) / feather)
    whole = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")
    g = g.withColumn("alpha", alpha).withColumns({"sx": whole(F.col("x") - F.col("dx")), "sy": whole(F.col("y") - F.col("dy"))})
    m = moon.select("session", "channel", F.col("x").cast("long").alias("sx"), F.col("y").cast("long").alias("sy"), F.col("v").alias("mv"))
    j = g.join(m, ["session", "channel", "sx", "sy"], "left")
    v = F.when((F.col("alpha") > 0) & F.col("mv").isNotNull(), F.coalesce("v", F.lit(0.0)) * (1.0 - F.col("alpha")) + F.col("mv") * F.col("alpha")).otherwise(F.col("v"))
    return j.select("session", "x", "y", "channel", v.alias("v"), (F.col("alpha") > 0).alias("touched"))


def bracketed_stack(ground: DataFrame, moon: DataFrame, frames: DataFrame, epochs: DataFrame, width: float, height: float) -> tuple[DataFrame, DataFrame]:
    """The composite and the placings. ground, moon: masters as session, x, y, channel, v (any stack's pixels); frames: the ground set's
    planes, session, epoch_ms, x, y, v; epochs: session, epoch_ms. Where a set has no master, there is nothing to place."""
    light = moon.groupBy("session", "x", "y").agg(F.avg("v").alias("v"))
    found = lambda planes, by: P.disc(planes, by).where("found")
    placed = place_moon(found(frames, ["session", "epoch_ms"]), found(light, ["session"]), epochs, width, height)
    return set_in(ground, moon, placed), placed
