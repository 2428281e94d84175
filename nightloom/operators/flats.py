"""Flat fields and pixel clean-up: building and judging flats, joining them to sessions, noise, background surfaces, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightloom.functions import arrays as A

#: Fixed values of flats and noise.
MOST_PEAK, LEAST_LEVEL, LEVEL_BAND, LEAST_FLATS, PEAK_PERCENTILE = 0.85, 0.10, 0.15, 5, 0.999
NOISE_STRIDE, LEAST_SIGMA = 7, 1e-6


def judge_flats(samples: DataFrame, white: float) -> DataFrame:
    """frame, median, peak, kept: frames that are neither clipped nor dark and near the typical level (upper median of those)."""
    # Counts of distinct values, of which a sensor has at most 65,536, so no frame is gathered whole.
    counts = samples.where(F.col("v").isNotNull()).groupBy("frame", "v").agg(F.count("*").alias("m"))
    frame = W.partitionBy("frame")
    up = counts.withColumns({"upto": F.sum("m").over(frame.orderBy("v").rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("m").over(frame)})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    half = (F.col("n") - 1) / 2
    g = up.groupBy("frame").agg(((at(F.floor(half)) + at(F.ceil(half))) / 2.0).alias("median"), at(F.floor((F.col("n") - 1) * F.lit(PEAK_PERCENTILE))).alias("peak"))
    g = g.withColumn("usable", (F.col("peak") < MOST_PEAK * white) & (F.col("median") > LEAST_LEVEL * white))
    typical = g.where("usable").agg(A.upper_median(F.array_sort(F.collect_list("median"))).alias("typical"))  # one value a frame
    g = g.crossJoin(F.broadcast(typical))
    kept = F.col("usable") & (F.abs(F.col("median") - F.col("typical")) <= LEVEL_BAND * F.col("typical"))
    return g.select("frame", "median", "peak", F.coalesce(kept, F.lit(False)).alias("kept"))


def build_flat(samples: DataFrame, judged: DataFrame) -> DataFrame:
    """x, y, v: medians over the kept frames; no rows with fewer than five of them."""
    kept = judged.where("kept").select("frame")
    enough = kept.agg((F.count("*") >= LEAST_FLATS).alias("enough"))
    some = samples.join(F.broadcast(kept), "frame", "left_semi").groupBy("x", "y").agg(F.median("v").alias("v"))  # as many rows as flats
    return some.crossJoin(F.broadcast(enough)).where("enough").drop("enough")


def evenness(plane: DataFrame, width: int, height: int, patch: int) -> DataFrame:
    """One row: mean of the centre patch, of the four corners, their ratio and a verdict: UNKNOWN without samples in both or with a
    centre of zero."""
    cx, cy, h = width / 2.0, height / 2.0, patch / 2.0
    centre = (F.abs(F.col("x") + 0.5 - cx) <= h) & (F.abs(F.col("y") + 0.5 - cy) <= h)
    corner = ((F.col("x") < patch) | (F.col("x") >= width - patch)) & ((F.col("y") < patch) | (F.col("y") >= height - patch))
    r = plane.agg(F.avg(F.when(centre, F.col("v"))).alias("centre"), F.avg(F.when(corner, F.col("v"))).alias("corners"))
    ratio = F.try_divide("corners", "centre")
    return r.select("centre", "corners", ratio.alias("ratio"), F.when(ratio.isNull(), F.lit("UNKNOWN")).when(ratio < 0.25, F.lit("STEEP")).when(ratio > 1.05, F.lit("INVERTED")).otherwise(F.lit("EVEN")).alias("verdict"))


def join_flats(sessions: DataFrame, flats: DataFrame) -> DataFrame:
    """Every session (session, camera, width) with the flat of its camera (camera, flat, flat_width), if it fits, and a note if not."""
    j = sessions.join(flats, "camera", "left")
    note = F.when(F.col("flat").isNull(), F.lit("no flat")).when(F.col("flat_width") != F.col("width"), F.lit("wrong size"))
    return j.select("session", F.when(note.isNull(), F.col("flat")).alias("flat"), note.alias("note"))


def noise_level(plane: DataFrame, background: Column, width: int) -> DataFrame:
    """One row: the noise over every seventh pixel, from the upper median distance to the background."""
    some = plane.where((F.col("y") * width + F.col("x")) % NOISE_STRIDE == 0).select((-F.abs(F.col("v") - background)).alias("v_neg"))
    return some.agg(F.greatest(F.lit(LEAST_SIGMA), A.MAD_TO_SIGMA * -F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v_neg)")).alias("sigma"))


def surface(plane: DataFrame, tiles: DataFrame, tile: int, across: int, down: int) -> DataFrame:
    """plane with `background`, bilinear between tile centres and straight on beyond the outer ones. tiles: tx, ty, median: few
    rows, one for tile squared pixels. Every pixel stays; its background is null where one of its four tiles is missing."""
    def cell(c: str, n: int) -> tuple[Column, Column]:
        at = (F.col(c) + 0.5) / tile - 0.5
        low = F.greatest(F.lit(0), F.least(F.lit(max(n - 2, 0)), F.floor(at))).cast("int")
        return low, at - low

    x0, tx = cell("x", across)
    y0, ty = cell("y", down)
    p = plane.withColumns({"x0": x0, "fx": tx, "y0": y0, "fy": ty})
    for i in (0, 1):
        for j in (0, 1):
            t = tiles.select((F.col("tx") - i).cast("int").alias("x0"), (F.col("ty") - j).cast("int").alias("y0"), F.col("median").alias(f"m{i}{j}"))
            p = p.join(t, ["x0", "y0"], "left")
    top = F.col("m00") + (F.col("m10") - F.col("m00")) * F.col("fx")
    low = F.col("m01") + (F.col("m11") - F.col("m01")) * F.col("fx")
    return p.withColumn("background", top + (low - top) * F.col("fy")).select(*plane.columns, "background")


def repair(plane: DataFrame, hot: DataFrame) -> DataFrame:
    """plane with each hot pixel (x, y) replaced by the median of its neighbours of the same colour, two pixels away. Neighbours
    are read as they were, so the result does not depend on an order of repairs."""
    row, col = W.partitionBy("y").orderBy("x"), W.partitionBy("x").orderBy("y")
    near = lambda f, w, axis: F.when(F.abs(f(axis, 2).over(w) - F.col(axis)) == 2, f("v", 2).over(w))
    p = plane.withColumn("h", F.array(near(F.lag, row, "x"), near(F.lead, row, "x"))).withColumn("k", F.array(near(F.lag, col, "y"), near(F.lead, col, "y")))
    around = F.array_sort(F.filter(F.concat("h", "k"), lambda v: v.isNotNull() & ~F.isnan(v)))
    marks = hot.select("x", "y", F.lit(True).alias("hot"))
    fixed = F.when(F.col("hot") & (F.size(around) > 0), A.averaged_median(around)).otherwise(F.col("v"))
    return p.join(marks, ["x", "y"], "left").select("x", "y", fixed.alias("v"))
