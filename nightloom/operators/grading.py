"""Frames of a session: selection, overrides, quality scores and the best share of them.

A frames table has session, idx (capture order), kind (LIGHT or DARK), hfr, star_count, background, sharpness,
accepted and included, all metrics nullable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the scoring rules.
LEAST_WEIGHT, KEEP_PERCENT, LUNAR_KEEP_PERCENT = 0.01, 95, 20


def stackable(frames: DataFrame) -> DataFrame:
    """Lights that the user included or, without an override, the gate accepted."""
    return frames.where((F.col("kind") == "LIGHT") & F.coalesce("included", "accepted"))


def overridden(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("included").isNotNull() & (F.col("included") != F.col("accepted")))


def set_override(frames: DataFrame, wanted: Column) -> DataFrame:
    """The override of every light: none where the wish agrees with the gate; darks stay as they are."""
    wish = F.when(wanted != F.col("accepted"), wanted)
    return frames.withColumn("included", F.when(F.col("kind") == "LIGHT", wish).otherwise(F.col("included")))


def _term(best: Column, value: Column, ratio: Column) -> Column:
    good = best.isNotNull() & value.isNotNull() & (value > 0) & (value < F.lit(float("inf")))
    return F.when(good, F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(1.0), ratio))).otherwise(F.lit(1.0))


def frame_scores(frames: DataFrame, by: str = "session", lunar: bool = False) -> DataFrame:
    """frames with sharpness_term, transparency_term, darkness_term and weight, relative to the best of each group.

    The best values come from an aggregate that is joined back, so a long session is never gathered in one task."""
    positive = lambda c: F.when((F.col(c) > 0) & (F.col(c) < F.lit(float("inf"))), F.col(c))
    best = frames.groupBy(by).agg(
        F.min(positive("hfr")).alias("best_hfr"), F.max(positive("star_count")).cast("double").alias("best_stars"),
        F.min(positive("background")).alias("best_background"), F.max(positive("sharpness")).alias("best_sharpness"),
    )
    f = frames.join(best, by)
    if lunar:
        sharp = _term(F.col("best_sharpness"), F.col("sharpness"), F.col("sharpness") / F.col("best_sharpness"))
        terms = {"sharpness_term": sharp, "transparency_term": F.lit(1.0), "darkness_term": F.lit(1.0)}
    else:
        r = F.col("best_hfr") / F.col("hfr")
        terms = {
            "sharpness_term": _term(F.col("best_hfr"), F.col("hfr"), r * r),
            "transparency_term": _term(F.col("best_stars"), F.col("star_count").cast("double"), F.col("star_count") / F.col("best_stars")),
            "darkness_term": _term(F.col("best_background"), F.col("background"), F.col("best_background") / F.col("background")),
        }
    f = f.withColumns(terms)
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(1.0), F.col("sharpness_term") * F.col("transparency_term") * F.col("darkness_term")))
    return f.withColumn("weight", weight).drop("best_hfr", "best_stars", "best_background", "best_sharpness")


def keep_best(scored: DataFrame, percent: int = KEEP_PERCENT, by: str = "session") -> DataFrame:
    """The best share of each group's frames by weight, ties by capture order; at least one stays."""
    p = max(1, min(100, percent))
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("weight"), "idx"))
    n = F.count("*").over(W.partitionBy(by))
    return scored.withColumns({"rank": rank, "group_size": n}).where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("group_size") * F.lit(p) / 100.0))).drop("rank", "group_size")


def kept(frames: DataFrame, indexes: DataFrame) -> DataFrame:
    return frames.join(indexes, ["session", "idx"], "left_semi")


def dropped(frames: DataFrame, indexes: DataFrame) -> DataFrame:
    return frames.join(indexes, ["session", "idx"], "left_anti")


def with_weights(frames: DataFrame, scores: DataFrame) -> DataFrame:
    """frames with the weight of their score; a frame without one weighs 1."""
    return frames.join(scores.select("session", "idx", "weight"), ["session", "idx"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def session_medians(frames: DataFrame, by: str = "session") -> DataFrame:
    return frames.groupBy(by).agg(F.median("hfr").alias("median_hfr"), F.median("sharpness").alias("median_sharpness"), F.count("*").alias("n_frames"))


def integration_seconds(frames: DataFrame, exposure_ns: Column, by: str = "session") -> DataFrame:
    return frames.where("accepted").groupBy(by).agg((F.sum(exposure_ns) / F.lit(1e9)).alias("integration_seconds"))
