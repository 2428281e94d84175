"""From a stacked master to a picture: levels of the channels, the stretch, colour and sharpening; coverage of the master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightloom.operators import planes as P

#: Fixed values of the picture's rules.
STRENGTH, LEAST_BACKGROUND, MOST_BACKGROUND, MOST_SATURATION = 0.55, 0.08, 0.35, 0.6
SKY, HIGHLIGHT, WHITE, STRIDE = 0.30, 0.9995, 0.99995, 17
LEAST_GAIN, MOST_GAIN = 0.25, 4.0
LUMA = {"r": 0.2126, "g": 0.7152, "b": 0.0722}
AMOUNT, RADIUS = 0.6, 2


def _at(column: str, p: float, n: int) -> Column:
    """The element at the truncated index (n - 1) p of n sorted values, as an aggregate whose partial results merge."""
    return F.expr(f"percentile_disc({(int((n - 1) * p) + 0.5) / n}) WITHIN GROUP (ORDER BY {column})")


def auto_edit(master: DataFrame, width: int, height: int, strength: float = STRENGTH) -> DataFrame:
    """x, y, r8, g8, b8 of a whole master (x, y, r, g, b; missing values count as 0 where levels are measured): the channels' skies are
    brought to one level and their ranges to one gain, one stretch measured on their mean is applied to all, and colours
    are strengthened. Levels are taken from every 17th pixel, white from every 17th sample of all channels in turn."""
    place = F.col("y") * width + F.col("x")
    finite = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.col(c))
    n = -(-width * height // STRIDE)
    some = master.where(place % STRIDE == 0).select(*[finite(c).alias(c) for c in "rgb"])
    levels = some.agg(*[_at(c, p, n).alias(f"{name}_{c}") for c in "rgb" for name, p in (("sky", SKY), ("high", HIGHLIGHT))])  # one row
    base = sum((F.col(f"sky_{c}") for c in "rgb"), F.lit(0.0)) / 3
    span = {c: F.col(f"high_{c}") - F.col(f"sky_{c}") for c in "rgb"}
    whole = (span["r"] > 0) & (span["g"] > 0) & (span["b"] > 0)
    gain = {c: F.when(whole, F.least(F.lit(MOST_GAIN), F.greatest(F.lit(LEAST_GAIN), (span["r"] + span["g"] + span["b"]) / 3 / span[c]))).otherwise(F.lit(1.0)) for c in "rgb"}
    levels = levels.select(base.alias("base"), *[F.col(f"sky_{c}") for c in "rgb"], *[gain[c].alias(f"gain_{c}") for c in "rgb"])
    even = master.crossJoin(F.broadcast(levels))
    even = even.select("x", "y", *[(F.col("base") + (F.col(c) + (F.col("base") - F.col(f"sky_{c}")) - F.col("base")) * F.col(f"gain_{c}")).alias(c) for c in "rgb"])
    total = 3 * width * height
    each = F.explode(F.array(*[F.struct((place * 3 + k).alias("at"), finite(c).alias("v")) for k, c in enumerate("rgb")]))
    white = even.select(each.alias("e")).where(F.col("e.at") % STRIDE == 0).select(F.col("e.v").alias("v")).agg(F.greatest(_at("v", WHITE, -(-total // STRIDE)), F.lit(1.0)).alias("white"))
    even = even.withColumn("v", (F.col("r") + F.col("g") + F.col("b")) / 3).crossJoin(F.broadcast(white))
    target = LEAST_BACKGROUND + strength * (MOST_BACKGROUND - LEAST_BACKGROUND)
    stretch = P.stretch_of(even.select((F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") / F.col("white")))).alias("n")), target=target)
    even = even.crossJoin(F.broadcast(stretch))
    grey = {c: P.stretched(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col("white"))), F.col("shadows"), F.col("midtone")) for c in "rgb"}
    even = even.select("x", "y", *[grey[c].alias(c) for c in "rgb"])
    luma = sum((F.lit(k) * F.col(c) for c, k in LUMA.items()), F.lit(0.0))
    boost = 1.0 + strength * MOST_SATURATION
    eight = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255.0 + 0.5).cast("int")
    return even.withColumn("luma", luma).select("x", "y", *[eight(F.col("luma") + (F.col(c) - F.col("luma")) * boost).alias(f"{c}8") for c in "rgb"])


def _box(df: DataFrame, along: str, across: str, value: str, radius: int, name: str) -> DataFrame:
    """Whole-number mean of the 2 radius + 1 values along a line; beyond the ends the end values stand."""
    line = W.partitionBy(across).orderBy(along)
    near, whole = line.rowsBetween(-radius, radius), line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place, n = F.row_number().over(line) - 1, F.count("*").over(whole)
    before, after = F.greatest(radius - place, F.lit(0)), F.greatest(place + radius - (n - 1), F.lit(0))
    total = F.sum(value).over(near) + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return df.withColumn(name, F.floor(total / (2 * radius + 1)).cast("int"))


def unsharp(picture: DataFrame, amount: float = AMOUNT, radius: int = RADIUS) -> DataFrame:
    """picture (x, y, v: whole planes of 0 to 255) with `sharp`: v plus amount times its distance from a box blur, rows first."""
    p = _box(_box(picture, "x", "y", "v", radius, "_row"), "y", "x", "_row", radius, "_blur")
    sharp = F.floor(F.col("v") + amount * (F.col("v") - F.col("_blur")) + 0.5)
    return p.withColumn("sharp", F.greatest(F.lit(0), F.least(F.lit(255), sharp)).cast("int")).drop("_row", "_blur")


def coverage_report(coverage: DataFrame, width: int, height: int, frames: int) -> DataFrame:
    """One row on a master's coverage (x, y, n; pixels without a row saw none): full, short, zero, least, interior (short pixels that
    are in no run from the left or right edge), the median and worst inset of each edge, and what the worst inset looks
    like against the thickest median: BAND below twice it, SPUR above, INTERIOR without any edge band. Lines are
    summed up one by one, so only lines (width and height) meet in one task."""
    seen = coverage.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    good = seen.where(F.col("n") >= frames)
    whole = seen.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("none"), F.min("n").alias("least"))
    spark = coverage.sparkSession

    def insets(line: str, along: str, lines: int, size: int, first: str, last: str) -> DataFrame:
        got = good.groupBy(line).agg(F.min(along).alias("lo"), F.max(along).alias("hi"), F.count("*").alias("full"))
        every = spark.range(lines).withColumnRenamed("id", line).join(got, line, "left")
        every = every.select(F.coalesce("lo", F.lit(size)).alias("a"), F.coalesce(size - 1 - F.col("hi"), F.lit(0)).alias("b"), F.coalesce("full", F.lit(0)).alias("full"), F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("full"), F.lit(0)).alias("inside"))
        upper = lambda c: (-F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{c})")).cast("long")
        return every.agg(upper("a").alias(f"{first}_median"), F.max("a").alias(f"{first}_worst"), upper("b").alias(f"{last}_median"), F.max("b").alias(f"{last}_worst"), F.sum("full").alias(f"full_{line}"), F.sum("inside").alias(f"interior_{line}"))

    one = whole.crossJoin(F.broadcast(insets("y", "x", height, width, "left", "right"))).crossJoin(F.broadcast(insets("x", "y", width, height, "top", "bottom")))
    edges = ("left", "right", "top", "bottom")
    ratio = F.greatest(*[F.col(f"{e}_worst") for e in edges]) / F.nullif(F.greatest(*[F.col(f"{e}_median") for e in edges]), F.lit(0))
    pixels = F.lit(width * height)
    return one.select(
        F.col("full_y").alias("full"), (pixels - F.col("full_y")).alias("short"), (pixels - F.col("rows") + F.coalesce("none", F.lit(0))).alias("zero"),
        F.when(F.col("rows") < pixels, F.lit(0)).otherwise(F.col("least")).cast("long").alias("least"), F.col("interior_y").alias("interior"),
        *[F.col(f"{e}_{k}").cast("long").alias(f"{e}_{k}") for e in edges for k in ("median", "worst")],
        F.when(F.col("full_y") == pixels, F.lit("FULL")).when(ratio.isNull(), F.lit("INTERIOR")).when(ratio < 2.0, F.lit("BAND")).otherwise(F.lit("SPUR")).alias("shape"),
    )


def worst_lines(coverage: DataFrame, line: str, lines: int, size: int, frames: int, k: int = 5) -> DataFrame:
    """line, short: the k rows (or columns) with most pixels that not all frames saw; those without any left out."""
    full = coverage.where(F.col("n") >= frames).groupBy(line).agg(F.count("*").alias("full"))
    every = coverage.sparkSession.range(lines).withColumnRenamed("id", line).join(full, line, "left")
    return every.select(F.col(line).alias("line"), (size - F.coalesce("full", F.lit(0))).cast("long").alias("short")).where("short > 0").orderBy(F.desc("short"), "line").limit(k)
