"""Planes of pixels, one row a pixel (x, y, v): calibration, backgrounds, stretches, coverage, discs and layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightloom.functions import arrays as A

#: Fixed values of the pixel rules.
LEAST_GAIN, HOT_SIGMA, LEAST_NOISE = 0.05, 8.0, 0.5
SHADOWS_CLIP, TARGET_BACKGROUND, LEAST_MIDTONE = -2.8, 0.25, 1e-4
DISC_THRESHOLD, DISC_PERCENTILE, DISC_AREA, DISC_SIGMA = 0.25, 0.10, 12, 8.0
FEATHER, LEAST_FEATHER = 0.12, 1.5
GRADIENT_PERCENTILE, GRADIENT_DEGREE, GRADIENT_PASSES, GRADIENT_SIGMA = 0.25, 4, 2, 2.5


def _upper(df: DataFrame, by: list[str], v: Column, name: str) -> DataFrame:
    """The element at n/2 as an aggregate: the lower median of the negated values. It keeps counts of distinct values, of
    which a sensor has at most 65,536, and merges partial results."""
    d = df.select(*by, (-v).alias("v_neg"))
    return d.groupBy(*by).agg((-F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v_neg)")).alias(name))


def calibrate(light: Column, dark: Column, flat: Column, black: Column) -> Column:
    """light less its dark (or the black level where there is no dark), over the flat; null where the flat is too weak."""
    signal = light - F.coalesce(dark, black)
    return F.when(flat.isNull(), signal).when(flat > LEAST_GAIN, signal / flat)


def normalise_flat(flat: DataFrame, value: str = "v") -> DataFrame:
    """flat with `gain`: value over the mean of positive values (1 where there is none). The mean is one row."""
    mean = flat.agg(F.avg(F.when(F.col(value) > 0, F.col(value))).alias("mean"))
    return flat.crossJoin(F.broadcast(mean)).withColumn("gain", F.when(F.col("mean").isNull(), F.lit(1.0)).otherwise(F.col(value) / F.col("mean"))).drop("mean")


def hot_pixels(dark: DataFrame, sigma: float = HOT_SIGMA) -> DataFrame:
    """Pixels of a dark above its upper median by sigma times the spread (upper median deviation, never under half a unit)."""
    m = _upper(dark, [], F.col("v"), "m")
    d = dark.crossJoin(F.broadcast(m))
    s = _upper(d, [], F.abs(F.col("v") - F.col("m")), "mad")
    return d.crossJoin(F.broadcast(s)).where(F.col("v") > F.col("m") + sigma * F.greatest(A.MAD_TO_SIGMA * F.col("mad"), F.lit(LEAST_NOISE))).select("x", "y", "v")


def green_bins(mosaic: DataFrame, factor: int, cfa: tuple[int, int, int, int] = (1, 0, 2, 1)) -> DataFrame:
    """x, y, v: means of the green samples of each factor-by-factor bin; cfa: colour codes of a 2x2 cell, 1 being green."""
    site = (F.col("y") % 2) * 2 + F.col("x") % 2
    green = mosaic.where(site.isin([i for i, c in enumerate(cfa) if c == 1]))
    return green.groupBy(F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y")).agg(F.avg("v").alias("v"))


def tile_medians(plane: DataFrame, tile: int = 64) -> DataFrame:
    """tx, ty, median (averaged) of every tile."""
    return plane.groupBy(F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(F.median("v").alias("median"))


def background_level(plane: DataFrame, tile: int = 64) -> DataFrame:
    """One row: tiles, level (the upper median of the tiles' medians)."""
    t = tile_medians(plane, tile).select((-F.col("median")).alias("v_neg"))
    return t.agg(F.count("*").alias("tiles"), (-F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v_neg)")).alias("level"))


def tile_percentiles(plane: DataFrame, tile: int, p: float = GRADIENT_PERCENTILE) -> DataFrame:
    """tx, ty, n, v: a truncating index percentile of every tile (a tile has tile squared pixels)."""
    g = plane.groupBy(F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(F.array_sort(F.collect_list("v")).alias("s"))
    return g.select("tx", "ty", F.size("s").cast("long").alias("n"), A.index_percentile(F.col("s"), p).alias("v"))


def coverage_rows(plane: DataFrame, width: int) -> DataFrame:
    """y, covered, left_inset, right_inset, holes, longest_hole of rows of a plane whose rows are the covered pixels."""
    p = plane.select("y", "x").distinct()
    before = F.lag("x").over(W.partitionBy("y").orderBy("x"))
    gap = F.coalesce(F.col("x") - F.col("before") - 1, F.lit(0))
    return p.withColumn("before", before).withColumn("gap", gap).groupBy("y").agg(
        F.count("*").alias("covered"), F.min("x").alias("left_inset"), (F.lit(width - 1) - F.max("x")).alias("right_inset"),
        F.sum("gap").alias("holes"), F.max("gap").alias("longest_hole"),
    )


def worst_rows(rows: DataFrame, width: int, k: int = 5) -> DataFrame:
    """The k rows with most uncovered pixels, those without any left out; ties by y."""
    return rows.withColumn("uncovered", F.lit(width) - F.col("covered")).where("uncovered > 0").orderBy(F.desc("uncovered"), "y").limit(k).select("y", "uncovered")


def mtf(m: Column, x: Column) -> Column:
    """Midtones transfer: 0 to 0, 1 to 1, m to a half."""
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(m <= 0, F.lit(1.0)).when(m >= 1, F.lit(0.0)).otherwise((m - 1.0) * x / ((2.0 * m - 1.0) * x - m))


def stretch_of(levels: DataFrame, clip: float = SHADOWS_CLIP, target: float = TARGET_BACKGROUND) -> DataFrame:
    """One row: shadows and midtone of a stretch, from the upper median and deviation of levels (n, 0 to 1)."""
    m = _upper(levels, [], F.col("n"), "m")
    d = levels.crossJoin(F.broadcast(m))
    d = _upper(d, [], F.abs(F.col("n") - F.col("m")), "mad").crossJoin(F.broadcast(m))
    s = A.MAD_TO_SIGMA * F.col("mad")
    d = d.withColumn("shadows", F.when(s > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m") + clip * s))).otherwise(F.lit(0.0)))
    mid = F.greatest(F.lit(LEAST_MIDTONE), F.least(F.lit(1 - LEAST_MIDTONE), mtf(F.lit(target), (F.col("m") - F.col("shadows")) / (1.0 - F.col("shadows")))))
    return d.select("shadows", F.when((F.col("mad") > 0) & (F.col("m") > F.col("shadows")), mid).otherwise(F.lit(0.5)).alias("midtone"))


def stretched(n: Column, shadows: Column, midtone: Column) -> Column:
    return F.when(n <= shadows, F.lit(0.0)).otherwise(mtf(midtone, (n - shadows) / (1.0 - shadows)))


def autostretch(plane: DataFrame, black: float, white: float, clip: float = SHADOWS_CLIP, target: float = TARGET_BACKGROUND) -> DataFrame:
    """plane with `stretched` (0 to 1) and `grey` (0 to 255)."""
    n = plane.withColumn("n", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - black) / (white - black))))
    d = n.crossJoin(F.broadcast(stretch_of(n.select("n"), clip, target)))
    d = d.withColumn("stretched", stretched(F.col("n"), F.col("shadows"), F.col("midtone")))
    return d.withColumn("grey", F.floor(F.col("stretched") * 255.0 + 0.5).cast("int")).drop("n", "shadows", "midtone")


#: Fixed values of the preview: every so-manieth pixel is measured, shadows lie so many deviations below the sky, which goes to the target.
PREVIEW_STRIDE, PREVIEW_SIGMAS, PREVIEW_TARGET = 16, 2.0, 0.25


def preview_stretch(plane: DataFrame, width: int, sigmas: float = PREVIEW_SIGMAS, target: float = PREVIEW_TARGET) -> DataFrame:
    """x, y, grey (0 to 255) of a running preview (x, y, v): sky and noise from every 16th pixel, the brightest pixel white. A plane
    without noise runs from its least to its greatest pixel."""
    some = plane.where((F.col("y") * width + F.col("x")) % PREVIEW_STRIDE == 0)
    m = _upper(some, [], F.col("v"), "m")
    mad = _upper(some.crossJoin(F.broadcast(m)), [], F.abs(F.col("v") - F.col("m")), "mad")
    s = plane.agg(F.max("v").alias("high"), F.min("v").alias("least")).crossJoin(m).crossJoin(mad)  # one row each
    sigma = A.MAD_TO_SIGMA * F.col("mad")
    s = s.withColumn("low", F.when(sigma > 1e-6, F.col("m") - sigmas * sigma).otherwise(F.col("least")))
    s = s.withColumn("span", F.when(F.col("high") - F.col("low") > 1e-6, F.col("high") - F.col("low")).otherwise(1.0))
    inside = lambda c: F.greatest(F.lit(LEAST_MIDTONE), F.least(F.lit(1 - LEAST_MIDTONE), c))
    s = s.withColumn("sky", inside((F.col("m") - F.col("low")) / F.col("span")))
    den = 2.0 * target * F.col("sky") - target - F.col("sky")
    s = s.withColumn("mid", F.when(F.abs(den) < 1e-9, 0.5).otherwise(inside(F.col("sky") * (target - 1.0) / den))).select("low", "span", "mid")
    n = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("low")) / F.col("span")))
    d = plane.crossJoin(F.broadcast(s)).withColumn("n", n)
    return d.select("x", "y", F.floor(mtf(F.col("mid"), F.col("n")) * 255.0 + 0.5).cast("int").alias("grey"))


def disc(plane: DataFrame, by: list[str]) -> DataFrame:
    """by, found, centroid_x, centroid_y, pixels, peak, background of the bright disc of each plane. A plane's background is an
    index percentile (rounded), its noise the upper median deviation; the disc is what lies above a quarter of the peak."""
    order = F.array_sort(F.collect_list("v"))
    g = plane.groupBy(*by).agg(order.alias("s"))
    med = A.rounded_percentile(F.col("s"), 0.5)
    g = g.select(*by, A.rounded_percentile(F.col("s"), DISC_PERCENTILE).alias("background"), F.array_max("s").alias("peak"),
                 A.let(med, lambda m: A.MAD_TO_SIGMA * A.upper_median(F.array_sort(F.transform("s", lambda v: F.abs(v - m))))).alias("sigma"))
    t = F.col("background") + DISC_THRESHOLD * (F.col("peak") - F.col("background"))
    p = plane.join(g.withColumn("t", t), by).where(F.col("v") >= F.col("t")).withColumn("w", F.col("v") - F.col("t"))
    r = p.groupBy(*by).agg(F.count("*").alias("pixels"), F.sum("w").alias("w"), F.sum(F.col("x") * F.col("w")).alias("wx"), F.sum(F.col("y") * F.col("w")).alias("wy"), F.first("peak").alias("peak"), F.first("background").alias("background"), F.first("sigma").alias("sigma"))
    found = (F.col("pixels") >= DISC_AREA) & (F.col("w") > 0) & (F.col("peak") > F.col("background")) & ((F.col("sigma") <= 0) | (F.col("peak") - F.col("background") >= DISC_SIGMA * F.col("sigma")))
    return r.select(*by, found.alias("found"), (F.col("wx") / F.col("w")).alias("centroid_x"), (F.col("wy") / F.col("w")).alias("centroid_y"), "pixels", "peak", "background")


def sharpness(plane: DataFrame) -> DataFrame:
    """One row: variance of the Laplacian over the inner pixels, over the variance of the plane. Neighbours come from windows over
    rows and over columns."""
    row, col = W.partitionBy("y").orderBy("x"), W.partitionBy("x").orderBy("y")
    p = plane.withColumns({"l": F.lag("v").over(row), "r": F.lead("v").over(row)})
    p = p.withColumns({"u": F.lag("v").over(col), "d": F.lead("v").over(col)})
    lap = F.col("l") + F.col("r") + F.col("u") + F.col("d") - 4.0 * F.col("v")
    s = p.withColumn("lap", lap).agg(F.var_pop("lap").alias("a"), F.var_pop("v").alias("b"), F.count("lap").alias("n"))
    return s.select("n", F.when((F.col("n") >= 2) & (F.col("b") > 0), F.col("a") / F.col("b")).otherwise(F.lit(0.0)).alias("sharpness"))


def composite(ground: DataFrame, moon: DataFrame, cx: float, cy: float, radius: float, shift_x: float, shift_y: float, scale: float = 1.0) -> DataFrame:
    """x, y, v: the moon's disc, shifted, over the ground, with a radial feather. Missing ground counts as 0 under the disc."""
    feather = max(LEAST_FEATHER, radius * FEATHER)
    d = F.hypot(F.col("x") - (cx + shift_x), F.col("y") - (cy + shift_y))
    alpha = F.when(d > radius + feather, F.lit(0.0)).when(d <= radius, F.lit(1.0)).otherwise(1.0 - (d - radius) / feather)
    whole = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")
    g = ground.withColumns({"alpha": alpha, "sx": whole(F.col("x") - shift_x), "sy": whole(F.col("y") - shift_y)})
    m = moon.select(F.col("x").cast("long").alias("sx"), F.col("y").cast("long").alias("sy"), F.col("v").alias("mv"))
    merged = g.join(m, ["sx", "sy"], "left")
    v = F.when((F.col("alpha") > 0) & F.col("mv").isNotNull(), F.coalesce("v", F.lit(0.0)) * (1.0 - F.col("alpha")) + F.col("mv") * scale * F.col("alpha")).otherwise(F.col("v"))
    return merged.select("x", "y", v.alias("v"), (F.col("alpha") > 0).alias("touched"))


def _monomials(degree: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]


def fit_gradient(tiles: DataFrame, width: float, height: float, degree: int = GRADIENT_DEGREE) -> np.ndarray:
    """Coefficients of the polynomial background through tiles (x, y, v in pixels): sums of monomials in Spark, a system of at
    most 15 equations here; passes that drop tiles far above the fit follow."""
    terms = _monomials(min(degree, GRADIENT_DEGREE))
    t = tiles.select((F.col("x") / width).alias("x"), (F.col("y") / height).alias("y"), "v")
    basis = [F.pow("x", F.lit(float(i))) * F.pow("y", F.lit(float(j))) for i, j in terms]
    some, found = t, np.zeros(len(terms))
    for k in range(GRADIENT_PASSES + 1):
        n = len(terms)
        sums = some.agg(*[F.sum(basis[a] * basis[b]).alias(f"a{a}_{b}") for a in range(n) for b in range(a, n)], *[F.sum(basis[a] * F.col("v")).alias(f"b{a}") for a in range(n)]).first()
        left, right = np.zeros((n, n)), np.zeros(n)
        for a in range(n):
            right[a] = sums[f"b{a}"] or 0.0
            for b in range(a, n):
                left[a, b] = left[b, a] = sums[f"a{a}_{b}"] or 0.0
        found = np.linalg.lstsq(left, right, rcond=None)[0]
        if k < GRADIENT_PASSES:
            fit = sum((F.lit(float(c)) * b for c, b in zip(found, basis, strict=True)), F.lit(0.0))
            t = t.withColumn("res", F.col("v") - fit)
            spread = some.withColumn("res", F.col("v") - fit).agg(F.stddev_samp("res")).first()[0] or 0.0
            some = t.where(F.col("res") <= GRADIENT_SIGMA * spread).drop("res") if spread > 0 else some
            t = t.drop("res")
    return found


def subtract_gradient(plane: DataFrame, coefficients: np.ndarray, width: float, height: float, degree: int = GRADIENT_DEGREE) -> DataFrame:
    """plane less the polynomial, its mean level kept."""
    x, y = F.col("x") / width, F.col("y") / height
    fit = sum((F.lit(float(c)) * F.pow(x, F.lit(float(i))) * F.pow(y, F.lit(float(j))) for c, (i, j) in zip(coefficients, _monomials(degree), strict=True)), F.lit(0.0))
    p = plane.withColumn("fit", fit)
    level = p.agg(F.avg("fit").alias("level"))
    return p.crossJoin(F.broadcast(level)).withColumn("v", F.col("v") - F.col("fit") + F.col("level")).drop("fit", "level")
