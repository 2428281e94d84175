"""Per-pixel robust combination of samples: clipped means, medians, weighted means and their rejection figures.

Each takes a DataFrame with one row a sample and the names of its columns; a pixel's samples are gathered by one
shuffle on the pixel (as many as there are frames). Means and medians are array expressions; the rejection passes run on
Arrow batches of gathered pixels, all pixels with equally many samples as one matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.functions import arrays as A

#: Fixed values of the combination rules.
KAPPA, PASSES, LEAST_SAMPLES, LEAST_SURVIVORS = 3.0, 3, 5, 3


def clip_rows(x: np.ndarray, kappa: float = KAPPA, robust_seed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rejection passes for pixels (rows) with equally many samples, sorted: which samples survive, and for each pixel
    whether a pass was declined as it would leave too few, and whether there is no median deviation."""
    n = x.shape[1]
    middle = lambda v: (v[:, (n - 1) // 2] + v[:, n // 2]) / 2
    median = middle(x)
    dev = np.abs(x - median[:, None])
    mad = 1.4826 * middle(np.sort(dev, axis=1))
    if robust_seed:
        c, s = median.copy(), np.where(mad > 0, mad, 1.2533 * dev.mean(axis=1))
    else:
        c = x.mean(axis=1)
        s = np.sqrt(((x - c[:, None]) ** 2).sum(axis=1) / (n - 1))
    alive, floor, done = np.ones(x.shape, bool), np.zeros(len(x), bool), np.zeros(len(x), bool)
    for _ in range(PASSES):
        on = np.flatnonzero(~done)
        if not len(on):
            break
        y, reach = x[on], kappa * s[on]
        keep = alive[on] & (y >= (c[on] - reach)[:, None]) & (y <= (c[on] + reach)[:, None])
        k = keep.sum(axis=1)
        settled = (s[on] <= 0) | (k == alive[on].sum(axis=1))
        low = ~settled & (k < LEAST_SURVIVORS)
        floor[on[low]] = True
        done[on[settled | low]] = True
        go = ~(settled | low)
        on, keep, y, k = on[go], keep[go], y[go], k[go]
        alive[on] = keep
        c[on] = np.where(keep, y, 0.0).sum(axis=1) / k
        s[on] = np.sqrt((np.where(keep, y - c[on][:, None], 0.0) ** 2).sum(axis=1) / (k - 1))
    return alive, floor, mad <= 0


def _by_size(samples: pa.ListArray, body: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Calls body(rows, x, w) for the rows of each size from LEAST_SAMPLES up; gives all sizes."""
    flat = samples.flatten()
    x, w = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    size = np.diff(samples.offsets.to_numpy())
    at = np.concatenate([[0], np.cumsum(size)])
    for n in np.unique(size):
        if n >= LEAST_SAMPLES:
            rows = np.flatnonzero(size == n)
            cells = at[rows][:, None] + np.arange(n)
            body(rows, x[cells], w[cells])
    return size


def _clip_batches(kappa: float, robust_seed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the last column, samples, by value and survivors (null below LEAST_SAMPLES), floor and flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            value, kept, floor, flat = np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)

            def fold(rows: np.ndarray, x: np.ndarray, w: np.ndarray) -> None:
                alive, floor[rows], flat[rows] = clip_rows(x, kappa, robust_seed)
                kept[rows] = alive.sum(axis=1)
                total = np.where(alive, w, 0.0).sum(axis=1)
                weighted = np.where(alive, w * x, 0.0).sum(axis=1) / np.where(total > 0, total, 1.0)
                value[rows] = np.where(total > 0, weighted, np.where(alive, x, 0.0).sum(axis=1) / kept[rows])

            size = _by_size(batch.column(batch.num_columns - 1), fold)
            few = size < LEAST_SAMPLES
            columns = [pa.array(value, mask=few), pa.array(kept, mask=few), pa.array(floor), pa.array(flat)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "value", "survivors", "floor", "flat"])

    return run


def _clipped(gathered: DataFrame, by: list[str], kappa: float, robust_seed: bool) -> DataFrame:
    """by, n, low (the median of fewer samples than are clipped), value, survivors, floor, flat. Keys go through under numbers, so
    that none can clash."""
    keys = [f"k{i}" for i in range(len(by))]
    n, xs = F.size("samples"), F.transform("samples", lambda e: e["x"])
    plain = gathered.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], n.alias("n"), F.when(n < LEAST_SAMPLES, A.averaged_median(xs)).alias("low"), "samples")
    head = plain.drop("samples").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head) + ", value double, survivors long, floor boolean, flat boolean"
    out = plain.mapInArrow(_clip_batches(kappa, robust_seed), schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", "low", "value", "survivors", "floor", "flat")


def _weighted(entries: Column) -> Column:
    """Weighted mean of struct(x, w): plain where no weight differs from 1 or the weights do not sum above 0."""
    wsum = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["w"])
    wx = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["w"] * e["x"])
    return F.when(wsum > 0, wx / wsum).otherwise(A.mean(F.transform(entries, lambda e: e["x"])))


def gather(df: DataFrame, by: list[str], sample: Column, weight: Column | None = None) -> DataFrame:
    """by, samples: array of struct(x, w) sorted by x then w; null and NaN samples go, a missing weight is 1. A pixel that no
    frame covers keeps its row, with no samples."""
    x = sample.cast("double")
    w = F.coalesce(weight.cast("double"), F.lit(1.0)) if weight is not None else F.lit(1.0)
    some = df.select(*by, F.struct(x.alias("x"), w.alias("w")).alias("sample of it"))  # a name that no key has
    x = F.col("`sample of it`.x")
    good = F.when(x.isNotNull() & ~F.isnan(x), F.col("`sample of it`"))
    return some.groupBy(*by).agg(F.array_sort(F.collect_list(good)).alias("samples"))


def combine(df: DataFrame, by: list[str], sample: Column, weight: Column | None = None, method: str = "sigma_clip", kappa: float = KAPPA) -> DataFrame:
    """by, n, value, survivors of every pixel (value NaN where n is 0). Methods: sigma_clip, kappa_sigma, median, mean."""
    g = gather(df, by, sample, weight)
    xs = F.transform("samples", lambda e: e["x"])
    n = F.size("samples")
    if method == "median":
        out = g.select(*by, n.alias("n"), A.averaged_median(xs).alias("value"), n.alias("survivors"))
    elif method == "mean":
        out = g.select(*by, n.alias("n"), _weighted(F.col("samples")).alias("value"), n.alias("survivors"))
    else:
        r = _clipped(g, by, kappa, method == "sigma_clip")
        out = r.select(*by, "n", F.coalesce("value", "low").alias("value"), F.coalesce("survivors", "n").alias("survivors"))
    return out.select(*by, F.col("n").cast("long").alias("n"), F.coalesce("value", F.lit(float("nan"))).alias("value"), F.col("survivors").cast("long").alias("survivors"))


def rejection_stats(df: DataFrame, by: list[str], sample: Column, kappa: float = KAPPA) -> DataFrame:
    """One row: pixels (uncovered ones too), samples, rejected, uncovered (no sample), below_floor (too few to clip), floor_hit (a
    pass declined as it would leave too few), degenerate_spread (no median deviation). Partial sums merge."""
    g = _clipped(gather(df, by, sample), by, kappa, True)
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return g.agg(
        F.count("*").alias("pixels"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("samples"),
        F.coalesce(F.sum(F.when(F.col("n") >= LEAST_SAMPLES, F.col("n") - F.col("survivors"))), F.lit(0)).cast("long").alias("rejected"),
        one(F.col("n") == 0).alias("uncovered"), one((F.col("n") > 0) & (F.col("n") < LEAST_SAMPLES)).alias("below_floor"),
        one(F.col("floor")).alias("floor_hit"), one(F.col("flat")).alias("degenerate_spread"),
    )


def spread_stats(df: DataFrame, by: list[str], sample: Column) -> DataFrame:
    """by, n, median, upper_median, mad_sigma, mean_dev_sigma, sd of every group."""
    g = gather(df, by, sample).select(*by, F.transform("samples", lambda e: e["x"]).alias("xs"))
    g = g.withColumns({"m": A.averaged_median(F.col("xs")), "mu": A.mean(F.col("xs"))})
    x, m = F.col("xs"), F.col("m")
    return g.select(
        *by, F.size("xs").cast("long").alias("n"), m.alias("median"), A.upper_median(x).alias("upper_median"),
        A.mad_sigma(x, m).alias("mad_sigma"), A.mean_deviation_sigma(x, m).alias("mean_dev_sigma"), A.sample_sd(x, F.col("mu")).alias("sd"),
    )


def index_percentiles(df: DataFrame, by: list[str], sample: Column, points: dict[str, float]) -> DataFrame:
    g = gather(df, by, sample).select(*by, F.transform("samples", lambda e: e["x"]).alias("xs"))
    return g.select(*by, *[A.index_percentile(F.col("xs"), p).alias(name) for name, p in points.items()])


def master_stats(df: DataFrame, value: str) -> DataFrame:
    """One row: minimum, mean and maximum of finite pixels, and how many are uncovered (null or NaN)."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return df.agg(F.min(v).alias("min_value"), F.avg(v).alias("mean_value"), F.max(v).alias("max_value"), F.sum(F.when(v.isNull(), 1).otherwise(0)).cast("long").alias("uncovered"))


def coverage(df: DataFrame, by: list[str], sample: Column) -> DataFrame:
    """by, n_covering: finite samples of each pixel."""
    good = sample.isNotNull() & ~F.isnan(sample)
    return df.groupBy(*by).agg(F.count(F.when(good, 1)).alias("n_covering"))
