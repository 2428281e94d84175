"""Array-valued building blocks: two kinds of median, index percentiles, spreads. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826
MEAN_DEVIATION_TO_SIGMA = 1.2533


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def upper_median(sorted_xs: Column) -> Column:
    """The element at n/2 (from 0) of a sorted array; null where it is empty."""
    return F.get(sorted_xs, F.floor(F.size(sorted_xs) / 2).cast("int"))


def averaged_median(sorted_xs: Column) -> Column:
    """The mean of the two middle elements of a sorted array."""
    n = F.size(sorted_xs)
    return (F.get(sorted_xs, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_xs, F.floor(n / 2).cast("int"))) / 2.0


def index_percentile(sorted_xs: Column, p: float) -> Column:
    """The element at the truncated index (n - 1) p; no interpolation."""
    return F.get(sorted_xs, F.floor((F.size(sorted_xs) - 1) * F.lit(p)).cast("int"))


def rounded_percentile(sorted_xs: Column, p: float) -> Column:
    """The element at the index (n - 1) p rounded half up."""
    return F.get(sorted_xs, F.floor((F.size(sorted_xs) - 1) * F.lit(p) + 0.5).cast("int"))


def mad_sigma(xs: Column, centre: Column) -> Column:
    return F.lit(MAD_TO_SIGMA) * averaged_median(F.array_sort(F.transform(xs, lambda x: F.abs(x - centre))))


def mean_deviation_sigma(xs: Column, centre: Column) -> Column:
    return F.lit(MEAN_DEVIATION_TO_SIGMA) * mean(F.transform(xs, lambda x: F.abs(x - centre)))


def sample_sd(xs: Column, centre: Column) -> Column:
    """Sample standard deviation about a centre; 0 for fewer than two values."""
    squares = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre))
    return F.when(F.size(xs) < 2, F.lit(0.0)).otherwise(F.sqrt(squares / (F.size(xs) - 1)))


def robust_sigma(xs: Column, centre: Column) -> Column:
    """The MAD's sigma, or the mean deviation's where that is 0."""
    return let(mad_sigma(xs, centre), lambda s: F.when(s > 0, s).otherwise(mean_deviation_sigma(xs, centre)))
