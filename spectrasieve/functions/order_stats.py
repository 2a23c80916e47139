"""Order statistics by rank rule, as expressions over arrays: no shuffle, no interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def at_rank(ordered: Column, numerator: int, denominator: int) -> Column:
    """The element at floor(n * numerator / denominator) of a sorted array, at most the last; null if empty."""
    n = F.size(ordered)
    k = F.least(F.floor(n * F.lit(numerator) / F.lit(denominator)), n - 1).cast("int")
    return F.when(n > 0, F.get(ordered, k))


def upper_median(values: Column) -> Column:
    """The element at n / 2 of the sorted array."""
    return once(F.array_sort(values), lambda s: at_rank(s, 1, 2))


def rough_noise(intensity: Column) -> Column:
    """struct(baseline, sigma): the tenth percentile, and the interquartile range over 1.349 with floors.

    Of the sorted values p10 = max(s[n / 10], 0), p25 = s[n / 4], p75 = s[3 n / 4];
    sigma is the largest of (p75 - p25) / 1.349, p10 / 10 and 1. An empty array gives (0, 1).
    """

    def of(s: Column) -> Column:
        p10 = F.greatest(at_rank(s, 1, 10), F.lit(0.0))
        sigma = F.greatest((at_rank(s, 3, 4) - at_rank(s, 1, 4)) / F.lit(1.349), p10 * 0.1, F.lit(1.0))
        return F.struct(F.when(F.size(s) > 0, p10).otherwise(0.0).alias("baseline"), F.when(F.size(s) > 0, sigma).otherwise(1.0).alias("sigma"))

    return once(F.array_sort(F.transform(F.coalesce(intensity, F.array().cast("array<float>")), lambda x: x.cast("double"))), of)


def gaps(axis: Column) -> Column:
    """Differences of neighbours."""
    n = F.size(axis)
    return F.when(n >= 2, F.zip_with(F.slice(axis, 2, n - 1), F.slice(axis, 1, n - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))


def grid_spacing(axis: Column) -> Column:
    """struct(spacing, spread, uneven): the upper median gap (0.125 below two points), (q90 - q10) / median, and whether that passes 0.1."""

    def of(d: Column) -> Column:
        median = F.coalesce(at_rank(d, 1, 2), F.lit(0.125))
        spread = F.coalesce((at_rank(d, 9, 10) - at_rank(d, 1, 10)) / median, F.lit(0.0))
        return F.struct(median.alias("spacing"), spread.alias("spread"), (spread > 0.1).alias("uneven"))

    return once(F.array_sort(gaps(axis)), of)
