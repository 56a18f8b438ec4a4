"""Null-safe robust statistics.

NaN is turned into null at the border (`finite`), so aggregates skip it and
comparisons with it are neither true nor false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x) -> Column:
    """x as double; null if it can't be cast, is NaN or infinite."""
    v = F.col(x) if isinstance(x, str) else x
    v = v.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def clip01(x) -> Column:
    """x clipped to [0, 1]; a missing value counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(finite(x), F.lit(0.0))))


def pct(x, q: float) -> Column:
    """Linear percentile of the finite values, q in 0 .. 100; null if none."""
    return F.percentile(finite(x), F.lit(q / 100.0))


def med(x) -> Column:
    return pct(x, 50)


def mean(x) -> Column:
    return F.avg(finite(x))


def frac(x, threshold: float) -> Column:
    """Share of the finite values that are at least threshold."""
    return F.avg((finite(x) >= threshold).cast("double"))


def spread(x) -> Column:
    """95th less 5th percentile."""
    return pct(x, 95) - pct(x, 5)


def deviation(x) -> Column:
    """Population standard deviation of two or more finite values."""
    return F.when(F.count(finite(x)) >= 2, F.stddev_pop(finite(x)))


def coverage(x) -> Column:
    """Share of rows with a finite value."""
    return F.count(finite(x)) / F.count(F.lit(1))


def observed(valid) -> Column:
    return F.avg(valid.cast("double"))


def travel(x) -> Column:
    return F.max(finite(x)) - F.min(finite(x))


def half_up(x, decimals: int) -> Column:
    """Rounding for reports; everything else rounds half to even (`half_even`)."""
    return F.round(x, decimals)


def half_even(x, decimals: int) -> Column:
    return F.bround(x, decimals)


def index_quantile(values: Column, p: float) -> Column:
    """The value at place int(n * p) of a sorted array, the last one at most."""
    at = F.least(F.size(values) - 1, (F.size(values) * F.lit(p)).cast("int"))
    return F.element_at(values, at + 1)


def upper_median(values: Column) -> Column:
    """sorted[n // 2]."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def integer_median(values: Column) -> Column:
    """Middle value; the floored mean of the two middle ones for an even number."""
    s, n = F.array_sort(values), F.size(values)
    hi = F.element_at(s, (n / 2).cast("int") + 1)
    lo = F.element_at(s, F.greatest((n / 2).cast("int"), F.lit(1)))
    return F.when(n == 0, None).when(n % 2 == 1, hi).otherwise(F.floor((lo + hi) / 2))


def exceedance(value: Column, threshold: Column, comparison: Column) -> Column:
    """How far past its threshold a value lies, relative to the threshold."""
    over = F.when(comparison.isin("<", "<="), threshold - value).otherwise(value - threshold)
    return over / (F.abs(threshold) + 1e-6)


def fires(value: Column, comparison: Column, threshold: Column) -> Column:
    """A comparison named by a column; null stays null."""
    return F.when(comparison == "<", value < threshold).when(comparison == "<=", value <= threshold).when(comparison == ">", value > threshold).when(comparison == ">=", value >= threshold)


def split_of(key: Column) -> Column:
    """Deterministic split: the sha256 of the key modulo 5, 0 being the test part.

    16 is 1 modulo 5, so the remainder of the digest is that of its digit sum.
    """
    digits = F.split(F.sha2(key, 256), "")
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + F.when(d == "", 0).otherwise(F.conv(d, 16, 10).cast("int")))
    return F.when(total % 5 == 0, "test").otherwise("train")
