"""Array, map and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Column, names: list[str], missing: float = -50.0) -> Column:
    """A map as a vector in the order of names; missing and NaN become `missing`."""
    return F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.nanvl(F.element_at(values, n), F.lit(None).cast("double")), F.lit(missing)))


def resampled(values: Column, length: int) -> Column:
    """Linear resampling of an array of doubles to `length` points."""
    n = F.size(values)

    def at(i: Column) -> Column:
        x = i * (n - 1) / F.lit(max(length - 1, 1))
        lo = F.floor(x).cast("int")
        hi = F.least(lo + 1, n - 1)
        a, b = F.get(values, lo).cast("double"), F.get(values, hi).cast("double")
        return a + (b - a) * (x - lo)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, v: a + v))


def head_and_tail(values: Column, most: int, marker: Column) -> Column:
    """A list cut to `most`: the first quarter, a marker, and the end."""
    head = most // 4
    tail = most - head - 1
    return F.when(F.size(values) <= most, values).otherwise(F.concat(F.slice(values, 1, head), F.array(marker), F.slice(values, F.size(values) - tail + 1, tail)))


def spaced(values: Column, k: int) -> Column:
    """k evenly spaced elements, first and last among them."""
    n = F.size(values)
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(values, F.bround(i * (n - 1) / F.lit(max(k - 1, 1)), 0).cast("int")))
    return F.when(n <= k, values).otherwise(picks)
