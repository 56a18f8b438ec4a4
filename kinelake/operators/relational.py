"""Joins, upserts, differences, de-duplication and ranking over keyed tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Spans that are narrower share a level.
LEAST_SPAN = 2.0**-10


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df with a broadcast hint if it has few rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_defaults(left: DataFrame, right: DataFrame, on: list[str], defaults: dict[str, str]) -> DataFrame:
    """Left join whose missing right columns take defaults."""
    return left.join(right, on, "left").fillna(defaults)


def flagged(left: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """left with a boolean column: whether its key is in keys."""
    return left.join(keys.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def replaced(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows of old whose key is not in new, and all rows of new."""
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, on: list[str], keep: list[str] = ()) -> DataFrame:
    """Matched keys take new's values but for the columns of keep; others stay.

    Both sides have one row per key.
    """
    rest = [c for c in old.columns if c not in on]
    a = old.select(*on, *[F.col(c).alias(f"_o_{c}") for c in rest])
    b = new.select(*on, *[F.col(c).alias(f"_n_{c}") for c in rest])
    pick = lambda c: F.coalesce(f"_o_{c}", f"_n_{c}") if c in keep else F.coalesce(f"_n_{c}", f"_o_{c}")
    return a.join(b, on, "full_outer").select(*on, *[pick(c).alias(c) for c in rest])


def dangling(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    return child.join(parent, on, "left_anti")


def changes(before: DataFrame, after: DataFrame, on: list[str], compare: list[str]) -> DataFrame:
    """Keys with their change: added, gone, changed or unchanged."""
    a = before.select(*on, *[F.col(c).alias(f"_a_{c}") for c in compare], F.lit(1).alias("_a"))
    b = after.select(*on, *[F.col(c).alias(f"_b_{c}") for c in compare], F.lit(1).alias("_b"))
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "gone").when(same, "unchanged").otherwise("changed")
    return a.join(b, on, "full_outer").select(*on, change.alias("change"))


def first_per_key(df: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*on).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, on: list[str], order: list[Column], n: int) -> DataFrame:
    """Up to n rows per key, numbered by `rank`."""
    w = Window.partitionBy(*on).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def consecutive_pairs(df: DataFrame, on: list[str], order: str, value: list[str]) -> DataFrame:
    """Each row with the one after it in its group: columns a_* and b_*."""
    w = Window.partitionBy(*on).orderBy(order)
    cols = [order, *value]
    return df.select(*on, *[F.col(c).alias(f"a_{c}") for c in cols], *[F.lead(c).over(w).alias(f"b_{c}") for c in cols]).filter(F.col(f"b_{order}").isNotNull())


def first_and_last(df: DataFrame, on: list[str], order: str, value: list[str], least: int = 3) -> DataFrame:
    """First and last row of groups of `least` rows or more, as one pair."""
    cols = [order, *value]
    agg = [F.min_by(c, order).alias(f"a_{c}") for c in cols] + [F.max_by(c, order).alias(f"b_{c}") for c in cols]
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *agg).filter(F.col("_n") >= least).drop("_n")


def in_first_span(points: DataFrame, spans: DataFrame, on: list[str], point: str, low: str, high: str) -> DataFrame:
    """Each point with the first span (by low) of its group that holds it, or nulls.

    A span lies in the one or two cells of its level, which are as wide as the next power
    of two of its width, so a long span makes no more rows than a short one; a point is
    asked at each level that its group has.  Repeated points stay; spans that end before
    they start hold nothing.
    """
    real = spans.filter(F.col(low) <= F.col(high))
    width = F.col(high).cast("double") - F.col(low).cast("double")
    real = real.withColumn("_level", F.when(width > LEAST_SPAN, F.ceil(F.log2(width))).otherwise(F.lit(int(math.log2(LEAST_SPAN)))).cast("int"))
    cell = lambda c: F.floor(F.col(c).cast("double") / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    asked = points.select(*on, point).distinct().join(real.select(*on, "_level").distinct(), on).withColumn("_cell", cell(point))
    covered = real.select(*on, low, high, "_level", F.explode(F.array_distinct(F.array(cell(low), cell(high)))).alias("_cell"))
    hit = asked.join(covered, [*on, "_level", "_cell"]).filter(F.col(point).between(F.col(low), F.col(high)))
    first = hit.groupBy(*on, point).agg(F.min(low).alias(low), F.min_by(high, low).alias(high))
    return points.join(first, [*on, point], "left")


def within_tolerance(a: DataFrame, b: DataFrame, on: list[str], pairs: list[tuple[str, str]], most: float) -> DataFrame:
    """Pairs of rows of a group whose listed columns differ by less than `most`.

    The first pair is dealt to cells of width `most`: only neighbours meet.
    """
    x, y = pairs[0]
    cell = lambda c: F.floor(F.col(c) / F.lit(float(most))).cast("long")
    left = a.withColumn("_cell", cell(x))
    right = b.withColumn("_cell", F.explode(F.array(cell(y) - 1, cell(y), cell(y) + 1)))
    near = left.join(right, [*on, "_cell"]).drop("_cell")
    for p, q in pairs:
        near = near.filter(F.abs(F.col(p) - F.col(q)) < most)
    return near


def keep_first_union(*parts: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of all parts, the first one of each key in order of the parts."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return first_per_key(out, [key], [F.col("_part"), F.col(order)]).drop("_part")


def cover_by_priority(rows: DataFrame, key: str, values: list[str], name: str) -> DataFrame:
    """The first value that is not null of an ordered list of columns, per row."""
    return rows.withColumn(name, F.coalesce(*values))


def two_way_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a not in b and rows of b not in a, as bags, with their side."""
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


def vote(votes: DataFrame, key: str, label: str, score: str, rank: str, agree: int = 2, floor: float = 0.86) -> DataFrame:
    """Fusion of labels per key: `agree` equal votes win with at least `floor`,
    else the label of the most reliable voter (lowest rank); null labels abstain."""
    by_label = votes.filter(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("_n"), F.max(score).alias("_s"), F.min(rank).alias("_r"))
    w = Window.partitionBy(key).orderBy(F.when(F.col("_n") >= agree, -F.col("_n")).otherwise(0), "_r", label)
    best = by_label.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return best.select(key, F.col(label).alias("label"), F.when(F.col("_n") >= agree, F.greatest(F.col("_s"), F.lit(floor))).otherwise(F.col("_s")).alias("confidence"), (F.col("_n") >= agree).alias("agreed"))


def borda(rankings: DataFrame, voter: str, item: str, place: str, top: int) -> DataFrame:
    """Points top - place over voters; ties by first places, then name."""
    points = rankings.filter(F.col(place) < top).groupBy(item).agg(F.sum(F.lit(top) - F.col(place)).alias("points"), F.count_if(F.col(place) == 0).alias("firsts"))
    return points.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("points"), F.desc("firsts"), item)))
