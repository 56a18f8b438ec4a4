"""Ordered operators: islands, streaks, differences, peaks, calendars, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, on: list[str], order: str, inside: Column, gap: int = 0) -> DataFrame:
    """Maximal runs of rows inside a condition; up to `gap` rows between are bridged.

    A row per run: first and last place (`order` must count 1, 2, ...) and length.
    """
    rows = df.filter(inside)
    w = Window.partitionBy(*on).orderBy(order)
    new = (F.col(order) - F.lag(order).over(w) > gap + 1).cast("int")
    rows = rows.withColumn("_id", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*on, "_id").agg(F.min(order).alias("first"), F.max(order).alias("last")).withColumn("length", F.col("last") - F.col("first") + 1).drop("_id")


def longest_island(runs: DataFrame, on: list[str]) -> DataFrame:
    """The longest run of each group, the first one of equals."""
    best = F.max_by(F.struct("first", "last", "length"), F.struct(F.col("length"), -F.col("first")))
    return runs.groupBy(*on).agg(best.alias("_b")).select(*on, "_b.first", "_b.last", "_b.length")


def numbered(df: DataFrame, on: list[str], order: list[str], name: str = "frame") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*on).orderBy(*order)))


def streaks(days: DataFrame, on: list[str], day: str) -> DataFrame:
    """Runs of consecutive dates: first and last day and length; days are distinct."""
    rows = days.select(*on, day).distinct()
    w = Window.partitionBy(*on).orderBy(day)
    rows = rows.withColumn("_id", F.date_sub(F.col(day), F.row_number().over(w)))
    return rows.groupBy(*on, "_id").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("length")).drop("_id")


def current_streak(runs: DataFrame, on: list[str], today: Column) -> DataFrame:
    """Length of the run that touches today or yesterday, 0 if there is none."""
    live = F.when(F.datediff(today, F.col("last")).between(0, 1), F.col("length")).otherwise(0)
    return runs.groupBy(*on).agg(F.max(live).alias("streak"))


def week_grid(days: DataFrame, on: list[str], day: str, value: str, anchor: Column) -> DataFrame:
    """The seven days, Monday first, of anchor's week, with the day's value or 0."""
    start = F.date_trunc("week", anchor.cast("timestamp")).cast("date")
    grid = days.select(*on).distinct().select(*on, F.explode(F.sequence(start, F.date_add(start, 6))).alias(day))
    return grid.join(days, [*on, day], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def steps(df: DataFrame, on: list[str], order: str, value: str, name: str = "step") -> DataFrame:
    """First differences in order; the first row of a group has none."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*on).orderBy(order)))


def local_maxima(df: DataFrame, on: list[str], order: str, value: str) -> DataFrame:
    """Rows strictly above both neighbours."""
    w = Window.partitionBy(*on).orderBy(order)
    return df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).filter((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b"))).drop("_a", "_b")


def stalled_fraction(df: DataFrame, on: list[str], order: str, value: str, rate: float = 0.25) -> DataFrame:
    """Share of steps slower than rate * mean step, inside 10 .. 90 % of the travel.

    Groups with fewer than 6 rows or without travel have null.
    """
    w = Window.partitionBy(*on)
    o = w.orderBy(order)
    rows = df.select(*on, F.col(value).alias("_v"), (F.lead(value).over(o) - F.col(value)).alias("_d"), F.first(value).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_f"), F.last(value).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_l"), F.count(F.lit(1)).over(w).alias("_n"))
    sign = F.signum(F.col("_l") - F.col("_f"))
    done = (F.col("_v") - F.col("_f")) / F.nullif(F.col("_l") - F.col("_f"), F.lit(0.0))
    rows = rows.withColumn("_s", F.col("_d") * sign).withColumn("_in", done.between(0.1, 0.9) & F.col("_d").isNotNull())
    mean = F.avg(F.when(F.col("_in"), F.col("_s"))).over(w)
    rows = rows.withColumn("_slow", F.when(F.col("_in"), (F.col("_s") < rate * mean).cast("double")))
    return rows.groupBy(*on).agg(F.when(F.max("_n") >= 6, F.avg("_slow")).alias("stalled"))


def evenness(df: DataFrame, on: list[str], order: str, value: str) -> DataFrame:
    """Mean absolute step over its 90th percentile, clipped to [0, 1]."""
    d = steps(df, on, order, value, "_d").withColumn("_d", F.abs("_d"))
    return d.groupBy(*on).agg(F.least(F.lit(1.0), F.avg("_d") / F.nullif(F.percentile("_d", F.lit(0.9)), F.lit(0.0))).alias("evenness"))


def thinned(df: DataFrame, on: list[str], order: str, most: int) -> DataFrame:
    """Every k-th row of a group so that at most `most` stay; order counts from 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    step = F.greatest(F.ceil(n / F.lit(most)), F.lit(1))
    return df.withColumn("_step", step).filter((F.col(order) - 1) % F.col("_step") == 0).drop("_step")


def thirds(df: DataFrame, on: list[str], order: str, bins: int = 3) -> DataFrame:
    """Equal time bins of a group: column `bin` from 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    return df.withColumn("bin", F.floor((F.col(order) - 1) * bins / n).cast("int"))


def running_maximum(df: DataFrame, on: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def overlapping(df: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """Rows that start before an earlier row of their group ended."""
    w = Window.partitionBy(*on).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_end", F.max(end).over(w)).filter(F.col(start) < F.col("_end")).drop("_end")


def smooth_window(n: Column) -> Column:
    """Smoothing length: an odd twelfth of n, from 5 to 21."""
    return F.greatest(F.lit(5), F.least(F.lit(21), F.floor(n / 12).cast("int").bitwiseOR(F.lit(1))))


def moving_polynomial(df: DataFrame, on: list[str], order: str, value: str, half: int, name: str) -> DataFrame:
    """Quadratic smoothing with a window of 2 * half + 1 rows; shorter windows at
    the borders take the mean of the rows that are there."""
    width = 2 * half + 1
    # weights of the least-squares parabola's value in the middle
    weights = [(3 * (3 * width * width - 7 - 20 * k * k) / 4) / (width * (width * width - 4) / 3 * 3) * 1.0 for k in range(-half, half + 1)]
    total = sum(weights)
    w = Window.partitionBy(*on).orderBy(order)
    full = sum((F.coalesce(F.lag(value, -k).over(w), F.lit(None).cast("double")) * (weights[k + half] / total) for k in range(-half, half + 1)), F.lit(0.0))
    return df.withColumn(name, F.coalesce(full, F.avg(value).over(w.rowsBetween(-half, half))))


def filled(df: DataFrame, on: list[str], order: str, value: str, name: str) -> DataFrame:
    """Missing values by linear interpolation; the borders hold the nearest value."""
    back = Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*on).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    rows = df.select("*", F.last(value, True).over(back).alias("_a"), F.last(known, True).over(back).alias("_i"), F.first(value, True).over(ahead).alias("_b"), F.first(known, True).over(ahead).alias("_j"))
    lerp = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col(order) - F.col("_i")) / F.nullif(F.col("_j") - F.col("_i"), F.lit(0))
    return rows.withColumn(name, F.coalesce(F.col(value), lerp, F.col("_a"), F.col("_b"))).drop("_a", "_b", "_i", "_j")
