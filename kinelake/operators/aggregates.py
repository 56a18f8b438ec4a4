"""Session tables, noise, comparison, empirical percentiles, confusion, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.num import finite


def session_table(df: DataFrame, session: list[str], metrics: list[str], quality: str | None = None, usable: float = 0.55, labels: list[str] = ()) -> DataFrame:
    """Per session: rows, usable rows, mean quality, joined labels, and the median
    and the number of finite values of each metric."""
    agg = [F.count(F.lit(1)).alias("n")]
    if quality:
        agg += [F.count_if(F.col(quality) >= usable).alias("n_usable"), F.avg(quality).alias("mean_quality")]
    agg += [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s") for c in labels]
    for m in metrics:
        agg += [F.percentile(finite(m), F.lit(0.5)).alias(f"{m}_median"), F.count(finite(m)).alias(f"{m}_n")]
    return df.groupBy(*session).agg(*agg)


def pooled_noise(df: DataFrame, group: list[str], session: str, metric: str) -> DataFrame:
    """Pooled deviation from the sessions' own medians, with its degrees of freedom.

    Sessions with one value are left out.
    """
    rows = df.select(*group, session, finite(metric).alias("_v")).filter("_v is not null")
    own = rows.groupBy(*group, session).agg(F.percentile("_v", F.lit(0.5)).alias("_m"), F.count(F.lit(1)).alias("_k")).filter("_k >= 2")
    dev = rows.join(own, [*group, session]).groupBy(*group).agg(F.sum((F.col("_v") - F.col("_m")) * (F.col("_v") - F.col("_m"))).alias("_ss"), F.count(F.lit(1)).alias("n"), F.count_distinct(session).alias("sessions"))
    df_ = F.greatest(F.col("n") - F.col("sessions"), F.lit(1))
    return dev.select(*group, F.sqrt(F.col("_ss") / df_).alias("sd"), "n", "sessions", df_.alias("df"))


def values_needed(sd: Column, target: Column) -> Column:
    """Values per session to see a change of `target`: 2 * (z.975 + z.80)^2 * (sd / target)^2."""
    return F.ceil(F.lit(2 * 2.8016**2) * (sd / target) * (sd / target))


def compared(pairs: DataFrame, noise: DataFrame, on: list[str], metric: str, least_effect: float = 2.0) -> DataFrame:
    """Change of a metric's median between two sessions against the pooled noise.

    pairs has a_<metric>_median, b_..., a_n and b_n.
    """
    a, b = F.col(f"a_{metric}_median"), F.col(f"b_{metric}_median")
    se = F.col("sd") * F.sqrt(1 / F.col("a_n") + 1 / F.col("b_n"))
    rows = pairs.join(noise, on, "left").withColumn("change", b - a).withColumn("se", se)
    effect = F.col("change") / F.nullif(F.col("se"), F.lit(0.0))
    return rows.withColumn("change_pct", 100 * F.col("change") / F.nullif(F.abs(a), F.lit(0.0))).withColumn("effect", effect).withColumn("supported", F.coalesce(F.abs("effect") >= least_effect, F.lit(False))).withColumn("direction", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("same"))


def running(per: DataFrame, group: list[str], order: str, sums: list[str]) -> DataFrame:
    """per with, for each of sums, <name>_upto (running sum over order) and <name>_all, and _next, the next value.

    A group may have any share of the rows: sums run within ranges of the order and over
    the ranges' totals. per has one row per group and value of order, none of them null.
    """
    ranges = max(2, int(per.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = sorted(set(per.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order).cast("double"))) if cuts else F.lit(0)
    # null-safe: a struct of nulls is a key like any other
    keyed = per.withColumn("_g", F.struct(*group)).withColumn("_b", place)
    totals = keyed.groupBy("_g", "_b").agg(F.min(order).alias("_min"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    w = Window.partitionBy("_g").orderBy("_b")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_g", "_b", F.lead("_min").over(w).alias("_first"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums], *[F.sum(f"_t_{c}").over(Window.partitionBy("_g")).alias(f"{c}_all") for c in sums])
    inner = Window.partitionBy("_g", "_b").orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = keyed.join(starts, ["_g", "_b"])
    rows = rows.withColumns({**{f"{c}_upto": F.col(f"_s_{c}") + F.sum(c).over(upto) for c in sums}, "_next": F.coalesce(F.lead(order).over(inner), "_first")})
    return rows.drop("_g", "_b", "_first", *[f"_s_{c}" for c in sums])


def mid_rank_percentile(df: DataFrame, group: list[str], value: str, name: str = "percentile") -> DataFrame:
    """100 * (below + equal / 2) / n of each value within its group; null values have none and don't count."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_k"))
    rank = F.lit(100.0) * (F.col("_k_upto") - F.lit(0.5) * F.col("_k")) / F.col("_k_all")
    found = running(per, group, value, ["_k"]).select(F.struct(*group, value).alias("_key"), rank.alias(name))
    return df.withColumn("_key", F.struct(*group, value)).join(found, "_key", "left").drop("_key")


def percentile_against(values: DataFrame, null: DataFrame, group: list[str], value: str, null_value: str) -> DataFrame:
    """Mid-rank percentile of values in the null distribution of their group.

    Both sides are counted by value, so no pair is formed.
    """
    a = values.select(*group, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_null"))
    b = null.select(*group, F.col(null_value).cast("double").alias("_v"), F.lit(1).alias("_null"))
    per = a.unionByName(b).filter("_v IS NOT NULL").groupBy(*group, "_v").agg(F.sum("_null").alias("_k"))
    rank = F.lit(100.0) * (F.col("_k_upto") - F.lit(0.5) * F.col("_k")) / F.nullif(F.col("_k_all"), F.lit(0))
    found = running(per, group, "_v", ["_k"]).select(F.struct(*group, "_v").alias("_key"), rank.alias("percentile"))
    return values.withColumn("_key", F.struct(*group, F.col(value).cast("double").alias("_v"))).join(found, "_key", "left").drop("_key")


def quantiles(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """n and the exact, linearly interpolated quantiles q0, q1, ... of each group, without a group in one buffer."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    rows = running(per, group, "_v", ["_k"])
    at = [F.lit(p) * (F.col("_k_all") - 1) for p in shares]
    picks = [F.min(F.when(F.col("_k_upto") > f(x), F.col("_v"))).alias(f"_{side}{i}") for i, x in enumerate(at) for side, f in (("l", F.floor), ("h", F.ceil))]
    out = rows.groupBy(*group).agg(F.max("_k_all").alias("n"), *picks)
    part = lambda i: F.lit(shares[i]) * (F.col("n") - 1) - F.floor(F.lit(shares[i]) * (F.col("n") - 1))
    return out.select(*group, "n", *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * part(i)).alias(f"q{i}") for i in range(len(shares))])


def null_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, median, p95, interquartile range, spread ratio; few values limit resolution."""
    rows = quantiles(df, group, value, [0.25, 0.5, 0.75, 0.95])
    return rows.select(*group, "n", F.col("q1").alias("median"), F.col("q3").alias("p95"), (F.col("q2") - F.col("q0")).alias("iqr"), (F.col("q3") / F.nullif(F.col("q1"), F.lit(0.0))).alias("spread_ratio"), (F.col("n") < 12).alias("resolution_limited"))


def coefficient_of_variation(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(F.when(F.count(value) >= 2, F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv"))


def upper_medians(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The middle value of each group, the upper one of two, by counts of values; null without values."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_k"))
    found = running(per, group, value, ["_k"]).groupBy(*group).agg(F.min(F.when(F.col("_k_upto") > F.floor(F.col("_k_all") / 2), F.col(value))).alias("upper_median"))
    empty = df.groupBy(*group).agg(F.count(value).alias("_n")).filter("_n = 0").drop("_n")
    return found.unionByName(empty, allowMissingColumns=True)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Support, precision, recall and F1 per class."""
    sides = df.select(F.col(truth).alias("label"), (F.col(truth) == F.col(predicted)).alias("hit"), F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(df.select(F.col(predicted).alias("label"), F.lit(False).alias("hit"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    rows = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.count_if("hit").alias("correct"))
    rows = rows.withColumn("precision", F.col("correct") / F.nullif(F.col("predicted"), F.lit(0))).withColumn("recall", F.col("correct") / F.nullif(F.col("support"), F.lit(0)))
    return rows.withColumn("f1", 2 * F.col("correct") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)))


def threshold_sweep(df: DataFrame, group: list[str], value: str, truth: str) -> DataFrame:
    """tp, fp, fn and agreement at the midpoints of neighbouring distinct values.

    A value fires when above the midpoint; counts are running sums over the
    sorted distinct values, so no value meets every threshold.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count_if(F.col(truth) == 1).alias("_p"), F.count_if(F.col(truth) != 1).alias("_n"))
    rows = running(per, group, value, ["_p", "_n"])
    rows = rows.filter("_next IS NOT NULL").select(*group, ((F.col(value) + F.col("_next")) / 2).alias("threshold"), (F.col("_p_all") - F.col("_p_upto")).alias("tp"), (F.col("_n_all") - F.col("_n_upto")).alias("fp"), F.col("_p_upto").alias("fn"), "_n_upto", "_p_all", "_n_all")
    return rows.select(*group, "threshold", "tp", "fp", "fn", ((F.col("tp") + F.col("_n_upto")) / (F.col("_p_all") + F.col("_n_all"))).alias("agreement"))


def best_threshold(sweep: DataFrame, group: list[str], least_tp: int = 0) -> DataFrame:
    best = F.max_by(F.struct("threshold", "agreement", "tp", "fp", "fn"), F.struct(F.col("agreement"), -F.col("threshold")))
    return sweep.filter(F.col("tp") >= least_tp).groupBy(*group).agg(best.alias("_b")).select(*group, "_b.*")


def rank_correlation(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Tie-aware rank correlation; null for fewer than 3 pairs or a constant side."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(*group)

    def average_rank(c: str) -> Column:
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, c)) - 1) / 2

    rows = rows.select(*group, average_rank(x).alias("_x"), average_rank(y).alias("_y"))
    ok = (F.count(F.lit(1)) >= 3) & (F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0)
    # the products of deviations, so a constant side gives null and not NaN
    cov = F.avg(F.col("_x") * F.col("_y")) - F.avg("_x") * F.avg("_y")
    return rows.groupBy(*group).agg(F.when(ok, cov / (F.stddev_pop("_x") * F.stddev_pop("_y"))).alias("rho"))


def trend(days: DataFrame, key: list[str], day: str, amount: str, today: Column, window: int) -> DataFrame:
    """Sums of the last `window` days, of as many before, and the change in percent."""
    age = F.datediff(today, F.col(day))
    rows = days.groupBy(*key).agg(F.sum(F.when(age.between(0, window - 1), F.col(amount)).otherwise(0)).alias("recent"), F.sum(F.when(age.between(window, 2 * window - 1), F.col(amount)).otherwise(0)).alias("previous"))
    return rows.withColumn("delta", F.col("recent") - F.col("previous")).withColumn("pct", 100.0 * F.col("delta") / F.nullif(F.col("previous"), F.lit(0)))


def day_rollup(df: DataFrame, day: str, kind: str, amount: str) -> DataFrame:
    """Per day: rows, whole mean amount and the most frequent kind (ties by name)."""
    by_kind = df.groupBy(day, kind).agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_s"))
    lead = F.min_by(kind, F.struct(-F.col("_n"), F.col(kind)))
    return by_kind.groupBy(day).agg(F.sum("_n").alias("n"), F.floor(F.sum("_s") / F.sum("_n")).cast("long").alias("mean_amount"), lead.alias("dominant"))


def experience_level(total: Column, first: int = 400, step: int = 200) -> Column:
    """Level of a total when level k to k + 1 takes first + step * (k - 1): the
    largest level whose sum of steps fits, by the quadratic's root."""
    a, b = F.lit(step / 2.0), F.lit(first - step / 2.0)
    return (F.lit(1) + F.floor((F.sqrt(b * b + 4 * a * total) - b) / (2 * a))).cast("int")


def consensus(replies: DataFrame, key: str, answer: str) -> DataFrame:
    """The most frequent answer per key (ties by name), its count and all answers."""
    tally = replies.groupBy(key, answer).agg(F.count(F.lit(1)).alias("_n"))
    return tally.groupBy(key).agg(F.min_by(answer, F.struct(-F.col("_n"), F.col(answer))).alias("verdict"), F.max("_n").alias("votes"), F.sum("_n").alias("replies"))


def count_agreement(df: DataFrame, key: str, value: str) -> DataFrame:
    """Two counts within one give the lower, further apart none, a single one itself."""
    rows = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    return rows.select(key, F.when((F.col("_n") > 0) & (F.col("_hi") - F.col("_lo") <= 1), F.col("_lo")).alias("count"), (F.col("_hi") > F.col("_lo")).alias("ranged"))
