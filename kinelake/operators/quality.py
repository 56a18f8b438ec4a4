"""Repetition scores and the checks of the score itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.num import clip01
from kinelake.operators import aggregates


def range_component(depth: Column, peak: Column, ruler: Column) -> Column:
    """Mean of depth and peak over the ruler, clipped; null without a usable ruler."""
    return F.when(ruler.between(0.60, 1.90), 0.5 * (clip01(depth / ruler) + clip01(peak / ruler)))


def control_penalty(tempo: Column) -> Column:
    return F.when(tempo.isNotNull(), 0.25 * clip01(1 - tempo / 0.70)).otherwise(0.0)


def rep_scores(reps: DataFrame, weights: dict[str, float], least_quality: float = 0.55) -> DataFrame:
    """0 .. 100 from weighted components less the penalty; the first refusal counts.

    reps: plausible, quality, range, penalty and a column per component.
    """
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    refusal = F.when(~F.coalesce("plausible", F.lit(True)), "implausible").when(F.col("quality") < least_quality, "low_quality").when(total == 0, "no_component").when(F.col("range").isNull(), "range_missing")
    whole = F.lit(True)
    for c in weights:
        whole = whole & F.col(c).isNotNull()
    return reps.withColumn("refusal", refusal).withColumn("score", F.when(refusal.isNull(), F.bround(100 * value * (1 - F.col("penalty")), 0).cast("int"))).withColumn("complete", F.col("score").isNotNull() & whole)


def implausibilities(checks: list[tuple[str, Column]]) -> Column:
    """The names of the checks that fail; a check without a value passes."""
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]), lambda x: x.isNotNull())


def ceiling(reps: DataFrame, components: list[str], group: list[str]) -> DataFrame:
    """Distinct values, share at the ceiling and span of each component."""
    long = reps.unpivot(group, components, "component", "value").filter("value is not null")
    return long.groupBy(*group, "component").agg(F.count_distinct(F.round("value", 4)).alias("distinct"), F.avg((F.col("value") >= 0.999).cast("double")).alias("at_ceiling"), (F.max("value") - F.min("value")).alias("span"))


def reliability(pairs: DataFrame, most: float = 5.0) -> DataFrame:
    """Mean absolute difference of paired set means (pair, a, b)."""
    return pairs.agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("noise")).withColumn("passed", F.col("noise") <= most)


def degradation(reps: DataFrame, group: list[str], noise: float) -> DataFrame:
    """Rank correlation of score and order, and the first against the last third, in 6 decimals.

    The verdict reads the rounded values: a fall on the limit, or no correlation, is none
    whatever the last places of the means.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    rows = reps.filter("score is not null").withColumn("_third", F.floor(3 * (F.row_number().over(Window.partitionBy(*group).orderBy("rep_index")) - 1) / n))
    ends = rows.groupBy(*group).agg((F.avg(F.when(F.col("_third") == 0, F.col("score"))) - F.avg(F.when(F.col("_third") == 2, F.col("score")))).alias("fall"))
    out = aggregates.rank_correlation(reps, group, "rep_index", "score").join(ends, group).withColumns({c: F.round(c, 6) for c in ("rho", "fall")})
    return out.withColumn("degrades", (F.col("rho") < 0) & (F.col("fall") > noise))


def sensitivity(baseline: DataFrame, degraded: DataFrame, noise: float) -> DataFrame:
    """Whether each kind of worsened set scores lower than the baseline by more than noise."""
    base = baseline.agg(F.avg("score").alias("_base"))
    return degraded.groupBy("kind").agg(F.avg("score").alias("mean")).crossJoin(F.broadcast(base)).select("kind", (F.col("_base") - F.col("mean")).alias("fall"), (F.col("_base") - F.col("mean") > noise).alias("detected"))


def weakest(reps: DataFrame, components: list[str], group: list[str]) -> DataFrame:
    long = reps.unpivot(group, components, "component", "value").groupBy(*group, "component").agg(F.avg("value").alias("mean")).filter("mean is not null")
    return long.groupBy(*group).agg(F.min_by("component", F.struct("mean", "component")).alias("weakest"), F.max_by("component", F.struct("mean", "component")).alias("strongest"))


def slowing(reps: DataFrame, group: list[str], band: float = 0.15, least: int = 3) -> DataFrame:
    """Last against first repetition time: slower, faster or steady."""
    rows = reps.filter("seconds is not null").groupBy(*group).agg(F.count(F.lit(1)).alias("n"), (F.max_by("seconds", "rep_index") / F.min_by("seconds", "rep_index") - 1).alias("drift"))
    return rows.filter(F.col("n") >= least).withColumn("verdict", F.when(F.col("drift") > band, "slower").when(F.col("drift") < -band, "faster").otherwise("steady"))
