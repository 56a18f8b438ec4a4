"""Folds, reports against labels and manifests, and fault verdicts of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.num import index_quantile
from kinelake.operators.relational import small


def folds(clips: DataFrame, owner: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Stratified folds by owner: all rows of an owner share a fold.

    Owners of a label are dealt in the order of the sha256 of `seed:owner`.
    """
    owners = clips.groupBy(owner).agg(F.min(label).alias("_label"))
    w = Window.partitionBy("_label").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(owner).cast("string")), 256), owner)
    return clips.join(owners.select(owner, ((F.row_number().over(w) - 1) % k).alias("fold")), owner)


def clip_verdicts(assessments: DataFrame, clip: list[str], least: int = 2) -> DataFrame:
    """present, absent or unclear per clip and error, from its repetitions."""
    rows = assessments.groupBy(*clip, "error").agg(F.count_if(F.col("status") == "observed").alias("_yes"), F.count_if(F.col("status") != "unobservable").alias("_judged"))
    need = F.least(F.lit(least), F.col("_judged"))
    return rows.select(*clip, "error", F.when(F.col("_judged") == 0, "unclear").when(F.col("_yes") >= need, "present").when(F.col("_yes") == 0, "absent").otherwise("unclear").alias("verdict"))


def against_labels(verdicts: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Agreement, false alarms, misses, precision and recall per error."""
    yes, truth = F.col("verdict") == "present", F.col("truth")
    rows = verdicts.join(labels, on).groupBy("error").agg(F.count_if(yes & truth).alias("hits"), F.count_if(yes & ~truth).alias("false_alarms"), F.count_if((F.col("verdict") == "absent") & truth).alias("missed"), F.count_if((F.col("verdict") == "absent") & ~truth).alias("quiet"), F.count_if(F.col("verdict") == "unclear").alias("unclear"))
    return rows.withColumn("precision", F.col("hits") / F.nullif(F.col("hits") + F.col("false_alarms"), F.lit(0))).withColumn("recall", F.col("hits") / F.nullif(F.col("hits") + F.col("missed"), F.lit(0)))


def rule_coverage(assessments: DataFrame) -> DataFrame:
    """Per rule: judgeable and firing rates, value quantiles by place, and whether
    the threshold lies outside the values or never fires."""
    seen = F.col("status") != "unobservable"
    values = F.array_sort(F.collect_list(F.when(seen, F.col("value"))))
    rows = assessments.groupBy("movement", "error").agg(F.avg(seen.cast("double")).alias("judgeable"), F.avg(F.when(seen, (F.col("status") == "observed").cast("double"))).alias("fire_rate"), F.first("threshold").alias("threshold"), values.alias("_v"))
    at = lambda p: F.when(F.size("_v") > 0, index_quantile(F.col("_v"), p))
    rows = rows.select("movement", "error", "judgeable", "fire_rate", "threshold", at(0.02).alias("p02"), at(0.5).alias("median"), at(0.98).alias("p98"))
    return rows.withColumn("out_of_range", ~F.col("threshold").between(F.col("p02"), F.col("p98"))).withColumn("dead", F.coalesce(F.col("fire_rate") == 0, F.lit(True)))


def set_checks(results: DataFrame, manifest: DataFrame, clip: str) -> DataFrame:
    """Missed, extra and forbidden faults per clip (arrays fired, expected, forbidden)."""
    rows = results.join(manifest, clip)
    return rows.select(clip, F.array_sort(F.array_except("expected", "fired")).alias("missed"), F.array_sort(F.array_except("fired", "expected")).alias("extra"), F.array_sort(F.array_intersect("fired", "forbidden")).alias("forbidden"))


def count_errors(results: DataFrame, manifest: DataFrame, clip: str) -> DataFrame:
    rows = results.join(manifest, clip)
    return rows.groupBy("movement").agg(F.avg(F.abs(F.col("n_reps") - F.col("reps")).cast("double")).alias("mean_abs_error"), F.count_if(F.col("n_reps") == F.col("reps")).alias("exact"), F.count(F.lit(1)).alias("clips"))


def disputes(directory: DataFrame, vision: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Keys whose three labels differ; a missing label does not dispute."""
    rows = directory.join(vision, key, "full_outer").join(model, key, "full_outer")
    distinct = F.array_distinct(F.filter(F.array("directory", "vision", "model"), lambda x: x.isNotNull()))
    return rows.filter(F.size(distinct) > 1)


def holdout_rates(scores: DataFrame, threshold: DataFrame, group: list[str]) -> DataFrame:
    """False-positive rate of clean holdout repetitions and detection rate per label."""
    rows = scores.join(small(threshold), group).withColumn("_hit", F.col("total") > F.col("p95"))
    return rows.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("detected"), F.avg(F.col("_hit").cast("double")).alias("rate"), F.percentile("percentile", F.lit(0.5)).alias("median_percentile"))


def matching_fields(config: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Config fields (field, value) whose value, or a hundred times it, is a threshold."""
    scaled = config.select("field", F.explode(F.array(F.col("value"), F.col("value") * 100)).alias("_v")).withColumn("_key", F.round("_v", 6))
    return thresholds.withColumn("_key", F.round("threshold", 6)).join(scaled, "_key").filter(F.abs(F.col("threshold") - F.col("_v")) < 1e-9).select("threshold", "field").distinct()


def flattened(doc: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of the leaves of a map column; two of them compare by a full join."""
    return doc.select(key, F.explode(column).alias("path", "value"))


def leaf_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x, y = a.withColumnRenamed("value", "before"), b.withColumnRenamed("value", "after")
    return x.join(y, [key, "path"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
