"""Marking of references, scores against a null distribution, and the verdict on progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.operators import aggregates, relational

#: Repetitions that a session needs, and the percentile that flags.
LEAST_REPS, FLAG = 3, 0.95


def marked(reps: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repetitions that marks (video, spec) name, and the marks that name none.

    A spec is `all`, a rep_id, a rep_index or a range lo-hi of indexes, both ends
    included; a range is wrong if one of its indexes is missing.
    """
    spec = F.trim(F.col("spec"))
    low, high = F.regexp_extract(spec, r"^(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract(spec, r"^(\d+)-(\d+)$", 2).try_cast("int")
    index = F.when(spec.rlike(r"^\d+$"), F.array(spec.try_cast("int"))).when(low.isNotNull() & (low <= high), F.sequence(low, high))
    asked = marks.select("video", "spec", F.posexplode_outer(index).alias("_k", "_index"), (F.lower(spec) == "all").alias("_all"), spec.alias("_id"))
    ours = reps.select(F.col("video").alias("_video"), F.col("rep_id").alias("_rep"), F.col("rep_index").cast("int").alias("_i"))
    named = F.col("_all") | (F.col("_rep") == F.col("_id")) | F.coalesce(F.col("_i") == F.col("_index"), F.lit(False))
    found = asked.join(ours, (F.col("video") == F.col("_video")) & named, "left").select("video", "spec", "_rep")
    wrong = found.filter("_rep IS NULL").select("video", "spec").distinct()
    good = found.join(wrong, ["video", "spec"], "left_anti").select(F.col("_rep").alias("rep_id")).distinct()
    return reps.join(good, "rep_id", "left_semi"), wrong


def flagged_scores(scores: DataFrame, null: DataFrame, values: list[str], group: list[str]) -> DataFrame:
    """scores with the percentile of each value in the null of its group, and the flag.

    Groups without a null distribution are left out: a score is never compared with
    another group's.  The flag is total above the null's 95th percentile.
    """
    limits = null.groupBy(*group).agg(F.percentile("total", F.lit(FLAG)).alias("null_p95"), F.count("total").alias("n_null"))
    out = scores.join(limits, group)
    for value in values:
        ranked = aggregates.percentile_against(out.select("rep_id", *group, value), null, group, value, value)
        out = out.join(ranked.select("rep_id", F.col("percentile").alias(f"{value}_percentile")), "rep_id", "left")
    return out.withColumn("flagged", F.col("total") > F.col("null_p95"))


def rescored(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores after a run: a video's new rows replace its old ones."""
    return relational.replaced(old, new, ["video"])


def progress_verdict(sessions: DataFrame, comparisons: DataFrame, key: list[str]) -> DataFrame:
    """One verdict per key: one_session, too_few_reps, stable or changed, with what changed.

    sessions: key, n_reps; comparisons: key, label, supported, direction (better, worse
    or null).
    """
    per = sessions.groupBy(*key).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("n_reps") >= LEAST_REPS).alias("usable"))
    labels = lambda on: F.array_sort(F.collect_set(F.when(F.col("supported") & on, F.col("label"))))
    found = comparisons.groupBy(*key).agg(labels(F.col("direction") == "better").alias("improved"), labels(F.col("direction") == "worse").alias("declined"), labels(F.col("direction").isNull()).alias("changed"))
    rows = per.join(found, key, "left")
    some = F.lit(0)
    for c in ("improved", "declined", "changed"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
        some = some + F.size(c)
    verdict = F.when(F.col("sessions") < 2, "one_session").when(F.col("usable") < 2, "too_few_reps").when(some == 0, "stable").otherwise("changed")
    rows = rows.withColumn("verdict", verdict)
    hidden = F.col("verdict").isin("one_session", "too_few_reps")
    return rows.select(*key, "sessions", "usable", "verdict", *[F.when(hidden, F.array().cast("array<string>")).otherwise(F.col(c)).alias(c) for c in ("improved", "declined", "changed")])


def set_medians(reps: DataFrame, key: list[str], value: str) -> DataFrame:
    """value over the median of its set, as `ratio`."""
    return reps.withColumn("ratio", F.col(value) / F.nullif(F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*key)), F.lit(0.0)))
