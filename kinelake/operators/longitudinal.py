"""Days, weeks, readiness, badges and the profile's ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.num import integer_median
from kinelake.operators import relational, sequences
from kinelake.operators.relational import small


def verified(reps: DataFrame) -> DataFrame:
    """Scored, plausible and complete repetitions; missing flags count as true."""
    return reps.filter(F.col("score").isNotNull() & F.coalesce("plausible", F.lit(True)) & F.coalesce("complete", F.lit(True)))


def day_records(reps: DataFrame) -> DataFrame:
    """Per movement and day: verified repetitions and their integer median score."""
    return verified(reps).groupBy("movement", "day").agg(F.count(F.lit(1)).alias("reps"), integer_median(F.collect_list(F.col("score").cast("long"))).cast("int").alias("score"))


def readiness(days: DataFrame, standards: DataFrame) -> DataFrame:
    """Days that meet a movement's standard (reps, score, days), and its best day."""
    rows = days.join(small(standards), "movement")
    met = (F.col("reps") >= F.col("need_reps")) & (F.col("score") >= F.col("need_score"))
    best = F.max_by(F.struct("day", "reps", "score"), F.struct("reps", "score", "day"))
    out = rows.groupBy("movement").agg(F.count_if(met).alias("days_met"), F.max("need_days").alias("need_days"), best.alias("best"))
    return out.select("movement", "days_met", (F.col("days_met") >= F.col("need_days")).alias("ready"), F.col("best.day").alias("best_day"), F.col("best.reps").alias("best_reps"), F.col("best.score").alias("best_score"))


def folded_days(events: DataFrame) -> DataFrame:
    """Per day: movement totals folded to whole mean score and dominant movement."""
    by = events.groupBy("day", "movement").agg(F.sum("reps").alias("reps"), F.sum(F.col("score") * F.col("reps")).alias("score_sum"))
    lead = F.min_by("movement", F.struct(-F.col("reps"), F.col("movement")))
    return by.groupBy("day").agg(F.sum("reps").alias("reps"), F.floor(F.sum("score_sum") / F.sum("reps")).cast("long").alias("score"), lead.alias("dominant"))


def latest_days(ledger: DataFrame, key: list[str], day: str, most: int = 180) -> DataFrame:
    """Rows of the latest `most` distinct days of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(day))
    return ledger.withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= most).drop("_r")


def week_review(days: DataFrame, key: list[str], start: Column) -> DataFrame:
    """Totals of the week from `start`, the change from the week before, the best
    day, and days with events but no verified repetition."""
    age = F.datediff(F.col("day"), start)
    now, before = age.between(0, 6), age.between(-7, -1)
    best = F.max_by("day", F.when(now, F.struct("reps", "score", "day")))
    return days.groupBy(*key).agg(F.sum(F.when(now, F.col("reps")).otherwise(0)).alias("reps"), F.sum(F.when(before, F.col("reps")).otherwise(0)).alias("reps_before"), best.alias("best_day"), F.count_if(now & (F.col("reps") == 0)).alias("blank_days")).withColumn("change", F.col("reps") - F.col("reps_before"))


def badges(days: DataFrame, key: list[str]) -> DataFrame:
    """Which badges a day table earns."""
    runs = sequences.streaks(days.filter("reps > 0"), key, "day").groupBy(*key).agg(F.max("length").alias("_run"))
    out = days.groupBy(*key).agg(F.bool_or(F.col("reps") > 0).alias("first_rep"), F.bool_or(F.col("score") >= 73).alias("strong_day"), (F.sum("reps") >= 100).alias("hundred_reps"))
    return out.join(runs, key, "left").withColumn("week_streak", F.coalesce(F.col("_run") >= 7, F.lit(False))).drop("_run")


def progress_direction(days: DataFrame, key: list[str], dead_band: int = 8) -> DataFrame:
    """First against last measured day, with a dead band."""
    delta = F.max_by("score", "day") - F.min_by("score", "day")
    return days.filter("score is not null").groupBy(*key).agg(delta.alias("delta")).withColumn("direction", F.when(F.col("delta") > dead_band, "up").when(F.col("delta") < -dead_band, "down").otherwise("steady"))


def comparable(pairs: DataFrame) -> DataFrame:
    """Whether two sessions may be compared, with the first reason against it."""
    planar = F.col("robustness") == "PLANAR"
    reason = F.when(~F.col("a_bins").eqNullSafe(F.col("b_bins")), "viewpoint_differs").when(F.contains("a_bins", F.lit(",")), "viewpoint_mixed").when(planar & ~F.col("a_sides").eqNullSafe(F.col("b_sides")), "side_differs").when(F.abs(F.col("a_ruler") - F.col("b_ruler")) > 0.15 * F.abs(F.col("a_ruler")), "ruler_drift")
    return pairs.withColumn("reason", reason).withColumn("comparable", reason.isNull())


def remembered(ledger: DataFrame, clips: DataFrame, history: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold a run into the profile: upsert the ledger by content key (keeping
    first_seen) and replace the history's repetitions of its clips."""
    merged = relational.upserted(ledger, clips, ["video_sha"], ["first_seen"])
    kept = history.join(clips.select("video_sha").distinct(), "video_sha", "left_anti")
    return merged, kept.unionByName(reps, allowMissingColumns=True)


def subject_snapshot(ledger: DataFrame, key: list[str], last: int = 10) -> DataFrame:
    """Distinct sessions and exercises, counts, and the last sessions."""
    sessions = F.array_sort(F.collect_set("session_id"))
    return ledger.groupBy(*key).agg(sessions.alias("sessions"), F.array_sort(F.collect_set("exercise")).alias("exercises"), F.count(F.lit(1)).alias("clips"), F.sum("n_reps").alias("reps")).withColumn("recent", F.slice("sessions", F.greatest(F.size("sessions") - last + 1, F.lit(1)), last))


def ingest_log(clips: DataFrame, reps: DataFrame, reasons: DataFrame) -> DataFrame:
    """One row per clip, also without repetitions: count and joined distinct reasons."""
    n = reps.groupBy("video").agg(F.count(F.lit(1)).alias("n_reps"))
    why = reasons.groupBy("video").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "reason"))), lambda s: s["reason"])), " | ").alias("reasons"))
    return clips.join(n, "video", "left").join(why, "video", "left").withColumn("n_reps", F.coalesce("n_reps", F.lit(0))).withColumn("reasons", F.coalesce("reasons", F.lit("")))


def clip_metadata(clips: DataFrame, sidecar: DataFrame, pattern: str = r"(\d{4}-\d{2}-\d{2})_([a-z_]+?)_(\d+)") -> DataFrame:
    """session_id, exercise and set of clips: sidecar first, then the file name,
    then the file's date."""
    name = lambda i: F.nullif(F.regexp_extract("video", pattern, i), F.lit(""))
    rows = clips.join(sidecar.select("video", *[F.col(c).alias(f"_{c}") for c in ("session_id", "exercise", "set_index")]), "video", "left")
    day = F.date_format("modificationTime", "yyyy-MM-dd")
    return rows.select("video", F.coalesce("_session_id", name(1), day).alias("session_id"), F.coalesce("_exercise", name(2)).alias("exercise"), F.coalesce("_set_index", name(3).cast("int"), F.lit(1)).alias("set_index"))
