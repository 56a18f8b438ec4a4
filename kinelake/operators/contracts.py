"""Constraint queries: every contract is a table of violations (key, rule, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.operators.rules import score_band


def violations(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row per broken rule; a rule that is null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]), lambda r: r.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def container(df: DataFrame, key: str) -> DataFrame:
    """fps, frames and duration of clips: positive, and duration near frames / fps."""
    near = F.abs(F.col("duration") - F.col("frames") / F.col("fps")) <= F.greatest(0.05 * F.col("duration"), 1 / F.col("fps"))
    return violations(df, key, [("fps_positive", F.col("fps") > 0), ("frames_positive", F.col("frames") > 0), ("duration_matches", near)])


def segments(df: DataFrame, clip: str, start: str, turn: str, end: str, frames: str) -> DataFrame:
    """start < turn < end, inside the clip, sorted and disjoint."""
    w = Window.partitionBy(clip).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_before", F.coalesce(F.max(end).over(w), F.lit(-1)))
    return violations(rows, clip, [("ordered", (F.col(start) < F.col(turn)) & (F.col(turn) < F.col(end))), ("inside", (F.col(start) >= 0) & (F.col(end) < F.col(frames))), ("disjoint", F.col("_before") <= F.col(start))])


def detection(df: DataFrame, key: str) -> DataFrame:
    return violations(df, key, [("named", F.length("exercise") > 0), ("confidence", F.col("confidence").between(0, 1))])


#: Keys of a payload and of each of its repetitions.
REQUIRED = ["headline", "narrative", "nextSession", "exercise", "detected", "trim", "session", "sessionScore", "sessionBand", "n_reps", "n_candidates", "fps", "duration_s", "reps", "sessions", "blockers", "topFixes"]
REP_REQUIRED = ["session", "label", "transition_s", "total_s", "class", "metrics", "plausible", "problems", "startS", "endS", "turnS", "score", "band", "scoreNote", "components", "aside", "trace"]
#: Text meant for developers, seconds that a repetition may pass the end by.
DEVELOPER_TEXT = r"Known: |Traceback|pip install|\.venv|Exception\b|Error:"
TIME_SLACK_S = 0.5


def payload(df: DataFrame, key: str, doc: str, version: int) -> DataFrame:
    """key and rule of each breach by a JSON object; a repetition's rules count once a breach.

    A document that is null or no object breaks required_keys alone.  Numbers may be
    written as texts; what is no finite number is no number.  A repetition that lacks a
    key is judged by rep_required_keys alone.
    """
    top = F.from_json(doc, "map<string,string>")
    rows = df.select(F.col(key).cast("string").alias("key"), top.alias("p")).withColumn("p", F.when(F.size("p") > 0, F.col("p")))
    rows = rows.withColumn("reps", F.coalesce(F.from_json(F.col("p")["reps"], "array<map<string,string>>"), F.array().cast("array<map<string,string>>")))
    texts = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))

    def number(x: Column) -> Column:
        value = x.try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)

    def lacks(m: Column, names: list[str]) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(n) for n in names]), F.map_keys(m))) > 0

    def out_of_range(x: Column) -> Column:
        return x.isNotNull() & ~F.coalesce(number(x).between(0, 100), F.lit(False))

    p = F.col("p")
    score, duration, n, candidates = p["sessionScore"], F.coalesce(number(p["duration_s"]), F.lit(0.0)), p["n_reps"].try_cast("bigint"), p["n_candidates"].try_cast("bigint")
    expected = score_band(F.when(number(score).isNotNull(), F.floor(number(score))))
    band_wrong = ~F.coalesce(p["sessionBand"] == expected, F.lit(False))

    def of_rep(r: Column) -> Column:
        s, t, e = number(r["startS"]), number(r["turnS"]), number(r["endS"])
        timed = s.isNotNull() & t.isNotNull() & e.isNotNull()
        outside = (s < 0) | ((duration > 0) & (e > duration + TIME_SLACK_S))
        checks = [("rep_score_in_range", out_of_range(r["score"])), ("rep_times_ordered", timed & ~((s <= t) & (t <= e))), ("rep_times_inside_clip", timed & outside)]
        return F.when(lacks(r, REP_REQUIRED), F.array(F.lit("rep_required_keys"))).otherwise(F.array_compact(F.array(*[F.when(broken, name) for name, broken in checks])))

    seen = F.concat(F.array(p["headline"], p["narrative"], p["nextSession"]), texts(p["blockers"]), F.flatten(F.transform("reps", lambda r: F.concat(texts(r["problems"]), F.array(r["scoreNote"])))))
    developer = F.transform(F.filter(seen, lambda x: F.coalesce(F.rlike(x, F.lit(DEVELOPER_TEXT)), F.lit(False))), lambda x: F.lit("no_developer_text"))
    top_checks = [
        ("required_keys", lacks(p, REQUIRED)),
        ("measurement_version", ~F.coalesce(number(p["measurementVersion"]) == version, F.lit(False))),
        ("session_score_in_range", out_of_range(score)),
        ("session_band_matches_score", band_wrong),
        ("n_reps_non_negative", n < 0),
        ("n_reps_le_candidates", (candidates > 0) & (n > candidates)),
        ("zero_reps_has_blocker", (n == 0) & (F.size(texts(p["blockers"])) == 0)),
        ("untranslated_text", F.size(texts(F.get_json_object(p["i18n"], "$.untranslated"))) > 0),
    ]
    broken = F.concat(F.array_compact(F.array(*[F.when(bad, name) for name, bad in top_checks])), F.flatten(F.transform("reps", of_rep)), developer)
    return rows.select("key", F.explode(F.when(p.isNull(), F.array(F.lit("required_keys"))).otherwise(broken)).alias("rule"))


def fusion(df: DataFrame, key: str) -> DataFrame:
    """A fusion, where there is one (fused), names its exercise."""
    return violations(df, key, [("exercise_named", ~F.coalesce("fused", F.lit(False)) | (F.trim("exercise") != ""))])


def references(catalogue: DataFrame, movements: DataFrame, rules: DataFrame, errors: int = 5) -> DataFrame:
    """id, problem and subject of each reference that leads nowhere, once each.

    catalogue: id, measurable, weighted, base_of, rule_ids and n_errors; movements: id;
    rules: id, as owner.name.  A rule id without a point has no owner.
    """
    known = movements.select(F.col("id").alias("_m")).distinct()
    out = lambda rows, problem, subject: rows.select("id", F.lit(problem).alias("problem"), subject.cast("string").alias("subject"))
    nothing = F.lit(None)
    weighted = catalogue.filter("weighted")
    has_base = F.coalesce("base_of", F.lit("")) != ""
    parts = [
        out(catalogue.filter("measurable").join(known, F.col("id") == F.col("_m"), "left_anti"), "no_movement", nothing),
        out(weighted.filter(~has_base), "no_base", nothing),
        out(weighted.filter(has_base).join(known, F.col("base_of") == F.col("_m"), "left_anti"), "unknown_base", F.col("base_of")),
        out(catalogue.filter(F.coalesce("n_errors", F.lit(0)) != errors), "errors_listed", F.col("n_errors")),
    ]
    used = catalogue.select("id", F.coalesce("measurable", F.lit(False)).alias("measurable"), F.explode("rule_ids").alias("rule"))
    used = used.withColumn("owner", F.when(F.instr("rule", ".") > 0, F.substring_index("rule", ".", 1)).otherwise(""))
    registered = rules.select(F.col("id").alias("rule"), F.lit(True).alias("_rule")).distinct()
    owners = rules.select(F.substring_index("id", ".", 1).alias("owner"), F.lit(True).alias("_owner")).distinct()
    judged = used.join(owners, "owner", "left").join(registered, "rule", "left")
    problem = F.when(~F.col("measurable"), "not_measurable").when(F.col("_owner").isNull(), "unknown_owner").when(F.col("owner") != F.col("id"), "foreign_rule").when(F.col("_rule").isNull(), "unknown_rule")
    parts.append(judged.select("id", problem.alias("problem"), F.col("rule").alias("subject")).filter("problem IS NOT NULL"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.distinct()


def counted(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
