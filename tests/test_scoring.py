"""Marks of references, rescoring and verdicts on small tables."""

from pyspark.sql import functions as F

from kinelake.operators import holds, scoring


def test_marks_by_id_index_range_and_all(spark):
    reps = spark.createDataFrame([(f"{v}{i}", v, i) for v in "ab" for i in range(6)], "rep_id string, video string, rep_index int")
    marks = spark.createDataFrame([("a", "a1"), ("a", " 3-4 "), ("a", "5"), ("b", "ALL"), ("a", "4-9"), ("b", "nonsense"), ("a", "99")], "video string, spec string")
    good, wrong = scoring.marked(reps, marks)
    assert {(r.video, r.spec.strip()) for r in wrong.collect()} == {("a", "4-9"), ("b", "nonsense"), ("a", "99")}
    assert {r.rep_id for r in good.collect()} == {"a1", "a3", "a4", "a5", *(f"b{i}" for i in range(6))}


def test_new_scores_replace_a_video(spark):
    old = spark.createDataFrame([("r1", "a", 1.0), ("r2", "b", 2.0)], "rep_id string, video string, total double")
    new = spark.createDataFrame([("r3", "a", 3.0)], old.schema)
    assert {r.rep_id for r in scoring.rescored(old, new).collect()} == {"r2", "r3"}


def test_flags_never_cross_groups(spark):
    scores = spark.createDataFrame([("r1", "x", 5.0), ("r2", "x", 0.5), ("r3", "y", 9.0)], "rep_id string, bin string, total double")
    null = spark.createDataFrame([("x", float(i)) for i in range(5)], "bin string, total double")
    got = {r.rep_id: r for r in scoring.flagged_scores(scores, null, ["total"], ["bin"]).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].flagged and not got["r2"].flagged
    assert got["r2"].total_percentile == 20.0 and got["r1"].n_null == 5


def test_verdicts(spark):
    sessions = spark.createDataFrame([("a", 5), ("b", 5), ("b", 1), ("c", 4), ("c", 4), ("d", 9), ("d", 9)], "user string, n_reps int")
    found = spark.createDataFrame([("d", "rom", True, "better"), ("d", "tempo", True, None), ("d", "swing", False, "worse"), ("b", "rom", True, "better")], "user string, label string, supported boolean, direction string")
    got = {r.user: (r.verdict, r.improved, r.declined, r.changed) for r in scoring.progress_verdict(sessions, found, ["user"]).collect()}
    assert got == {"a": ("one_session", [], [], []), "b": ("too_few_reps", [], [], []), "c": ("stable", [], [], []), "d": ("changed", ["rom"], [], ["tempo"])}


def test_phases_of_short_holds(spark):
    rows = spark.createDataFrame([("v", 1, 10, 14), ("v", 2, 50, 90)], "video string, hold int, start_frame int, end_frame int")
    got = {(r.hold, r.phase): (r.a, r.b) for r in holds.phases(rows).collect()}
    assert got[1, "onset"] == (10, 13) and got[1, "exit"] == (11, 14) and got[1, "sustained"] == (10, 14)
    assert got[2, "sustained"] == (54, 86)
    assert {r.state for r in holds.evidence(spark.createDataFrame([("v", 1, 80.0, None)], "video string, hold int, body_line_deg double, swing double")).filter(F.col("primitive") == "swing").collect()} == {"unmeasured"}
