"""Days, scores, evaluation and the model on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import evaluation, kernels, longitudinal, model, quality


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_day_records_and_readiness(spark):
    rows = [("dip", day(0), 80, True, True), ("dip", day(0), 71, None, None), ("dip", day(0), None, True, True), ("dip", day(1), 60, False, True), ("dip", day(2), 90, True, True)]
    days = longitudinal.day_records(spark.createDataFrame(rows, "movement string, day date, score int, plausible boolean, complete boolean"))
    assert {(r.day, r.reps, r.score) for r in days.collect()} == {(day(0), 2, 75), (day(2), 1, 90)}
    need = spark.createDataFrame([("dip", 1, 70, 2)], "movement string, need_reps int, need_score int, need_days int")
    r = longitudinal.readiness(days, need).first()
    assert (r.days_met, r.ready, r.best_day) == (2, True, day(0))


def test_week_review_and_badges(spark):
    rows = [("u", day(n), r, s) for n, r, s in ((0, 5, 50), (1, 7, 80), (2, 0, None), (7, 20, 75), (8, 0, None), (9, 1, 60))]
    days = spark.createDataFrame(rows, "user string, day date, reps int, score int")
    r = longitudinal.week_review(days, ["user"], F.lit(day(7))).first()
    assert (r.reps, r.reps_before, r.best_day, r.blank_days, r.change) == (21, 12, day(7), 1, 9)
    b = longitudinal.badges(days, ["user"]).first()
    assert (b.first_rep, b.strong_day, b.hundred_reps, b.week_streak) == (True, True, False, False)
    assert longitudinal.progress_direction(days, ["user"]).first().direction == "up"
    assert longitudinal.latest_days(days, ["user"], "day", 2).count() == 2
    assert longitudinal.folded_days(days.withColumnRenamed("user", "movement").filter("reps > 0")).count() == 4


def test_remembering_is_idempotent(spark):
    ledger = spark.createDataFrame([("a", "2024", "x")], "video_sha string, first_seen string, note string")
    clips = spark.createDataFrame([("a", "2025", "y"), ("b", "2025", "z")], "video_sha string, first_seen string, note string")
    history = spark.createDataFrame([("a", 1), ("c", 1)], "video_sha string, rep int")
    reps = spark.createDataFrame([("a", 1), ("a", 2)], "video_sha string, rep int")
    once = longitudinal.remembered(ledger, clips, history, reps)
    twice = longitudinal.remembered(once[0], clips, once[1], reps)
    for x, y in zip(once, twice, strict=True):
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    assert ("a", "2024", "y") in [tuple(r) for r in once[0].collect()]


def test_clip_metadata_precedence(spark):
    clips = spark.createDataFrame([("2024-02-03_pull_up_2", dt.datetime(2023, 1, 1)), ("other", dt.datetime(2023, 1, 1)), ("side", dt.datetime(2023, 1, 1))], "video string, modificationTime timestamp")
    sidecar = spark.createDataFrame([("side", "2022-02-02", "dip", 4)], "video string, session_id string, exercise string, set_index int")
    got = {r.video: tuple(r)[1:] for r in longitudinal.clip_metadata(clips, sidecar).collect()}
    assert got == {"2024-02-03_pull_up_2": ("2024-02-03", "pull_up", 2), "other": ("2023-01-01", None, 1), "side": ("2022-02-02", "dip", 4)}


def test_rep_scores(spark):
    rows = [(True, 0.9, 0.8, 0.5, 0.0), (False, 0.9, 0.8, 0.5, 0.0), (True, 0.2, 0.8, 0.5, 0.0), (True, 0.9, None, 0.5, 0.0), (True, 0.9, 0.5, None, 0.25)]
    df = spark.createDataFrame(rows, "plausible boolean, quality double, range double, evenness double, penalty double")
    got = [(r.score, r.refusal, r.complete) for r in quality.rep_scores(df, {"range": 0.6, "evenness": 0.4}).collect()]
    assert got == [(68, None, True), (None, "implausible", False), (None, "low_quality", False), (None, "range_missing", False), (38, None, False)]


def test_degradation_and_ceiling(spark):
    rows = [("s", i, 90 - 3 * i, 1.0 if i < 3 else 0.5) for i in range(9)]
    df = spark.createDataFrame(rows, "set string, rep_index int, score int, range double")
    r = quality.degradation(df, ["set"], 5).first()
    assert r.rho == pytest.approx(-1) and r.degrades
    c = quality.ceiling(df, ["range"], ["set"]).first()
    assert (c.distinct, c.span) == (2, 0.5) and c.at_ceiling == pytest.approx(1 / 3)


def test_folds_keep_owners_together(spark):
    df = spark.createDataFrame([(f"c{i // 3}", i % 3, "ab"[(i // 3) % 2]) for i in range(60)], "clip string, view int, y string")
    got = evaluation.folds(df, "clip", "y", 5)
    assert got.groupBy("clip").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert got.groupBy("y", "fold").count().filter("count <> 6").count() == 0


def test_clip_verdicts(spark):
    rows = [("c", r, "e", s) for r, s in enumerate(["observed", "observed", "not_observed"])] + [("d", 0, "e", "unobservable"), ("f", 0, "e", "observed")]
    df = spark.createDataFrame(rows, "clip string, rep int, error string, status string")
    assert {r.clip: r.verdict for r in evaluation.clip_verdicts(df, ["clip"]).collect()} == {"c": "present", "d": "unclear", "f": "present"}


def test_model(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(t), i % 5) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y int, fold int")
    got = model.predicted(df, "x", kernels.train_mlp(x, y, 2), ["neg", "pos"]).toPandas()
    assert ((got.label == "pos") == (got.y == 1)).mean() > 0.95 and (got.margin >= 0).all()
    assert model.out_of_fold(df, "x", "y", "fold", [(8, 0)]).first().accuracy > 0.85


def test_azimuth_interval(spark):
    rng = np.random.default_rng(1)
    rows = [("v", float(0.4 * np.sin(np.radians(30)) + e)) for e in rng.normal(0, 0.005, 50)] + [("few", 0.1)]
    got = {r.video: r for r in model.azimuths(spark.createDataFrame(rows, "video string, ratio double"), 0.4).collect()}
    assert got["v"].low < 30 < got["v"].high and got["few"].azimuth is None
