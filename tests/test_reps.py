import pytest
from pyspark.sql import functions as F

from kinelake.operators import reps


def test_tempo_phases_and_moments(spark):
    df = spark.createDataFrame([("r", "v", 0, 31, 91, 30.0)], "rep_id string, video string, start_frame int, turn_frame int, end_frame int, fps double")
    r = reps.tempo(df).first()
    assert (r.first_s, r.tempo_ratio) == (1.0, pytest.approx(59 / 30))
    assert [x.moment for x in reps.moments(df).collect()] == ["start", "first_half", "turn", "second_half", "end"]
    t = spark.range(10).select(reps.phase_of(F.col("id"), F.lit(4), 10).alias("p")).collect()
    assert [x.p for x in t] == ["ecc_1", "ecc_1", "ecc_2", "ecc_3", "con_1", "con_1", "con_2", "con_2", "con_3", "con_3"]
    assert df.select(reps.turn_index(F.col("start_frame"), F.col("turn_frame"), F.col("end_frame"), 100)).first()[0] == 34


def test_shortest_phase_wins(spark):
    spans = spark.createDataFrame([("r", "rep", 0, 90), ("r", "lift", 0, 30)], "rep_id string, phase string, a int, b int")
    points = spark.createDataFrame([("r", 10), ("r", 60), ("r", 99)], "rep_id string, frame int")
    assert {x.frame: x.phase for x in reps.shortest_phase(points, spans, "none").collect()} == {10: "lift", 60: "rep", 99: "none"}


def test_weights_sum_to_one(spark):
    frames = spark.createDataFrame([("k", "hip", 0.9), ("k", "knee", 0.3)], "key string, joint string, c double")
    got = reps.joint_weights(frames, frames.select("joint", "c"), "key").collect()
    assert sum(r.weight for r in got) == pytest.approx(1) and max(got, key=lambda r: r.weight).joint == "hip"


def test_invented_numbers(spark):
    texts = spark.createDataFrame([("k", "3 reps, 0,33 s and 12.5 degrees, 47 of them")], "key string, text string")
    facts = spark.createDataFrame([("k", 0.333), ("k", 12.46)], "key string, fact double")
    assert {r.raw for r in reps.invented_numbers(texts, facts, "key").collect()} == {"47"}


def test_windows_and_parked(spark):
    rows = spark.createDataFrame([("1", "9", 10.0), ("x", "9", 10.0), ("0", "10", 10.0)], "start string, end string, duration double")
    assert [r.usable for r in reps.clamped_windows(rows).collect()] == [True, False, False]
    points = spark.createDataFrame([("c", float(v)) for v in (0, 0, 0, 0, 0, 5)], "clip string, v double")
    assert reps.parked(points, "clip", "v").first().parked == pytest.approx(5 / 6)
