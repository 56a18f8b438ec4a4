"""Pose geometry, kernels, sources and streaming on synthetic data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions import arrays, dates, num, text
from kinelake.operators import aggregates, graph, jobs, kernels, listings, pose, relational, rules, sequences
from kinelake.sources import synthetic, tables
from kinelake.streaming import jobs as streams


@pytest.fixture(scope="module")
def clips(spark):
    plan = [("side", 1, 3, 10.0, None), ("front", 2, 3, 85.0, None), ("shallow", 3, 3, 10.0, "shallow")]
    return synthetic.generate(spark, plan).cache()


def test_wide_and_long_are_inverse(spark, clips):
    back = tables.long(tables.wide(clips))
    assert back.count() == clips.count()
    assert back.join(clips, ["video", "frame", "joint", "x", "y", "c"], "left_anti").count() == 0


def test_normalised_puts_the_hips_at_the_origin(spark, clips):
    rows = pose.normalised(tables.wide(clips)).select(((F.col("n_left_hip_x") + F.col("n_right_hip_x")) / 2).alias("x"), "torso").toPandas()
    assert np.abs(rows.x).max() < 1e-9 and (rows.torso > 50).all()


def test_depth_is_measured_and_the_fault_shows(spark, clips):
    frames = tables.wide(clips)
    knee = frames.select("video", "frame", pose.both_sides(("hip", "knee", "ankle")).alias("knee"))
    least = {r.video: r.least for r in knee.groupBy("video").agg(F.min("knee").alias("least")).collect()}
    assert least["side"] < least["shallow"] - 10


def test_angle_refuses_unseen_and_degenerate_joints(spark):
    row = {f"{j}_{k}": 0.0 for j in ("a", "b", "c") for k in "xyc"} | {"a_x": 1.0, "c_y": 1.0, "a_c": 0.9, "b_c": 0.9, "c_c": 0.9}
    df = spark.createDataFrame([row, row | {"a_c": 0.1}, row | {"a_x": 0.0}])
    got = [r[0] for r in df.select(pose.angle("a", "b", "c")).collect()]
    assert got[0] == pytest.approx(90) and got[1] is None and got[2] is None


def test_camera_side_and_bins(spark, clips):
    side = {r.video: r.side for r in pose.camera_side(tables.wide(clips)).collect()}
    assert side["front"] in ("left", "right")
    bins = spark.createDataFrame([(10.0, 5.0, 15.0), (19.0, 10.0, 40.0), (80.0, 70.0, 90.0)], "t double, lo double, hi double")
    assert [r[0] for r in bins.select(pose.settled_bin(F.col("t"), F.col("lo"), F.col("hi"))).collect()] == ["SAGITTAL", "UNKNOWN", "FRONTAL"]


def test_segments_survive_mirroring_and_scale(spark, clips):
    frames = tables.wide(clips).withColumn("value", (F.col("left_hip_y") + F.col("right_hip_y")) / 2 / 100).withColumn("confidence", F.lit(0.9)).withColumn("active", F.lit(True))
    found = kernels.segmented(frames.select("video", "frame", "value", "confidence", "active")).filter("reason is null")
    assert {r.video: r["count"] for r in found.groupBy("video").count().collect()} == {"side": 3, "front": 3, "shallow": 3}
    twice = pose.mirrored(pose.mirrored(clips))
    assert twice.exceptAll(clips.select(twice.columns)).count() == 0


def test_silence_has_no_repetition():
    noise = np.random.default_rng(0).normal(0, 0.01, 300)
    value, valid = kernels.cleaned(noise, np.full(300, 0.9))
    assert not [r for r in kernels.repetitions(value, valid, np.ones(300, bool), 30.0) if r["reason"] is None]


def test_smoothing_keeps_parabolas_and_gaps_are_filled():
    x = np.arange(60.0)
    assert kernels.smoothed(x * x - 3 * x, 9) == pytest.approx(x * x - 3 * x)
    assert kernels.gaps_filled(np.array([0, 9.0, 9.0, 6.0]), np.array([True, False, False, True])).tolist() == [0, 2, 4, 6]


def test_prominence_by_brute_force():
    rng = np.random.default_rng(1)
    s = rng.normal(size=200)
    at = kernels.peaks(s, 0.0, 1)
    for p, got in zip(at, kernels.prominences(s, at), strict=True):
        a = next((i for i in range(p, -1, -1) if s[i] > s[p]), -1)
        b = next((i for i in range(p, 200) if s[i] > s[p]), 200)
        assert got == pytest.approx(s[p] - max(s[a + 1 : p + 1].min(), s[p:b].min()))


def test_warping():
    a = np.c_[np.sin(np.linspace(0, 3, 30)), np.zeros(30)]
    path, cost = kernels.warping_path(a, a)
    assert cost == 0 and path == [(i, i) for i in range(30)]
    slow = kernels.resampled(a, 36)
    assert np.abs(kernels.aligned(slow, a) - a).max() < 0.1
    assert kernels.medoid([a, a + 0.1, a + 5]) in (0, 1)


def test_leave_one_out_flags_the_odd_one(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(7):
        t = np.linspace(0, 3, 40)
        s = np.c_[np.sin(t) * (2.0 if i == 6 else 1.0), np.cos(t)] + rng.normal(0, 0.01, (40, 2))
        rows.append(("g", i, f"s{i % 2}", s.ravel().tolist()))
    df = spark.createDataFrame(rows, "group string, member long, session string, values array<double>")
    got = kernels.scored(df, 32).toPandas().sort_values("member")
    assert got.pooled.idxmax() == got.index[got.member == 6][0]


def test_statistics_skip_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,), (float("inf"),)], "x double")
    r = df.select(num.med("x"), num.frac("x", 2), num.coverage("x"), num.deviation("x"), num.travel("x")).first()
    assert list(r) == [2.0, 0.5, 0.4, 1.0, 2.0]
    assert [x[0] for x in df.select(num.clip01("x")).collect()] == [1.0, 0.0, 1.0, 0.0, 0.0]


def test_medians_differ_as_documented(spark):
    df = spark.createDataFrame([([1, 2, 3, 10],)], "v array<int>")
    assert list(df.select(num.upper_median(F.col("v")), num.integer_median(F.col("v")), num.index_quantile(F.col("v"), 0.98)).first()) == [3, 2, 10]


def test_split_is_the_digest_modulo_five(spark):
    import hashlib

    keys = [f"clip{i}" for i in range(50)]
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", num.split_of(F.col("k")).alias("s")).collect()}
    assert all(got[k] == ("test" if int(hashlib.sha256(k.encode()).hexdigest(), 16) % 5 == 0 else "train") for k in keys)


def test_text_functions(spark):
    df = spark.createDataFrame([("Muscle-Up  ÁÉ 0.33 s", 'x {"verdict": "Agree"} y', "agree or disagree")], "a string, b string, c string")
    words = ["agree", "disagree"]
    r = df.select(text.slug("a"), text.plain(F.col("a")), text.localized_number(F.col("a")), text.numbers_in(F.col("a")), text.verdict(text.json_object(F.col("b")), words), text.verdict(F.col("c"), words), text.code(F.col("a"))).first()
    assert list(r) == ["muscle_up_0_33_s", "muscle-up  ae 0.33 s", "Muscle-Up  ÁÉ 0,33 s", [0.33], "agree", None, "MUSCLEUPÁÉ033S"]
    t = spark.createDataFrame([("Only 3 of 10 frames were seen.",), ("Nothing",)], "x string").select(text.template(F.col("x"), [("seen", "Only {num} of {num} frames were seen")]).alias("t")).collect()
    assert t[0].t.code == "seen" and t[0].t.params == ["3", "10"] and t[1].t is None


def test_dates_and_arrays(spark):
    df = spark.createDataFrame([("2024-03-01", "2024-01-01T00:00:00Z", [0.0, 1.0, 4.0])], "d string, s string, v array<double>")
    r = df.select(dates.shift(F.col("d"), -1), dates.age_minutes(F.col("s"), F.lit("2024-01-01 01:30:00").cast("timestamp")), arrays.resampled(F.col("v"), 5), arrays.l2(F.col("v"), F.col("v")), arrays.spaced(F.col("v"), 2)).first()
    assert list(r) == ["2024-02-29", 90.0, [0.0, 0.5, 1.0, 2.5, 4.0], 0.0, [0.0, 4.0]]
    assert df.select(dates.age_minutes(F.lit("no date"), F.current_timestamp())).first()[0] is None
    p = df.select(arrays.softmax(F.col("v"))).first()[0]
    assert sum(p) == pytest.approx(1) and p[2] == max(p)


def test_fill_and_moving_polynomial(spark):
    df = spark.createDataFrame([("c", i, None if i in (3, 4) else float(i * i)) for i in range(1, 30)], "clip string, frame int, v double")
    got = {r.frame: r.f for r in sequences.filled(df, ["clip"], "frame", "v", "f").collect()}
    assert got[3] == pytest.approx(4 + 21 / 3) and got[29] == 841
    full = spark.createDataFrame([("c", i, float(i * i)) for i in range(1, 30)], "clip string, frame int, v double")
    got = {r.frame: r.s for r in sequences.moving_polynomial(full, ["clip"], "frame", "v", 3, "s").collect()}
    assert got[10] == pytest.approx(100) and got[20] == pytest.approx(400)


def test_knowability_and_bands(spark):
    df = spark.createDataFrame([(None, 1.0, 9, True), (1.0, 0.5, 9, True), (1.0, 1.0, 9, False), (1.0, 1.0, 9, True)], "v double, c double, n int, s boolean")
    assert [r[0] for r in df.select(rules.knowability(F.col("v"), F.col("c"), F.col("n"), F.col("s"))).collect()] == ["unmeasured", "unmeasured", "view_blocked", "measured"]


def test_registry_and_variants(spark):
    found = rules.registry(spark).toPandas().set_index("rule")
    assert len(found) == 55 and found.index.is_unique
    assert (found.loc["dip.excessive_depth", "threshold"], found.loc["dip.excessive_depth", "comparison"]) == (90.0, "<")
    assert set(found[found.error == "lift_stall"].phase) == {"lifting"}
    assert found.loc["pull_up.incomplete_lockout", "threshold"] == -27.6
    df = spark.createDataFrame([("pull_up", " Strict"), ("pull_up", "tuck"), ("dip", "strict"), ("planche", None)], "m string, d string")
    assert [r[0] for r in df.select(rules.declared_variant(F.col("m"), F.col("d"))).collect()] == ["strict", "unspecified", "unspecified", "unspecified"]


def test_cycles_end_and_are_reported(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "x")], "node string, requires string")
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    found = graph.faults(nodes, edges, graph.closure(edges)).collect()
    assert {(r.node, r.fault) for r in found} == {("a", "cycle"), ("b", "cycle"), ("d", "dangling")}


def test_long_chains_and_trees_end(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(70)], "node string, requires string")
    far = graph.closure(edges).filter("node = 'n00'").agg({"depth": "max"}).first()[0]
    assert far == 70
    nodes = spark.createDataFrame([(f"q{i}", "y", f"q{i + 1}") for i in range(12)], "node string, answer string, target string")
    answers = spark.createDataFrame([(1, f"q{i}", "y") for i in range(12)] + [(2, "q0", "n")], "subject int, node string, answer string")
    got = {r.subject: (r.node, len(r.path)) for r in graph.walked(nodes, answers, "q0").collect()}
    assert got == {1: ("q12", 13), 2: ("q0", 1)}
    with pytest.raises(ValueError):
        graph.walked(spark.createDataFrame([("a", "y", "a")], nodes.schema), spark.createDataFrame([(1, "a", "y")], answers.schema), "a")


def test_plan_walks_up_the_tiers(spark):
    edges = spark.createDataFrame([("dip", "push"), ("ring dip", "dip"), ("muscle up", "ring dip"), ("muscle up", "pull")], "node string, requires string")
    nodes = spark.createDataFrame([(n,) for n in ("push", "dip", "ring dip", "pull", "muscle up")], "node string")
    paths = graph.closure(edges)
    state = graph.states(nodes, edges, paths, nodes.filter("node = 'dip'"), nodes.limit(0))
    got = [(r.week, r.node) for r in graph.plan("muscle up", graph.tiers(nodes, paths), paths, state).orderBy("week").collect()]
    assert got == [(1, "pull"), (2, "ring dip"), (3, "muscle up")]


def test_sweep_by_brute_force(spark):
    rng = random.Random(0)
    rows = [("r", float(rng.randrange(10)), rng.randrange(2)) for _ in range(60)]
    got = aggregates.threshold_sweep(spark.createDataFrame(rows, "rule string, v double, y int"), ["rule"], "v", "y").collect()
    for r in got:
        assert r.tp == sum(v > r.threshold and y for _, v, y in rows) and r.fp == sum(v > r.threshold and not y for _, v, y in rows)


def test_level_ladder(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (399,), (400,), (999,), (1000,), (1799,), (1800,)], "t long").select(aggregates.experience_level(F.col("t"))).collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4]


def test_percentile_against_null(spark):
    null = [1.0, 2.0, 2.0, 5.0]
    got = aggregates.percentile_against(spark.createDataFrame([("g", 2.0), ("g", 9.0)], "g string, v double"), spark.createDataFrame([("g", x) for x in null], "g string, n double"), ["g"], "v", "n").collect()
    assert {r.v: r.percentile for r in got} == {2.0: 50.0, 9.0: 100.0}


def test_file_index(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"one")
    (tmp_path / "b.mp4").write_bytes(b"one")
    (tmp_path / "c.txt").write_bytes(b"no")
    listing = tables.files(spark, str(tmp_path), ["mp4", "mov"])
    assert listing.count() == 2 and listing.select("content_key").distinct().count() == 1
    before = listing.filter(F.endswith("path", F.lit("a.mp4"))).withColumn("length", F.lit(99).cast("long"))
    assert {r.state for r in tables.indexed(listing, before).collect()} == {"added", "changed"}
    with pytest.raises(tables.MissingArtefact):
        tables.required(spark, str(tmp_path / "none"), "ingest")


def test_json_sink_has_no_nan(spark, tmp_path):
    tables.write_json_lines(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "i int, x double"), str(tmp_path / "out"))
    got = {r.i: r.x for r in tables.read_json_lines(spark, str(tmp_path / "out"), "i int, x double").collect()}
    assert got == {1: None, 2: 0.5}


def test_streams_match_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), events.schema)
    q = streams.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.groupBy(F.col("ts").cast("date").alias("d"), "event_type").count().count()
    assert spark.table("counts").count() == want
    q = streams.job_states(stream, ["click", "view"]).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("states").select("user_id").distinct().count() == events.select("user_id").distinct().count()


def test_replaced_and_charges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, relational.replaced(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]
    ledger = spark.createDataFrame([("o", 1, 1), ("o", 2, -1), ("o", 3, -1)], "owner string, at int, d int")
    assert [r.accepted for r in jobs.accepted_charges(ledger, "owner", ["at"], "d").orderBy("at").collect()] == [True, True, False]
    assert math.isclose(1.0, 1.0)


def test_first_spans_by_brute_force_with_repeated_points(spark):
    rng = random.Random(5)
    spans = [(g, lo, lo + rng.randrange(-2, 40)) for g in "ab" for lo in (rng.randrange(200) for _ in range(25))]
    points = [(g, rng.randrange(-5, 260), i) for g in "abc" for i in range(60)] + [("a", 7, 900), ("a", 7, 901)]
    got = relational.in_first_span(spark.createDataFrame(points, "g string, p int, i int"), spark.createDataFrame(spans, "g string, lo int, hi int"), ["g"], "p", "lo", "hi").collect()
    assert len(got) == len(points)
    for r in got:
        held = [(lo, hi) for g, lo, hi in spans if g == r.g and lo <= r.p <= hi]
        assert r.lo == min((lo for lo, _ in held), default=None)
        assert (r.lo, r.hi) in held if held else r.hi is None


def golden_clip(fps=30.0):
    """Two sets with a walk between: 3 deep and 2 shallow repetitions, and one lost turn."""
    t = np.arange(60) / 60
    rep = lambda h: h * (0.5 - 0.5 * np.cos(2 * np.pi * t))
    signal = np.concatenate([rep(1.0)] * 3 + [np.linspace(0, 3, 60), np.linspace(3, 0, 60)] + [rep(0.4)] * 2 + [rep(1.0)])
    active = np.ones(len(signal), bool)
    active[180:300] = False
    valid = np.ones(len(signal), bool)
    valid[440:460] = False
    return signal, valid, active


def test_segmentation_of_a_golden_clip():
    signal, valid, active = golden_clip()
    found = kernels.repetitions(signal, valid, active, 30.0)
    good = [(r["start"], r["turn"], r["end"]) for r in found if r["reason"] is None]
    assert [t for _, t, _ in good] == [30, 90, 150]
    assert all(e - s >= 55 for s, _, e in good)
    # the second span has its own amplitude, set by its observed frames
    spans = kernels.spans_of(signal, valid, active, 0.15)
    assert [(a, b) for a, b, _, _ in spans] == [(0, 179), (300, len(signal) - 1)]
    assert {r["reason"] for r in found if r["start"] >= 300} <= {"turn_unobserved", "shallow", None}
    # with the shallow set alone, its repetitions are found
    only = active.copy()
    only[420:] = False
    shallow = [r["turn"] for r in kernels.repetitions(signal, valid, only, 30.0) if r["reason"] is None and r["turn"] >= 300]
    assert shallow == [330, 390]


def test_boundaries_walk_on_while_the_signal_falls():
    signal = np.array([0.2, 0.0, 0.1, 0.5, 1.0, 0.5, 0.2, 0.1, 0.3])
    assert kernels.boundary(signal, 4, -1, (0, 8), 0.3, 100) == 1
    assert kernels.boundary(signal, 4, 1, (0, 8), 0.3, 100) == 7
    assert kernels.boundary(signal, 4, 1, (0, 6), 0.3, 100) == 6
    assert kernels.boundary(signal, 4, 1, (0, 8), 0.3, 1) == 5


def test_running_sums_and_quantiles_by_brute_force(spark):
    rng = random.Random(7)
    rows = [(g, float(rng.randrange(40))) for g in ("a", "b", None) for _ in range({"a": 200, "b": 7, None: 30}[g])] + [("a", None), ("c", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in aggregates.quantiles(df, ["g"], "v", [0.25, 0.5, 0.95]).collect()}
    for g in ("a", "b", "c", None):
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g].n == len(v)
        assert [got[g].q0, got[g].q1, got[g].q2] == pytest.approx(np.percentile(v, [25, 50, 95]))
    for r in aggregates.mid_rank_percentile(df, ["g"], "v").collect():
        v = np.array([x for k, x in rows if k == r.g and x is not None])
        assert r.percentile is None if r.v is None else r.percentile == pytest.approx(100 * ((v < r.v).sum() + 0.5 * (v == r.v).sum()) / len(v))


def test_spans_of_very_different_widths(spark):
    r = random.Random(3)
    spans = [(g, a, a + w) for g in (1, 2) for a, w in [(r.randint(-500, 500), r.choice([-1, 0, 1, 7, 300])) for _ in range(40)]] + [(1, -(10**12), 10**12), (3, 5, 5)]
    points = [(g, x) for g in (1, 2, 3, 4) for x in range(-520, 820, 3)] + [(1, 10**12), (1, 10**12 + 1), (3, 5), (3, 5)]
    got = relational.in_first_span(spark.createDataFrame(points, "g int, x long"), spark.createDataFrame(spans, "g int, lo long, hi long"), ["g"], "x", "lo", "hi")
    want = []
    for g, x in points:
        hit = min(((lo, hi) for k, lo, hi in spans if k == g and lo <= x <= hi), default=(None, None), key=lambda s: s[0])
        want.append((g, x, hit[0]))
    assert sorted(map(str, ((q["g"], q["x"], q["lo"]) for q in got.collect()))) == sorted(map(str, want))


def test_upper_medians_and_first_missing_keys_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", None), (None, 4.0), ("c", 1.0), ("c", 5.0)], "g string, v double")
    assert {r["g"]: r["upper_median"] for r in aggregates.upper_medians(rows, ["g"], "v").collect()} == {"a": 2.0, "b": None, None: 4.0, "c": 5.0}
    ledger = spark.createDataFrame([(k, "x" if k % 2 else None) for k in range(10)] + [(None, "x"), (3, "x")], "k int, g string")
    got = {r["g"]: (r["present"], r["missing"], r["first_missing"]) for r in listings.audited(ledger, spark.createDataFrame([(1,), (0,), (2,), (4,), (6,), (8,)], "k int"), "k", ["g"], 2).collect()}
    assert got == {"x": (1, 6, [3, 5]), None: (5, 0, [])}
