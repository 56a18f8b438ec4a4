"""Clip features, least-travelled windows and the movement decision list."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import clip_features as cf
from kinelake.operators import decision_list as dl
from kinelake.sources.tables import JOINTS


def spread(values):
    return float(np.percentile(values, 95) - np.percentile(values, 5))


def brute_travel(x, y, ok):
    x, y = np.array(x)[ok], np.array(y)[ok]
    return math.hypot(spread(x), spread(y)) if len(x) >= 5 else math.inf


@pytest.mark.parametrize("seed", range(12))
def test_sliding_windows_equal_a_recomputation_per_start(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 4, 14, 15, 16, 40, 90])
    width = rng.choice([15, 20, 31])
    # few values, so that equal travels are frequent
    x, y = ([rng.choice([0.0, 0.1, 0.5, 2.0]) for _ in range(n)] for _ in "xy")
    ok = [rng.random() < 0.7 for _ in range(n)]
    best, spans = cf.still_windows(x, y, ok, width)
    if n <= width:
        want = (brute_travel(x, y, ok), sum(ok) / n, 0, n - 1)
    else:
        want = (math.inf, 0.0, 0, width - 1)
        for a in range(0, n - width + 1, 5):
            part = slice(a, a + width)
            travel, share = brute_travel(x[part], y[part], ok[part]), sum(ok[part]) / width
            if share >= 0.4 and travel < want[0]:
                want = (travel, share, a, a + width - 1)
    assert best == pytest.approx(want)
    mask = np.zeros(n, bool)
    for a in range(0, max(n - width, 0) + 1, max(1, width // 10)):
        part = slice(a, a + width)
        if np.mean(ok[part]) >= 0.4 and brute_travel(x[part], y[part], ok[part]) <= 0.8:
            mask[part] = True
    got = np.zeros(n, bool)
    for a, b in spans:
        got[a : b + 1] = True
    assert (got == mask).all() and all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_the_first_of_equal_windows_wins_and_no_seen_window_is_infinite():
    assert cf.still_windows([1.0] * 40, [1.0] * 40, [True] * 40, 15)[0] == (0.0, 1.0, 0, 14)
    assert cf.still_windows([1.0] * 40, [1.0] * 40, [False] * 40, 15) == ((math.inf, 0.0, 0, 14), [])


def test_periodicity_of_a_wave_and_of_nothing():
    wave = np.sin(np.arange(200) * 2 * np.pi / 25)
    peak, rate = cf.periodicity(wave, 30.0)
    assert peak > 0.8 and rate == pytest.approx(30 / 25)
    assert cf.periodicity(np.ones(50), 30.0) == (0.0, None)
    assert cf.periodicity(np.ones(10), 30.0) == (None, None)
    with_gaps = np.where(np.arange(200) % 7 == 0, np.nan, wave)
    assert cf.periodicity(with_gaps, 30.0)[0] is not None


def body(frame, lift=0.0, wrist=-20.0, seen=()):
    """Joints of a standing body, y downwards; the hips sink by `lift`."""
    heights = {"nose": -130, "eye": -135, "ear": -132, "shoulder": -100, "elbow": -40, "wrist": wrist, "hip": 0, "knee": 80, "ankle": 160}
    out = {}
    for j in JOINTS:
        part, side = j.split("_")[-1], -1 if j.startswith("left") else 1
        sink = 0 if part in ("wrist", "ankle") else lift
        out |= {f"{j}_x": 200.0 + 20 * side, f"{j}_y": 300.0 + heights[part] + sink, f"{j}_c": 0.1 if part in seen else 0.9}
    return {"video": "v", "frame": frame} | out


def made(spark, frames):
    shape = "video string, frame int, " + ", ".join(f"{j}_{k} double" for j in JOINTS for k in "xyc")
    return spark.createDataFrame([tuple(f[c] for c in ["video", "frame", *[f"{j}_{k}" for j in JOINTS for k in "xyc"]]) for f in frames], shape)


def swing(n=60):
    return [30 * (1 - math.cos(i * 0.3)) for i in range(n)]


def scenes():
    drifting = [body(i, v, seen=("wrist",)) for i, v in enumerate(swing())]
    for i, f in enumerate(drifting):
        for s in ("left", "right"):
            f[f"{s}_ankle_x"] += 40 * i
    walk = [body(i, 0.0) for i in range(25)]
    for i, f in enumerate(walk):
        for j in JOINTS:
            f[f"{j}_x"] += (25 - i) * 60
    hang = [body(i, v, wrist=-190) for i, v in enumerate(swing(80))]
    return {
        "dip": [body(i, v) for i, v in enumerate(swing())],
        "feet unseen": [body(i, v, seen=("ankle",)) for i, v in enumerate(swing())],
        "pull-up": [body(i, v, wrist=-190) for i, v in enumerate(swing())],
        "muscle-up": [body(i, 110 - 2.4 * v, wrist=-70) for i, v in enumerate(swing())],
        "arms unseen": [body(i, v, seen=("wrist",)) for i, v in enumerate(swing())],
        "drifting": drifting,
        "hang": hang,
        "walk and hang": walk + hang,
        "little seen": [body(i, v, seen=("ankle", "knee", "wrist")) for i, v in enumerate(swing())],
        "short": [body(i, v) for i, v in enumerate(swing(23))],
    }


@pytest.fixture(scope="module")
def vectors(spark):
    frames = [f | {"video": name, "frame": i} for name, clip in scenes().items() for i, f in enumerate(clip)]
    return cf.clip_features(made(spark, frames), 10.0).cache()


@pytest.fixture(scope="module")
def clips(vectors):
    return {r.video: r for r in dl.decided(vectors.filter("part = 0")).collect()}


def test_hands_below_moving_shoulders_make_a_dip_and_unseen_feet_don_t(clips):
    r = clips["dip"]
    assert (r.movement, r.branch, r.runner_up, r.clear) == ("dip", "legs_below_hands", "push_up", True)
    r = clips["feet unseen"]
    assert (r.movement, r.branch, r.runner_up, r.margin) == ("unknown", "feet_unseen", "squat", 0.0)


def test_hands_overhead_split_by_the_peak(clips):
    r = clips["pull-up"]
    assert r.movement == "pull_up" and r.trace[-1].branch == "over_the_bar" and r.trace[-1].gate.startswith("shoulder_above_hands_p95")
    r = clips["muscle-up"]
    assert r.movement == "muscle_up" and r.margin == pytest.approx(0.70 + 0.28 * min(1.0, (r.shoulder_above_hands_p95 - 0.12) / 0.35))


def test_arms_that_were_not_seen_are_not_rigid(clips):
    """An unmeasured articulation must not let the squat through."""
    r = clips["arms unseen"]
    assert r.movement == "unknown" and r.arm_articulation is None
    gate = next(t for t in r.trace if t.branch == "rigid_arms")
    assert gate.gate.startswith("arm_articulation") and gate.measured is False


def test_nothing_fixed_says_why(clips):
    r = clips["drifting"]
    assert (r.branch, r.hands, r.feet) == ("nothing_fixed", "unseen", "moved")


def test_a_standing_prefix_does_not_change_the_label(clips):
    plain, long = clips["hang"], clips["walk and hang"]
    assert plain.movement == long.movement == "pull_up"
    assert long.shoulder_above_hands_p95_clip > long.shoulder_above_hands_p95


def test_sixteen_outcomes_and_a_last_branch_without_gates():
    assert len(dl.BRANCHES) == 16 and dl.BRANCHES[-1].gates == () and len({b.name for b in dl.BRANCHES}) == 16


FULL = {
    "wrist_window_travel": 0.1, "wrist_window_seen": 1.0, "ankle_window_travel": 0.1, "ankle_window_seen": 1.0, "wrist_seen": 1.0, "ankle_seen": 1.0,
    "hands_overhead_frac": 0.0, "hands_below_frac": 1.0, "body_line_deg": 5.0, "legs_lifted_frac": 0.0, "parked_frac": 0.1, "knee_over_hip": -0.8, "knee_excursion": 0.0,
    "arm_articulation": 0.5, "shoulder_above_hands_p95": 0.8, "hip_travel": 0.1, "split_ankle_heights": 0.0, "rear_raised": 0.0, "body_below_hands": 0.6,
}
CASES = [
    ({"hands_overhead_frac": 0.9, "body_line_deg": 80.0}, "horizontal_hang"),
    ({"body_line_deg": 80.0, "legs_lifted_frac": 0.5}, "horizontal_press"),
    ({"hands_overhead_frac": 0.9, "parked_frac": 0.6}, "parked"),
    ({"hands_overhead_frac": 0.9, "knee_over_hip": 0.2, "knee_excursion": 0.6}, "knees_up"),
    ({"hands_overhead_frac": 0.9}, "over_the_bar"),
    ({"hands_overhead_frac": 0.9, "shoulder_above_hands_p95": 0.1}, "below_the_bar"),
    ({"single_leg_stance": True, "hip_travel": 0.5}, "one_leg"),
    ({"split_ankle_heights": 0.3, "rear_raised": 0.3, "hip_travel": 0.5}, "rear_foot_raised"),
    ({"split_ankle_heights": 0.1, "rear_raised": 0.1, "hip_travel": 0.5}, "split_stance"),
    ({"arm_articulation": 0.1, "hip_travel": 0.5}, "rigid_arms"),
    ({"body_below_hands": None}, "body_unseen"),
    ({"ankle_window_travel": math.inf, "ankle_window_seen": 0.0, "ankle_seen": 0.1}, "feet_unseen"),
    ({"ankle_window_travel": None, "ankle_window_seen": None, "ankle_seen": None}, "feet_unseen"),
    ({}, "legs_below_hands"),
    ({"body_below_hands": 0.1}, "nothing_below_hands"),
    ({"wrist_window_travel": 2.0, "ankle_window_travel": math.inf}, "nothing_fixed"),
    ({"arm_articulation": None}, "no_branch"),
    ({"hands_overhead_frac": math.nan, "hands_below_frac": None}, "no_branch"),
]


def test_every_outcome_is_reached(spark):
    names = [*FULL, "single_leg_stance"]
    rows = [tuple([i, *[(FULL | {"single_leg_stance": False} | change)[n] for n in names]]) for i, (change, _) in enumerate(CASES)]
    shape = "i int, " + ", ".join(f"{n} double" for n in FULL) + ", single_leg_stance boolean"
    got = {r.i: r for r in dl.decided(spark.createDataFrame(rows, shape)).collect()}
    assert {i: r.branch for i, r in got.items()} == {i: b for i, (_, b) in enumerate(CASES)}
    assert {r.branch for r in got.values()} == {b.name for b in dl.BRANCHES}
    for r in got.values():
        assert r.clear == (r.margin >= 0.65) and len(r.trace) == [b.name for b in dl.BRANCHES].index(r.branch)


def test_short_bins_have_no_features_and_bins_follow_each_other(vectors):
    rows = {r.part: r for r in vectors.filter("video = 'short'").collect()}
    assert rows[0].n_frames == 23 and [rows[i].n_frames for i in (1, 2, 3)] == [None, 8, 8]
    wide = {r.video: r for r in cf.phased(vectors).collect()}["short"]
    assert wide.n_frames == 23 and wide.p1_hip_travel is None and wide.p2_n_frames == 8 and wide.p3_hip_travel is not None


def test_unseen_joints_give_null_not_zero(clips):
    r = clips["little seen"]
    for name in ("knee_min", "hinge_ratio", "hip_travel", "arm_articulation", "wrist_shoulder_dist_median", "split_ankle_heights", "hands_stacked_frac", "knee_extended_frac"):
        assert r[name] is None, name
    assert r.knee_seen == 0 and r.wrist_window_travel == math.inf and r.parked_frac == 0


def test_features_of_the_same_name_are_an_error():
    with pytest.raises(ValueError, match="n_frames"):
        cf.joined_vector({"n_frames": F.lit(1)}, {"n_frames": F.lit(2)})


def test_no_frames(spark):
    assert dl.decided(cf.clip_features(made(spark, []), 10.0)).count() == 0


def test_jobs_run_through_their_transitions_once_and_in_order(spark):
    from kinelake.operators import jobs

    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    logs = {
        "done": [(0, "created"), (5, "uploaded"), (6, "started"), (20, "stage"), (40, "finished"), (50, "refined")],
        "late": [(0, "created"), (5, "uploaded"), (6, "started"), (60, "finished")],
        "abort": [(0, "created")],
        "refused": [(0, "started"), (1, "created"), (2, "finished"), (3, "error"), (4, "uploaded")],
    }
    rows = [(job, i, e, at(m)) for job, log in logs.items() for i, (m, e) in enumerate(log)]
    rows = list(reversed(rows)) + rows[:4]  # out of order, and some twice
    events = spark.createDataFrame(rows, "job string, id int, e string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.job: r for r in jobs.job_runs(events, ["job"], ["t", "id"], "e", "t", 30, 360, F.lit("2024-01-01 20:00:00").cast("timestamp")).collect()}
    assert (got["done"].status, got["done"].applied, got["done"].refused) == ("done", 6, 0)
    # no word for 54 minutes: failed at 36, and the result that came later is refused
    assert (got["late"].status, got["late"].applied, got["late"].refused) == ("failed", 4, 1)
    assert got["late"].since.strftime("%H:%M") == "00:36"
    assert (got["abort"].status, got["abort"].since.strftime("%H:%M")) == ("aborted", "06:00")
    assert (got["refused"].status, got["refused"].applied, got["refused"].refused) == ("failed", 2, 3)
