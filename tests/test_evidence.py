"""Measures and evidence of repetitions against plain numpy over the same frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import evidence, rules
from kinelake.sources.tables import JOINTS

FPS = 30.0


def clip(movement, frames=90, missing=()):
    """Joints of one moving body: rows of frame, joint -> (x, y, c)."""
    rng = np.random.default_rng(len(movement))
    t = np.arange(frames)
    wave = 0.5 - 0.5 * np.cos(2 * np.pi * t / frames)
    points = {}
    for k, joint in enumerate(JOINTS):
        side = -1 if joint.startswith("left") else 1
        part = joint.split("_")[-1]
        height = {"shoulder": 100, "elbow": 60, "wrist": 20, "hip": 0, "knee": -80, "ankle": -160}.get(part, 130)
        y = 300 - height + (0 if part in ("wrist", "ankle") else 50 * wave) + rng.normal(0, 0.4, frames)
        x = 200 + side * 20 + (6 * wave * side if part == "knee" else 0) + rng.normal(0, 0.4, frames)
        c = np.full(frames, 0.9)
        c[list(missing)] = 0.1
        points[joint] = (x, y, c)
    return points


@pytest.fixture(scope="module")
def made(spark):
    clips = {"dip": clip("dip"), "squat": clip("squat"), "pull_up": clip("pull_up", missing=range(20, 80)), "split_squat": clip("split_squat"), "muscle_up": clip("muscle_up")}
    rows, reps = [], []
    for name, points in clips.items():
        for f in range(90):
            rows.append((name, f, *[float(v[f]) for j in JOINTS for v in points[j]], f % 7 != 0))
        reps.append((f"{name}-1", name, name, 5, 45, 80, FPS, "SAGITTAL" if name == "squat" else None))
    schema = "video string, frame int, " + ", ".join(f"{j}_{k} double" for j in JOINTS for k in "xyc") + ", valid boolean"
    frames = spark.createDataFrame(rows, schema)
    reps = spark.createDataFrame(reps, "rep_id string, video string, movement string, start_frame int, turn_frame int, end_frame int, fps double, view string")
    return clips, frames.persist(), reps


def mid(points, joint):
    (ax, ay, ac), (bx, by, bc) = points[f"left_{joint}"], points[f"right_{joint}"]
    return (ax + bx) / 2, (ay + by) / 2, np.minimum(ac, bc)


def torso_of(points):
    (sx, sy, _), (hx, hy, _) = mid(points, "shoulder"), mid(points, "hip")
    ok = np.mean([points[j][2] for j in evidence.BODY], axis=0) >= 0.5
    return np.median(np.hypot(sx - hx, sy - hy)[ok])


def test_windows_of_phases(spark, made):
    _, _, reps = made
    got = {(r.rep_id, r.phase): (r.a, r.b) for r in evidence.phase_table(reps).collect()}
    assert got["dip-1", "lowering"] == (5, 45) and got["dip-1", "lifting"] == (45, 80)
    assert got["pull_up-1", "lifting"] == (5, 45) and got["pull_up-1", "lowering"] == (45, 80)
    assert got["dip-1", "setup"] == got["dip-1", "support"] == (5, 8) and got["dip-1", "turnaround"] == (42, 48)
    assert got["pull_up-1", "support"] == (42, 48) and ("pull_up-1", "turnaround") not in got
    assert got["muscle_up-1", "transition"] == (5, 45) and ("dip-1", "transition") not in got


def test_measures_against_numpy(made):
    clips, frames, reps = made
    got = {r.rep_id: r for r in evidence.rep_metrics(frames, reps).collect()}
    assert len(got) == 5
    for name, points in clips.items():
        r, torso = got[f"{name}-1"], torso_of(points)
        wrist, down = name in evidence.WRIST_ORIGIN, name in evidence.DESCENDING
        ox, oy, oc = mid(points, "wrist" if wrist else "hip")
        above = ((oy - mid(points, "shoulder")[1]) / torso)[5:81]
        lateral = ((mid(points, "hip")[0] - ox) / torso)[5:81]
        tilt = np.abs(points["left_shoulder"][1] - points["right_shoulder"][1]) / torso
        lift = slice(45, 81) if down else slice(5, 46)
        conc, ecc = ((35, 40) if down else (40, 35))
        assert r.concentric_s == pytest.approx(conc / FPS) and r.tempo_ratio == pytest.approx(ecc / conc) and r.total_s == pytest.approx(75 / FPS)
        assert r.rom == pytest.approx(above.max() - above[0]) and r.start_depth == pytest.approx(-above[0])
        assert r.top_hold_s == pytest.approx((above >= above[0] + 0.85 * (above.max() - above[0])).sum() / FPS)
        assert r.swing == pytest.approx(np.percentile(lateral, 95) - np.percentile(lateral, 5), abs=1e-9)
        assert r.shoulder_asymmetry == pytest.approx(np.median(tilt[lift])) and r.turn_asymmetry == pytest.approx(tilt[45])
        conf = np.minimum(oc, mid(points, "shoulder")[2])[5:81]
        assert r.mean_conf == pytest.approx(conf.mean()) and r.observed_frac == pytest.approx((conf >= 0.35).mean())
        if name == "muscle_up":
            full = (oy - mid(points, "shoulder")[1]) / torso
            assert r.transition_s == pytest.approx((np.abs(full[lift]) <= 0.15).sum() / FPS)
        else:
            assert r.transition_s is None


def angle(a, b, c):
    u, v = a - b, c - b
    return math.degrees(math.acos(np.clip(u @ v / np.hypot(*u) / np.hypot(*v), -1, 1)))


def test_evidence_against_numpy(made):
    clips, frames, reps = made
    rows = {(r.rep_id, r.primitive): r for r in evidence.rep_evidence(frames, reps).collect()}
    assert len(rows) == 5 * len(evidence.evidence_cells())
    valid = np.array([f % 7 != 0 for f in range(90)])
    for name, points in clips.items():
        get = lambda p: rows[f"{name}-1", p]  # noqa: E731,B023
        torso = torso_of(points)
        at = lambda j, f: np.array([points[j][0][f], points[j][1][f]])  # noqa: E731,B023
        ok = points["left_hip"][2] >= 0.5
        elbow = np.array([np.mean([angle(at(f"{s}_shoulder", f), at(f"{s}_elbow", f), at(f"{s}_wrist", f)) for s in ("left", "right")]) if ok[f] else np.nan for f in range(90)])
        assert get("start_elbow_deg").value == pytest.approx(np.nanmedian(elbow[5:9]))
        stand = np.where(ok, (mid(points, "ankle")[1] - mid(points, "hip")[1]) / torso, np.nan)[5:81]
        depth = np.nanpercentile(stand, 90) - np.nanpercentile(stand, 5)
        assert get("squat_depth").value == pytest.approx(depth)
        assert get("squat_depth").coverage == pytest.approx(np.isfinite(stand).mean())
        valgus = []
        for s in ("left", "right"):
            d = np.abs(points[f"{s}_knee"][0] - (points[f"{s}_hip"][0] + points[f"{s}_ankle"][0]) / 2) / torso
            valgus.append(np.percentile(d[5:81][ok[5:81]], 90))
        assert get("knee_valgus").value == pytest.approx(max(valgus))
        rise = [(np.percentile(y, 90) - np.percentile(y, 5)) / torso for s in ("left", "right") for y in [points[f"{s}_ankle"][1][5:81][ok[5:81]]]]
        assert get("heel_rise").value == pytest.approx(max(rise))
        assert get("travel").coverage == pytest.approx(valid[5:81].mean())
        wrist = name in evidence.WRIST_ORIGIN
        assert (get("swing").value is not None) == wrist and (get("swing").state == "measured") == wrist
        assert (get("split_depth").value is not None) == (name == "split_squat")
        down = name in evidence.DESCENDING
        oy = mid(points, "wrist" if wrist else "hip")[1]
        signal = (oy - mid(points, "shoulder")[1]) / torso
        speed = np.abs(np.diff(signal)) * FPS
        assert get("turn_speed").value == pytest.approx(speed[45 - 4 : 45 + 4].min())
        seg = (-signal if down else signal)[slice(45, 81) if down else slice(5, 46)]
        total = seg[-1] - seg[0]
        if total > 1e-9:
            middle = ((seg[:-1] + seg[1:]) / 2 - seg[0]) / total
            want = np.mean((middle > 0.1) & (middle < 0.9) & (np.diff(seg) < 0.2 * total / (len(seg) - 1)))
            assert get("stalled_frac").value == pytest.approx(want)
        else:
            assert get("stalled_frac").value is None
    assert rows["squat-1", "hip_sag"].state == "measured" and rows["squat-1", "knee_valgus"].state == "view_blocked"
    assert rows["pull_up-1", "squat_depth"].reason == "too little of the phase seen"
    assert rows["dip-1", "transition_s"].reason == "not applicable"
    assert rows["dip-1", "fast_ratio"].value == pytest.approx(1.0)


def test_rules_read_the_evidence(spark, made):
    _, frames, reps = made
    found = evidence.rep_evidence(frames, reps)
    subjects = reps.select("rep_id", "movement", F.lit(None).cast("string").alias("variant"), F.lit(False).alias("blocked"))
    verdicts = rules.assessed(subjects, rules.registry(spark), found, ["rep_id"])
    by_rule = {(r.rep_id, r.rule): r for r in verdicts.collect()}
    assert by_rule["dip-1", "dip.excessive_depth"].status in ("observed", "not_observed")
    assert by_rule["squat-1", "squat.knee_medial_drift"].status == "unobservable"
    assert by_rule["squat-1", "squat.knee_medial_drift"].reason == "view_blocked"
    assert {r.movement for r in by_rule.values()} == {"dip", "squat", "pull_up", "split_squat", "muscle_up"}
