"""Registered queries of the pose operators, with their DuckDB SQL.

Clips of a moving body are made from events: video = user_id, frame = row number by
(ts, event_id) from 0, joints by formulas of both.  Repetitions are spans of 25 frames
all along a clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators import evidence, holds, pose, reps, rules, scoring
from kinelake.plans.catalogue import _FRAMES, frames, query, rounded
from kinelake.sources.tables import BODY, JOINTS

_HEIGHT = {"shoulder": 100, "elbow": 60, "wrist": 20, "hip": 0, "knee": -80, "ankle": -160}
_STILL = ("wrist", "ankle")


def _coordinates() -> dict[str, str]:
    """SQL of each joint's columns, the same text for both engines."""
    out = {}
    for k, joint in enumerate(JOINTS, 1):
        part, side = joint.split("_")[-1], -1 if joint.startswith("left") else 1
        sway = 0 if part in _STILL else 25
        out[f"{joint}_x"] = f"200.0 + {side * 20} + 3.0 * sin(frame * 0.{10 + k}) + (event_id % {5 + k}) * 0.25"
        out[f"{joint}_y"] = f"300.0 - ({_HEIGHT.get(part, 130)}) + {sway} * (1.0 - cos(frame * 0.17)) + (event_id % {7 + k}) * 0.25"
        out[f"{joint}_c"] = f"0.4 + ((event_id * {k + 2}) % 60) / 100.0"
    return out


_COORDINATES = _coordinates()
_MOVEMENTS = ("dip", "squat", "pull_up", "muscle_up", "split_squat")
_P = "e AS (SELECT user_id AS video, event_id, frame - 1 AS frame FROM " + _FRAMES + "), p AS (SELECT video, frame, event_id % 9 <> 0 AS valid, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _COORDINATES.items()) + " FROM e)"
_R = "r AS (SELECT concat(video, '-', i) AS rep_id, video, ['" + "', '".join(_MOVEMENTS) + "'][CAST(video % 5 AS INTEGER) + 1] AS movement, CAST(25 * i AS INTEGER) AS start_frame, CAST(11 + 25 * i AS INTEGER) AS turn_frame, CAST(CASE WHEN i = k - 1 THEN top ELSE 25 * (i + 1) END AS INTEGER) AS end_frame, CAST(30 AS DOUBLE) AS fps, CASE WHEN video % 2 = 0 THEN 'SAGITTAL' END AS view FROM (SELECT video, top, k, unnest(range(0, k)) AS i FROM (SELECT video, max(frame) AS top, greatest(1, max(frame) // 25) AS k FROM p GROUP BY video HAVING max(frame) >= 14)))"


def pose_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select(F.col("user_id").alias("video"), "event_id", (F.col("frame") - 1).alias("frame"))
    return rows.select("video", "frame", (F.col("event_id") % 9 != 0).alias("valid"), *[F.expr(v).cast("double").alias(k) for k, v in _COORDINATES.items()])


def repetitions(clips: DataFrame) -> DataFrame:
    """Spans of 25 frames all along each clip of 15 or more; the last one goes on to its end."""
    rows = clips.groupBy("video").agg(F.max("frame").alias("_top")).filter("_top >= 14").withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_top") / 25)).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_i"))
    movement = F.get(F.array(*map(F.lit, _MOVEMENTS)), (F.col("video") % 5).cast("int"))
    at = lambda f: (F.lit(f) + 25 * F.col("_i")).cast("int")
    end = F.when(F.col("_i") == F.col("_k") - 1, F.col("_top").cast("int")).otherwise(at(25))
    return rows.select(F.concat(F.col("video").cast("string"), F.lit("-"), F.col("_i").cast("string")).alias("rep_id"), "video", movement.alias("movement"), at(0).alias("start_frame"), at(11).alias("turn_frame"), end.alias("end_frame"), F.lit(30.0).alias("fps"), F.when(F.col("video") % 2 == 0, "SAGITTAL").alias("view"))


def _seen(*joints: str) -> str:
    return "(" + " AND ".join(f"{j}_c >= 0.5" for j in joints) + ")"


def _angle(a: str, b: str, c: str) -> str:
    ux, uy, vx, vy = f"({a}_x - {b}_x)", f"({a}_y - {b}_y)", f"({c}_x - {b}_x)", f"({c}_y - {b}_y)"
    norm = f"(sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({vx} * {vx} + {vy} * {vy}))"
    return f"CASE WHEN {_seen(a, b, c)} AND {norm} > 0 THEN degrees(acos(greatest(-1.0, least(1.0, ({ux} * {vx} + {uy} * {vy}) / {norm})))) END"


def _either(a: str, b: str, c: str) -> str:
    left, right = (_angle(*(f"{s}_{j}" for j in (a, b, c))) for s in ("left", "right"))
    return f"coalesce(({left} + {right}) / 2, {left}, {right})"


def _mid(joint: str, k: str) -> str:
    return f"((left_{joint}_{k} + right_{joint}_{k}) / 2)"


_ANGLES = {"elbow": ("shoulder", "elbow", "wrist"), "knee": ("hip", "knee", "ankle"), "hip": ("shoulder", "hip", "knee")}
_TORSO = f"sqrt(pow({_mid('shoulder', 'x')} - {_mid('hip', 'x')}, 2) + pow({_mid('shoulder', 'y')} - {_mid('hip', 'y')}, 2))"
_FRAME_CONFIDENCE = "(" + " + ".join(f"{j}_c" for j in BODY) + ") / 12"
_CLIP = f"t AS (SELECT video, coalesce(quantile_cont(CASE WHEN {_FRAME_CONFIDENCE} >= 0.5 THEN {_TORSO} END, 0.5), quantile_cont({_TORSO}, 0.5)) AS torso FROM p WHERE {_TORSO} > 0 GROUP BY video)"


@query(f"WITH {_P} SELECT video, frame, " + ", ".join(f"round({_either(*v)}, 5) AS {k}" for k, v in _ANGLES.items()) + " FROM p")
def joint_angles(spark, sf_dir):
    rows = pose_frames(spark, sf_dir)
    return rounded(rows.select("video", "frame", *[pose.both_sides(v).alias(k) for k, v in _ANGLES.items()]), 5, *_ANGLES)


_HIPS = _seen("left_hip", "right_hip", "left_ankle", "right_ankle")
_DX, _DY = f"({_mid('ankle', 'x')} - {_mid('shoulder', 'x')})", f"({_mid('ankle', 'y')} - {_mid('shoulder', 'y')})"
_LINE = f"({_DX} * ({_mid('hip', 'y')} - {_mid('shoulder', 'y')}) - {_DY} * ({_mid('hip', 'x')} - {_mid('shoulder', 'x')})) / sqrt({_DX} * {_DX} + {_DY} * {_DY}) / torso * CASE WHEN {_DX} < 0 THEN -1 ELSE 1 END"
_TRUNK = f"degrees(atan2(abs({_mid('shoulder', 'x')} - {_mid('hip', 'x')}), greatest(abs({_mid('shoulder', 'y')} - {_mid('hip', 'y')}), 1e-6)))"


@query(f"""WITH {_P}, {_CLIP} SELECT video, frame, round(torso, 6) AS torso, round({_TORSO}, 6) AS own_torso, round({_FRAME_CONFIDENCE}, 6) AS confidence,
    CASE WHEN {_HIPS} THEN round(({_mid('ankle', 'y')} - {_mid('hip', 'y')}) / torso, 6) END AS above_ankle,
    CASE WHEN {_HIPS} THEN round((greatest(left_ankle_y, right_ankle_y) - {_mid('hip', 'y')}) / torso, 6) END AS above_lower_ankle,
    CASE WHEN {_HIPS} AND {_seen('left_shoulder', 'right_shoulder')} THEN round({_LINE}, 6) END AS line_offset,
    CASE WHEN {_seen('left_hip', 'right_hip', 'left_shoulder', 'right_shoulder')} THEN round({_TRUNK}, 6) END AS trunk FROM p JOIN t USING (video)""")
def body_lines(spark, sf_dir):
    rows = pose_frames(spark, sf_dir)
    rows = rows.join(pose.clip_torso(rows), "video")
    out = {"own_torso": pose.torso_length(), "confidence": pose.frame_confidence(), "above_ankle": pose.hip_above_ankle(F.col("torso")), "above_lower_ankle": pose.hip_above_ankle(F.col("torso"), lower=True), "line_offset": pose.hip_line_offset(F.col("torso")), "trunk": pose.body_line()}
    return rounded(rows.select("video", "frame", "torso", *[v.alias(k) for k, v in out.items()]), 6, "torso", *out)


_HX, _HY = _mid("hip", "x"), _mid("hip", "y")


@query(f"WITH {_P}, {_CLIP} SELECT video, frame, round(torso, 6) AS torso, " + ", ".join(f"round(({j}_{k} - {h}) / torso, 6) AS n_{j}_{k}" for j in BODY for k, h in (("x", _HX), ("y", _HY))) + ", " + ", ".join(f"round({j}_c, 6) AS c_{j}" for j in BODY) + " FROM p JOIN t USING (video)")
def normalised_poses(spark, sf_dir):
    out = pose.normalised(pose_frames(spark, sf_dir))
    return rounded(out, 6, *[c for c in out.columns if c not in ("video", "frame")])


def _reach(side: str) -> str:
    d = f"CASE WHEN {_seen(f'{side}_shoulder', f'{side}_wrist')} THEN sqrt(pow({side}_shoulder_x - {side}_wrist_x, 2) + pow({side}_shoulder_y - {side}_wrist_y, 2)) END"
    return f"CASE WHEN count({d}) >= 10 THEN quantile_cont({d}, 0.97) END"


_ARM = f"a AS (SELECT video, coalesce((l + r) / 2, l, r) / torso AS arm_reach FROM (SELECT video, {_reach('left')} AS l, {_reach('right')} AS r FROM p GROUP BY video) JOIN t USING (video))"
_SHOULDERS = f"CASE WHEN {_seen('left_shoulder', 'right_shoulder')} THEN left_shoulder_x - right_shoulder_x END"


@query(f"""WITH {_P}, {_CLIP}, {_ARM}, s AS (SELECT video, count({_SHOULDERS}) AS n, avg(CASE WHEN {_SHOULDERS} > 0 THEN 1.0 WHEN {_SHOULDERS} <= 0 THEN 0.0 END) AS q FROM p GROUP BY video)
    SELECT video, round(torso, 6) AS torso, round(arm_reach, 6) AS arm_reach, CASE WHEN n >= 10 AND greatest(q, 1 - q) >= 0.7 THEN CASE WHEN q >= 0.5 THEN 'left' ELSE 'right' END ELSE 'unknown' END AS side, round(greatest(q, 1 - q), 6) AS side_confidence
    FROM t JOIN a USING (video) JOIN s USING (video)""")
def clip_rulers(spark, sf_dir):
    rows = pose_frames(spark, sf_dir)
    out = pose.clip_torso(rows).join(pose.arm_reach(rows), "video").join(pose.camera_side(rows), "video")
    return rounded(out, 6, "torso", "arm_reach", "side_confidence")


def _pair(k: str) -> str:
    middle = "least(left_wrist_c, right_wrist_c)" if k == "c" else _mid("wrist", k)
    return f"CASE WHEN both_share >= 0.55 THEN {middle} WHEN left_mean >= right_mean THEN left_wrist_{k} ELSE right_wrist_{k} END"


_PAIR = f"w AS (SELECT *, {_pair('x')} AS px, {_pair('y')} AS py, {_pair('c')} AS pc FROM (SELECT *, avg(CASE WHEN left_wrist_c >= 0.5 AND right_wrist_c >= 0.5 THEN 1.0 ELSE 0.0 END) OVER v AS both_share, avg(left_wrist_c) OVER v AS left_mean, avg(right_wrist_c) OVER v AS right_mean FROM p WINDOW v AS (PARTITION BY video)))"


@query(f"WITH {_P}, {_PAIR} SELECT video, frame, round(px, 6) AS wrist_px, round(py, 6) AS wrist_py, round(pc, 6) AS wrist_pc FROM w")
def near_sides(spark, sf_dir):
    rows = pose.side_pair(pose_frames(spark, sf_dir), "wrist")
    return rounded(rows.select("video", "frame", "wrist_px", "wrist_py", "wrist_pc"), 6, "wrist_px", "wrist_py", "wrist_pc")


@query(f"""WITH {_P}, {_CLIP}, {_PAIR} SELECT video, CASE WHEN count(*) < 5 THEN CAST('inf' AS DOUBLE) ELSE round(sqrt(pow(quantile_cont(px, 0.95) - quantile_cont(px, 0.05), 2) + pow(quantile_cont(py, 0.95) - quantile_cont(py, 0.05), 2)) / first(torso), 6) END AS travel
    FROM w JOIN t USING (video) WHERE pc >= 0.5 GROUP BY video""")
def anchor_travels(spark, sf_dir):
    return rounded(pose.anchor_travel(pose_frames(spark, sf_dir), "wrist"), 6, "travel")


_DOWN = "movement IN ('" + "', '".join(evidence.DESCENDING) + "')"
_WRIST = "movement IN ('" + "', '".join(evidence.WRIST_ORIGIN) + "')"
_SPANS = f"""s AS (SELECT *, start_frame AS rep_a, end_frame AS rep_b, start_frame AS setup_a, least(start_frame + 3, end_frame) AS setup_b,
    CASE WHEN {_DOWN} THEN turn_frame ELSE start_frame END AS lifting_a, CASE WHEN {_DOWN} THEN end_frame ELSE turn_frame END AS lifting_b,
    CASE WHEN {_DOWN} THEN start_frame ELSE turn_frame END AS lowering_a, CASE WHEN {_DOWN} THEN turn_frame ELSE end_frame END AS lowering_b,
    CASE WHEN {_DOWN} THEN start_frame ELSE greatest(start_frame, turn_frame - 3) END AS support_a, CASE WHEN {_DOWN} THEN least(start_frame + 3, end_frame) ELSE least(end_frame, turn_frame + 3) END AS support_b,
    CASE WHEN {_DOWN} THEN greatest(start_frame, turn_frame - 3) END AS turnaround_a, CASE WHEN {_DOWN} THEN least(end_frame, turn_frame + 3) END AS turnaround_b FROM r)"""


@query(f"""WITH {_P}, {_R}, {_SPANS} SELECT rep_id, phase, a, b FROM (""" + " UNION ALL ".join(f"SELECT rep_id, '{n}' AS phase, {n}_a AS a, {n}_b AS b FROM s" for n in ("rep", "setup", "lifting", "lowering", "support", "turnaround")) + """
    UNION ALL SELECT rep_id, 'transition', lifting_a, lifting_b FROM s WHERE movement = 'muscle_up') WHERE a IS NOT NULL""")
def phase_windows(spark, sf_dir):
    return evidence.phase_table(repetitions(pose_frames(spark, sf_dir)))


_O = {k: f"CASE WHEN {_WRIST} THEN {_mid('wrist', k)} ELSE {_mid('hip', k)} END" for k in "xy"}
_OC = f"CASE WHEN {_WRIST} THEN least(left_wrist_c, right_wrist_c) ELSE least(left_hip_c, right_hip_c) END"
_SERIES = f"""f AS (SELECT s.*, p.* EXCLUDE (video), torso, ({_O['y']} - {_mid('shoulder', 'y')}) / torso AS above, ({_mid('hip', 'x')} - {_O['x']}) / torso AS sideways,
    abs(left_shoulder_y - right_shoulder_y) / torso AS tilt, least({_OC}, left_shoulder_c, right_shoulder_c) AS conf, {_FRAME_CONFIDENCE} AS conf_all
    FROM s JOIN p USING (video) JOIN t USING (video) WHERE frame BETWEEN start_frame AND end_frame),
    g AS (SELECT *, first(above) OVER (PARTITION BY rep_id ORDER BY frame) AS begin, max(above) OVER (PARTITION BY rep_id) AS peak FROM f)"""
_LIFT = "frame BETWEEN lifting_a AND lifting_b"
_METRICS = f"""m AS (SELECT rep_id, first(video) AS video, first(movement) AS movement, greatest(first(lifting_b - lifting_a), 1) / 30.0 AS concentric_s, greatest(first(lowering_b - lowering_a), 1) / 30.0 AS eccentric_s, first(end_frame - start_frame) / 30.0 AS total_s,
    CASE WHEN first(movement) = 'muscle_up' THEN count(*) FILTER ({_LIFT} AND abs(above) <= 0.15) / 30.0 END AS transition_s, count(*) FILTER (above >= begin + 0.85 * (peak - begin)) / 30.0 AS top_hold_s,
    first(peak - begin) AS rom, first(peak) AS peak_height, -first(begin) AS start_depth, quantile_cont(tilt, 0.5) FILTER ({_LIFT}) AS shoulder_asymmetry, max(tilt) FILTER (frame = turn_frame) AS turn_asymmetry,
    quantile_cont(sideways, 0.95) - quantile_cont(sideways, 0.05) AS swing, avg(conf) AS mean_conf, max(conf) FILTER (frame = turn_frame) AS turn_conf, avg(conf_all) AS body_conf, avg(CASE WHEN conf >= 0.35 THEN 1.0 ELSE 0.0 END) AS observed_frac
    FROM g GROUP BY rep_id)"""
_MEASURES = ("concentric_s", "eccentric_s", "total_s", "transition_s", "top_hold_s", "rom", "peak_height", "start_depth", "shoulder_asymmetry", "turn_asymmetry", "swing", "mean_conf", "turn_conf", "body_conf", "observed_frac")
_USABLE = f"{_WRIST} AND arm_reach BETWEEN 0.6 AND 1.9"
_UP = f"NOT ({_DOWN})"


@query(f"""WITH {_P}, {_CLIP}, {_ARM}, {_R}, {_SPANS}, {_SERIES}, {_METRICS} SELECT rep_id, video, movement, {", ".join(f"round({c}, 9) AS {c}" for c in _MEASURES)}, round(eccentric_s / concentric_s, 9) AS tempo_ratio,
    round((mean_conf + turn_conf + body_conf + observed_frac) / 4, 9) AS rep_quality, round(arm_reach, 9) AS arm_reach,
    array_to_string(list_filter([CASE WHEN {_USABLE} AND abs(peak_height) > 1.2 * arm_reach THEN 'above_reach' END, CASE WHEN {_USABLE} AND {_UP} AND start_depth < 0 THEN 'starts_above' END, CASE WHEN {_USABLE} AND {_UP} AND start_depth > 1.2 * arm_reach THEN 'starts_too_deep' END, CASE WHEN {_USABLE} AND rom > 2.4 * arm_reach THEN 'rom_beyond_reach' END], lambda x: x IS NOT NULL), ',') AS problems
    FROM m JOIN a USING (video)""")
def repetition_metrics(spark, sf_dir):
    clips = pose_frames(spark, sf_dir)
    out = evidence.rep_metrics(clips, repetitions(clips)).drop("plausible").withColumn("problems", F.array_join("problems", ","))
    # a mean of few decimals may lie on a tie at 6 decimals
    return rounded(out, 9, *_MEASURES, "tempo_ratio", "rep_quality", "arm_reach")


def _at(c: str, phase: str = "rep") -> str:
    return f"CASE WHEN frame BETWEEN {phase}_a AND {phase}_b THEN {c} END"


def _share(c: str, phase: str = "rep") -> str:
    return f"avg(CASE WHEN frame BETWEEN {phase}_a AND {phase}_b THEN CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END END)"


def _q(c: str, q: float, phase: str = "rep") -> str:
    return f"quantile_cont({_at(c, phase)}, {q})"


_SIDES = {f"knee_{s}": f"CASE WHEN {_seen(f'{s}_hip', f'{s}_knee', f'{s}_ankle')} THEN abs({s}_knee_x - ({s}_hip_x + {s}_ankle_x) / 2) / torso END" for s in ("left", "right")} | {f"ankle_{s}": f"CASE WHEN {s}_ankle_c >= 0.5 THEN {s}_ankle_y END" for s in ("left", "right")}
_PHASES = ("rep", "setup", "lifting", "lowering", "support", "turnaround")
_DETAIL = f"""d AS (SELECT *, above AS signal, {_either(*_ANGLES['elbow'])} AS elbow, {_either(*_ANGLES['knee'])} AS knee, CASE WHEN {_HIPS} THEN ({_mid('ankle', 'y')} - {_mid('hip', 'y')}) / torso END AS stand, CASE WHEN {_HIPS} THEN (greatest(left_ankle_y, right_ankle_y) - {_mid('hip', 'y')}) / torso END AS stand_low,
    CASE WHEN {_HIPS} AND {_seen('left_shoulder', 'right_shoulder')} THEN {_LINE} END AS sag, CASE WHEN {_seen('left_hip', 'right_hip', 'left_shoulder', 'right_shoulder')} THEN ({_mid('hip', 'x')} - {_mid('shoulder', 'x')}) / torso END AS lean, {", ".join(f"{v} AS {k}" for k, v in _SIDES.items())},
    abs(lead(above) OVER (PARTITION BY rep_id ORDER BY frame) - above) * 30 AS speed, CASE WHEN {_DOWN} THEN -above ELSE above END AS rising FROM g),
    l AS (SELECT rep_id, frame, rising, lead(rising) OVER o AS after, first(rising) OVER o AS low, last(rising) OVER (PARTITION BY rep_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first(rising) OVER o AS total, count(*) OVER (PARTITION BY rep_id) AS n FROM d WHERE {_LIFT} WINDOW o AS (PARTITION BY rep_id ORDER BY frame)),
    y AS (SELECT rep_id, avg(CASE WHEN ((rising + after) / 2 - low) / total > 0.1 AND ((rising + after) / 2 - low) / total < 0.9 AND after - rising < 0.2 * total / (n - 1) THEN 1.0 ELSE 0.0 END) AS stalled_frac FROM l WHERE after IS NOT NULL AND n >= 6 AND total > 1e-9 GROUP BY rep_id),
    h AS (SELECT rep_id, first(view) AS view, {", ".join(f"first({p}_{k}) AS {p}_{k}" for p in _PHASES for k in "ab")}, {", ".join(f"avg({_at('CASE WHEN valid THEN 1.0 ELSE 0.0 END', p)}) AS {p}_seen" for p in _PHASES)},
    min(CASE WHEN {_LIFT} AND abs(above) <= 0.15 THEN frame END) AS band_a, max(CASE WHEN {_LIFT} AND abs(above) <= 0.15 THEN frame END) AS band_b, max(signal) - min(signal) AS travel, min(CASE WHEN frame BETWEEN turn_frame - 4 AND turn_frame + 3 THEN speed END) AS turn_speed,
    {", ".join(f"{_q('elbow', 0.5, p)} AS {p}_elbow" for p in ("setup", "support", "turnaround"))}, {", ".join(f"{_share('elbow', p)} AS {p}_elbow_seen" for p in ("rep", "setup", "support", "turnaround"))},
    avg(CASE WHEN elbow >= 160 THEN 1.0 WHEN elbow < 160 THEN 0.0 END) AS arms_straight_frac, avg(CASE WHEN knee >= 160 THEN 1.0 WHEN knee < 160 THEN 0.0 END) AS legs_straight_frac, {_share('knee')} AS knee_angle_seen,
    {_q('stand', 0.9)} - {_q('stand', 0.05)} AS squat_depth, {_share('stand')} AS stand_seen, {_q('stand_low', 0.9)} - {_q('stand_low', 0.05)} AS split_depth, {_share('stand_low')} AS stand_low_seen, {_q('sag', 0.9)} AS hip_sag, {_share('sag')} AS sag_seen, {_q('lean', 0.9)} AS torso_lean, {_share('lean')} AS lean_seen,
    greatest({", ".join(f"CASE WHEN count(ankle_{s}) >= 5 THEN ({_q(f'ankle_{s}', 0.9)} - {_q(f'ankle_{s}', 0.05)}) / first(torso) END" for s in ("left", "right"))}) AS heel_rise, greatest({_share('ankle_left')}, {_share('ankle_right')}) AS ankle_seen,
    greatest({_q('knee_left', 0.9)}, {_q('knee_right', 0.9)}) AS knee_valgus, greatest({_share('knee_left')}, {_share('knee_right')}) AS knee_seen FROM d GROUP BY rep_id),
    z AS (SELECT *, quantile_cont(concentric_s, 0.5) OVER (PARTITION BY video, movement) AS median_s FROM m JOIN a USING (video) JOIN h USING (rep_id) LEFT JOIN y USING (rep_id))"""


def _cell(name: str, value: str, phase: str, seen: str | None = None, applies: str = "true", samples: str | None = None, a: str | None = None, b: str | None = None) -> str:
    seen, a, b = seen or f"{phase}_seen", a or f"{phase}_a", b or f"{phase}_b"
    samples = samples or f"round_even({seen} * ({b} - {a} + 1), 0)"
    return f"SELECT rep_id, movement, view, '{name}' AS primitive, CASE WHEN {applies} THEN {value} END AS value, '{phase}' AS phase, CASE WHEN {applies} THEN {a} END AS a, CASE WHEN {applies} THEN {b} END AS b, CASE WHEN {applies} THEN {seen} END AS coverage, CASE WHEN {applies} THEN CAST({samples} AS BIGINT) END AS samples, {applies} AS applies FROM z"


_REACH = f"CASE WHEN {_WRIST} AND arm_reach > 0 THEN arm_reach END"
_CELLS = [
    _cell("concentric_s", "concentric_s", "lifting"),
    _cell("eccentric_s", "eccentric_s", "lowering"),
    *[_cell(n, "eccentric_s / concentric_s" if n == "tempo_ratio" else n, "rep") for n in ("total_s", "tempo_ratio", "top_hold_s", "rom", "peak_height", "start_depth")],
    _cell("transition_s", "transition_s", "lifting", applies="movement = 'muscle_up'", samples="round_even(lifting_seen * (lifting_b - lifting_a + 1), 0)", a="coalesce(band_a, lifting_a)", b="coalesce(band_b, lifting_b)"),
    _cell("swing", "swing", "rep", applies=_WRIST),
    _cell("lockout_pct", f"peak_height / ({_REACH}) * 100", "support", applies=_WRIST),
    _cell("hang_pct", f"start_depth / ({_REACH}) * 100", "setup", applies=_WRIST),
    _cell("stalled_frac", "stalled_frac", "lifting"),
    _cell("travel", "travel", "rep"),
    _cell("turn_speed", "turn_speed", "turnaround", seen="coalesce(turnaround_seen, support_seen)", a="coalesce(turnaround_a, support_a)", b="coalesce(turnaround_b, support_b)"),
    _cell("fast_ratio", "concentric_s / median_s", "lifting"),
    _cell("start_elbow_deg", "setup_elbow", "setup", seen="setup_elbow_seen"),
    _cell("bottom_elbow_deg", f"CASE WHEN {_DOWN} THEN turnaround_elbow ELSE setup_elbow END", "turnaround", seen=f"CASE WHEN {_DOWN} THEN turnaround_elbow_seen ELSE setup_elbow_seen END", a=f"CASE WHEN {_DOWN} THEN turnaround_a ELSE setup_a END", b=f"CASE WHEN {_DOWN} THEN turnaround_b ELSE setup_b END"),
    _cell("top_elbow_deg", "support_elbow", "support", seen="support_elbow_seen"),
    _cell("arms_straight_frac", "arms_straight_frac", "rep", seen="rep_elbow_seen"),
    _cell("legs_straight_frac", "legs_straight_frac", "rep", seen="knee_angle_seen"),
    _cell("squat_depth", "squat_depth", "rep", seen="stand_seen"),
    _cell("split_depth", "split_depth", "rep", seen="stand_low_seen", applies="movement IN ('split_squat', 'bulgarian_split_squat')"),
    _cell("hip_sag", "hip_sag", "rep", seen="sag_seen"),
    _cell("heel_rise", "heel_rise", "rep", seen="ankle_seen"),
    _cell("torso_lean", "torso_lean", "rep", seen="lean_seen"),
    _cell("knee_valgus", "knee_valgus", "rep", seen="knee_seen"),
]
_EVIDENCE = f"""WITH {_P}, {_CLIP}, {_ARM}, {_R}, {_SPANS}, {_SERIES}, {_METRICS}, {_DETAIL}, c AS ({" UNION ALL ".join(_CELLS)}),
    v AS (SELECT *, CASE WHEN NOT applies THEN 'not applicable' WHEN value IS NULL THEN 'tracking loss' WHEN coverage < 0.6 THEN 'too little of the phase seen' WHEN samples < 3 THEN 'too few frames seen'
      WHEN primitive IN ('hip_sag', 'torso_lean', 'heel_rise') AND view IS DISTINCT FROM 'SAGITTAL' OR primitive = 'knee_valgus' AND view IS DISTINCT FROM 'FRONTAL' THEN 'unsuitable view' END AS reason FROM c),
    k AS (SELECT *, CASE WHEN reason IS NULL THEN 'measured' WHEN reason = 'unsuitable view' THEN 'view_blocked' ELSE 'unmeasured' END AS state FROM v)"""


@query(f"{_EVIDENCE} SELECT rep_id, movement, primitive, round(value, 6) AS value, phase, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(coverage, 6) AS coverage, samples, state, reason FROM k")
def repetition_evidence(spark, sf_dir):
    clips = pose_frames(spark, sf_dir)
    out = evidence.rep_evidence(clips, repetitions(clips))
    return rounded(out.select("rep_id", "movement", "primitive", "value", "phase", "a", "b", "coverage", "samples", "state", "reason"), 6, "value", "coverage")


_RULES = ", ".join("('{}', '{}', '{}', '{}', {})".format(*(line.split(",")[i] for i in (0, 1, 4, 5, 6))) for line in rules.REGISTRY.splitlines())


@query(f"""{_EVIDENCE}, u(movement, error, primitive, cmp, threshold) AS (VALUES {_RULES})
    SELECT z.rep_id, concat(u.movement, '.', u.error) AS rule, CASE WHEN k.state IS DISTINCT FROM 'measured' THEN 'unobservable' WHEN (cmp = '<' AND value < threshold) OR (cmp = '>' AND value > threshold) OR (cmp = '>=' AND value >= threshold) THEN 'observed' ELSE 'not_observed' END AS status
    FROM z JOIN u USING (movement) LEFT JOIN k ON k.rep_id = z.rep_id AND k.primitive = u.primitive""")
def technique_verdicts(spark, sf_dir):
    clips = pose_frames(spark, sf_dir)
    found = repetitions(clips)
    subjects = found.select("rep_id", "movement", F.lit(None).cast("string").alias("variant"), F.lit(False).alias("blocked"))
    return rules.assessed(subjects, rules.registry(spark), evidence.rep_evidence(clips, found), ["rep_id"]).select("rep_id", "rule", "status")


@query(f"""WITH {_P}, {_R} SELECT rep_id, video, round((turn_frame - start_frame - 1) / fps, 6) AS first_s, round((end_frame - turn_frame - 1) / fps, 6) AS second_s, round((end_frame - start_frame) / fps, 6) AS rep_s, round((end_frame - turn_frame - 1) / CAST(turn_frame - start_frame - 1 AS DOUBLE), 6) AS tempo_ratio FROM r""")
def repetition_tempo(spark, sf_dir):
    out = reps.tempo(repetitions(pose_frames(spark, sf_dir)))
    return rounded(out.select("rep_id", "video", "first_s", "second_s", "rep_s", "tempo_ratio"), 6, "first_s", "second_s", "rep_s", "tempo_ratio")


@query(f"""WITH {_P}, {_R} SELECT rep_id, m AS moment, round(CASE m WHEN 'start' THEN start_frame WHEN 'first_half' THEN (start_frame + turn_frame) / 2.0 WHEN 'turn' THEN turn_frame WHEN 'second_half' THEN (turn_frame + end_frame) / 2.0 ELSE end_frame END / fps, 6) AS at_s
    FROM r, (SELECT unnest(['start', 'first_half', 'turn', 'second_half', 'end']) AS m)""")
def repetition_moments(spark, sf_dir):
    return rounded(reps.moments(repetitions(pose_frames(spark, sf_dir))), 6, "at_s")


_VALUE = "((left_wrist_y - left_shoulder_y) / 100)"


@query(f"""WITH {_P}, {_R}, {_SPANS}, x AS (SELECT rep_id, phase, a, b FROM ({" UNION ALL ".join(f"SELECT rep_id, video, '{n}' AS phase, {n}_a AS a, {n}_b AS b FROM s" for n in _PHASES)}) WHERE a IS NOT NULL),
    j AS (SELECT x.rep_id, phase, {_VALUE} AS v FROM x JOIN r USING (rep_id) JOIN p USING (video) WHERE frame BETWEEN a AND b)
    SELECT rep_id, phase, round(quantile_cont(v, 0.5), 6) AS median, round(max(v) - min(v), 6) AS travel, round(count(v) / count(*), 6) AS coverage, count(v) AS samples FROM j GROUP BY 1, 2""")
def phase_measures(spark, sf_dir):
    clips = pose_frames(spark, sf_dir)
    found = repetitions(clips)
    spans = evidence.phase_table(found).filter("phase <> 'transition'").join(found.select("rep_id", "video"), "rep_id")
    return rounded(pose.measured_phases(clips.withColumn("height", F.expr(_VALUE)), spans, "height"), 6, "median", "travel", "coverage")


@query(f"""WITH {_P} SELECT video, frame, CASE WHEN starts_with(joint, 'left_') THEN 'right_' || joint[6:] WHEN starts_with(joint, 'right_') THEN 'left_' || joint[7:] ELSE joint END AS joint, round(-x, 6) AS x, round(y, 6) AS y
    FROM ({" UNION ALL ".join(f"SELECT video, frame, '{j}' AS joint, {j}_x AS x, {j}_y AS y FROM p" for j in JOINTS)})""")
def mirrored_poses(spark, sf_dir):
    rows = pose_frames(spark, sf_dir)
    joints = F.array(*[F.struct(F.lit(j).alias("joint"), F.col(f"{j}_x").alias("x"), F.col(f"{j}_y").alias("y")) for j in JOINTS])
    return rounded(pose.mirrored(rows.select("video", "frame", F.inline(joints))), 6, "x", "y")


@query(f"WITH {_P} SELECT video, frame FROM (SELECT video, frame, max(frame) OVER (PARTITION BY video) + 1 AS n FROM p) WHERE frame >= floor(n * 0.25) AND frame < ceil(n * 0.8)")
def cropped_clips(spark, sf_dir):
    return pose.cropped(pose_frames(spark, sf_dir).select("video", "frame"), 0.25, 0.8)


_APPARENT = "abs(left_shoulder_x - right_shoulder_x) / 100.0"
_THETA = f"degrees(asin(greatest(0.0, least(1.0, {_APPARENT} / 0.45))))"


@query(f"WITH {_P} SELECT video, frame, round({_THETA}, 6) AS theta, CASE WHEN {_THETA} < 20 THEN 'SAGITTAL' WHEN {_THETA} < 65 THEN 'OBLIQUE' ELSE 'FRONTAL' END AS bin FROM p")
def camera_bins(spark, sf_dir):
    rows = pose_frames(spark, sf_dir).select("video", "frame", pose.azimuth(F.expr(_APPARENT), F.lit(0.45)).alias("theta"))
    return rounded(rows.withColumn("bin", pose.azimuth_bin(F.col("theta"))), 6, "theta")


_LEVEL = 4.0
_SEEN_TRUNK = "(" + " AND ".join(f"{j}_c >= 0.35" for j in ("left_hip", "right_hip", "left_shoulder", "right_shoulder")) + ")"
_HOLDS = f"""b AS (SELECT *, CASE WHEN {_SEEN_TRUNK} THEN {_TRUNK} END AS line, ({_mid('hip', 'x')} - {_mid('shoulder', 'x')}) / torso AS away FROM p JOIN t USING (video)),
    i AS (SELECT video, frame, frame - row_number() OVER (PARTITION BY video ORDER BY frame) AS g FROM b WHERE line >= {_LEVEL}),
    n AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY min(frame)) AS hold, min(frame) AS start_frame, max(frame) AS end_frame FROM i GROUP BY video, g HAVING count(*) / 30.0 >= 0.2)"""


def _level_holds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    clips = pose_frames(spark, sf_dir)
    return clips, holds.attempts(clips, 30.0, _LEVEL, 0.2)


@query(f"WITH {_P}, {_CLIP}, {_HOLDS} SELECT video, hold, start_frame, end_frame FROM n")
def hold_attempts(spark, sf_dir):
    return _level_holds(spark, sf_dir)[1]


@query(f"""WITH {_P}, {_CLIP}, {_HOLDS}, k AS (SELECT *, least(end_frame, start_frame + 3) AS o, greatest(start_frame, end_frame - 3) AS l FROM n), q AS (SELECT *, least(o + 1, end_frame) AS ma, greatest(l - 1, start_frame) AS mb FROM k)
    SELECT video, hold, phase, CASE phase WHEN 'exit' THEN l WHEN 'sustained' THEN CASE WHEN mb < ma THEN start_frame ELSE ma END ELSE start_frame END AS a,
    CASE phase WHEN 'onset' THEN o WHEN 'sustained' THEN CASE WHEN mb < ma THEN end_frame ELSE mb END ELSE end_frame END AS b FROM q, (SELECT unnest(['hold', 'onset', 'sustained', 'exit']) AS phase)""")
def hold_phases(spark, sf_dir):
    return holds.phases(_level_holds(spark, sf_dir)[1])


def _limbs(part: tuple[str, str, str], need: tuple[str, str]) -> str:
    ok = "(" + " AND ".join(f"{s}_{j}_c >= 0.35" for j in need for s in ("left", "right")) + ")"
    bare = [_angle(*(f"{s}_{j}" for j in part)).replace(_seen(*(f"{s}_{j}" for j in part)), ok) for s in ("left", "right")]
    return f"[{bare[0]}, {bare[1]}]"


_CLIP_LIMBS = f"""o AS (SELECT video, unnest({_limbs(("shoulder", "elbow", "wrist"), ("shoulder", "wrist"))}) AS arm, unnest({_limbs(("hip", "knee", "ankle"), ("hip", "ankle"))}) AS leg, unnest({_limbs(("shoulder", "hip", "knee"), ("shoulder", "hip"))}) AS pike FROM p),
    x AS (SELECT video, avg(CASE WHEN arm >= 160 THEN 1.0 WHEN arm < 160 THEN 0.0 END) AS arms_straight_frac, avg(CASE WHEN leg >= 160 THEN 1.0 WHEN leg < 160 THEN 0.0 END) AS legs_straight_frac, quantile_cont(pike, 0.5) AS hip_pike_deg FROM o GROUP BY video)"""
_HELD = ("body_line_deg", "horizontal_frac", "swing", "sustain_s", "arms_straight_frac", "legs_straight_frac", "hip_pike_deg")


@query(f"""WITH {_P}, {_CLIP}, {_HOLDS}, {_CLIP_LIMBS}, y AS (SELECT video, hold, quantile_cont(line, 0.5) AS body_line_deg, avg(CASE WHEN line >= {_LEVEL} THEN 1.0 WHEN line < {_LEVEL} THEN 0.0 END) AS horizontal_frac,
    quantile_cont(away, 0.95) - quantile_cont(away, 0.05) AS swing, first(end_frame - start_frame) / 30.0 AS sustain_s FROM b JOIN n USING (video) WHERE frame BETWEEN start_frame AND end_frame GROUP BY 1, 2)
    SELECT video, hold, {", ".join(f"round({c}, 5) AS {c}" for c in _HELD)} FROM y JOIN x USING (video)""")
def hold_metrics(spark, sf_dir):
    clips, found = _level_holds(spark, sf_dir)
    return rounded(holds.metrics(clips, found, 30.0, _LEVEL), 5, *_HELD)


_WIDTH = "sqrt(pow(left_shoulder_x - right_shoulder_x, 2) + pow(left_shoulder_y - right_shoulder_y, 2))"


@query(f"""WITH {_P}, {_CLIP}, a AS (SELECT video, count(*) AS n, quantile_cont({_WIDTH} / torso, 0.97) AS ruler, quantile_cont({_WIDTH} / torso, 0.5) AS middle FROM p JOIN t USING (video) WHERE {_seen('left_shoulder', 'right_shoulder')} GROUP BY video),
    s AS (SELECT video, count({_SHOULDERS}) AS k, avg(CASE WHEN {_SHOULDERS} > 0 THEN 1.0 WHEN {_SHOULDERS} <= 0 THEN 0.0 END) AS q FROM p GROUP BY video),
    d AS (SELECT *, degrees(asin(greatest(0.0, least(1.0, middle / greatest(ruler, 1e-6))))) AS theta, greatest(q, 1 - q) AS agree FROM s LEFT JOIN a USING (video)),
    u AS (SELECT *, CASE WHEN theta < 20 THEN 'SAGITTAL' WHEN theta < 65 THEN 'OBLIQUE' WHEN theta >= 65 THEN 'FRONTAL' ELSE 'UNKNOWN' END AS bin0, coalesce(n, 0) < 10 AS few FROM d)
    SELECT video, CASE WHEN few THEN 'UNKNOWN' ELSE bin0 END AS bin, CASE WHEN k >= 10 AND agree >= 0.7 THEN CASE WHEN q >= 0.5 THEN 'left' ELSE 'right' END ELSE 'unknown' END AS side, round(ruler, 6) AS ruler, CASE WHEN NOT few THEN round(theta, 6) END AS theta,
    CASE WHEN few THEN 'few frames' WHEN NOT ruler BETWEEN 0.65 AND 0.95 THEN 'implausible ruler' WHEN NOT coalesce(agree >= 0.7, false) THEN 'unclear side' WHEN bin0 = 'UNKNOWN' THEN 'outside every bin' END AS reason FROM u""")
def estimated_views(spark, sf_dir):
    return rounded(pose.estimated_view(pose_frames(spark, sf_dir)).drop("knowable"), 6, "ruler", "theta")


@query(f"WITH {_P}, {_CLIP} SELECT video, frame, round({_WIDTH} / torso, 6) AS ratio FROM p JOIN t USING (video) WHERE {_seen('left_shoulder', 'right_shoulder')}")
def apparent_widths(spark, sf_dir):
    return rounded(pose.apparent_ratios(pose_frames(spark, sf_dir)), 6, "ratio")


_SCORED = """r AS (SELECT o_orderkey AS rep_id, o_custkey AS video, o_orderpriority AS bin, o_totalprice AS total, o_orderkey % 1000 AS joint FROM orders), z AS (SELECT bin, total, joint FROM r WHERE rep_id % 3 = 0)"""


@query(f"""WITH {_SCORED}, l AS (SELECT bin, quantile_cont(total, 0.95) AS p95, count(*) AS n FROM z GROUP BY bin),
    v AS (SELECT bin, 0 AS nul, rep_id, video, total, joint FROM r UNION ALL SELECT bin, 1, NULL, NULL, total, joint FROM z),
    w AS (SELECT *, sum(nul) OVER (PARTITION BY bin ORDER BY total) AS tu, sum(nul) OVER (PARTITION BY bin, total) AS te, sum(nul) OVER (PARTITION BY bin ORDER BY joint) AS ju, sum(nul) OVER (PARTITION BY bin, joint) AS je FROM v)
    SELECT rep_id, video, bin, total, joint, round(p95, 6) AS null_p95, n AS n_null, round(100.0 * (tu - te + 0.5 * te) / n, 6) AS total_percentile, round(100.0 * (ju - je + 0.5 * je) / n, 6) AS joint_percentile, total > p95 AS flagged FROM w JOIN l USING (bin) WHERE nul = 0""")
def flagged_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("rep_id"), F.col("o_custkey").alias("video"), F.col("o_orderpriority").alias("bin"), F.col("o_totalprice").cast("double").alias("total"), (F.col("o_orderkey") % 1000).alias("joint"))
    null = rows.filter("rep_id % 3 = 0").select("bin", "total", "joint")
    return rounded(scoring.flagged_scores(rows, null, ["total", "joint"], ["bin"]), 6, "null_p95", "total_percentile", "joint_percentile")


@query("""WITH s AS (SELECT user_id, date_trunc('week', ts) AS w, count(*) AS n_reps FROM events GROUP BY 1, 2), p AS (SELECT user_id, count(*) AS sessions, count(*) FILTER (n_reps >= 3) AS usable FROM s GROUP BY 1),
    c AS (SELECT user_id, event_type AS label, avg(value) > 60 AS supported, CASE WHEN count(*) % 3 = 0 THEN 'better' WHEN count(*) % 3 = 1 THEN 'worse' END AS direction FROM events GROUP BY 1, 2),
    g AS (SELECT user_id, list_sort(list(label) FILTER (supported AND direction = 'better')) AS b, list_sort(list(label) FILTER (supported AND direction = 'worse')) AS w, list_sort(list(label) FILTER (supported AND direction IS NULL)) AS n FROM c GROUP BY 1),
    v AS (SELECT *, CASE WHEN sessions < 2 THEN 'one_session' WHEN usable < 2 THEN 'too_few_reps' WHEN b IS NULL AND w IS NULL AND n IS NULL THEN 'stable' ELSE 'changed' END AS verdict FROM p LEFT JOIN g USING (user_id))
    SELECT user_id, sessions, usable, verdict, CASE WHEN verdict = 'changed' THEN coalesce(array_to_string(b, ','), '') ELSE '' END AS improved, CASE WHEN verdict = 'changed' THEN coalesce(array_to_string(w, ','), '') ELSE '' END AS declined, CASE WHEN verdict = 'changed' THEN coalesce(array_to_string(n, ','), '') ELSE '' END AS changed FROM v""")
def progress_verdicts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sessions = events.groupBy("user_id", F.date_trunc("week", F.col("ts").cast("timestamp")).alias("w")).agg(F.count(F.lit(1)).alias("n_reps"))
    n = F.count(F.lit(1)) % 3
    found = events.groupBy("user_id", F.col("event_type").alias("label")).agg((F.avg("value") > 60).alias("supported"), F.when(n == 0, "better").when(n == 1, "worse").alias("direction"))
    out = scoring.progress_verdict(sessions, found, ["user_id"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("improved", "declined", "changed")})
