"""Measures of repetitions from pose frames, and the evidence that rules may read.

frames: one row per video and frame (columns <joint>_x, <joint>_y, <joint>_c), and
optionally signal (the tracked signal of the segmentation) and valid (whether the
frame was observed); reps: rep_id, video, movement, start_frame, turn_frame,
end_frame, fps, and optionally view (the camera's bin).  y grows downwards; lengths
are in torsos.  A repetition's frames are aggregated in one pass; the turn's speed
reads a few frames beyond them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.num import finite, pct, spread
from kinelake.operators import pose
from kinelake.sources.tables import BODY

#: Movements by origin of their lengths and by what comes first.
WRIST_ORIGIN = ("muscle_up", "pull_up", "knee_raise", "dip", "push_up", "front_lever", "planche")
DESCENDING = ("squat", "dip", "push_up", "planche", "pistol_squat", "split_squat", "bulgarian_split_squat")
HAS_TRANSITION = ("muscle_up",)
SPLITS = ("split_squat", "bulgarian_split_squat")
#: Half windows in seconds, bands in torsos, limbs in degrees, limits of coverage.
ENDPOINT_S, TURN_S = 0.10, 0.15
BAR_BAND = 0.15
STRAIGHT = 160.0
OBSERVED_CONFIDENCE = 0.35
LEAST_COVERAGE, LEAST_SAMPLES = 0.60, 3
STALL_RATE, STALL_EDGE = 0.20, 0.10
REACH_BAND, REACH_MARGIN = (0.60, 1.90), 1.20
#: Robustness, plane and unit of the primitives (the others: scaled, no plane or unit).
PRIMITIVES = """\
concentric_s,invariant,,s
eccentric_s,invariant,,s
total_s,invariant,,s
tempo_ratio,invariant,,
transition_s,invariant,,s
top_hold_s,invariant,,s
stalled_frac,invariant,,
fast_ratio,invariant,,
swing,scaled,,torso
rom,scaled,,torso
travel,scaled,,torso
peak_height,scaled,,torso
start_depth,scaled,,torso
lockout_pct,scaled,,% of reach
hang_pct,scaled,,% of reach
squat_depth,scaled,,torso
pistol_depth,scaled,,torso
split_depth,scaled,,torso
turn_speed,scaled,,torso/s
start_elbow_deg,scaled,,deg
bottom_elbow_deg,scaled,,deg
top_elbow_deg,scaled,,deg
arms_straight_frac,scaled,,
legs_straight_frac,scaled,,
body_line_deg,scaled,,deg
hip_pike_deg,scaled,,deg
hip_sag,planar,sagittal,torso
torso_lean,planar,sagittal,torso
heel_rise,planar,sagittal,torso
knee_valgus,planar,frontal,torso
"""


def rep_windows(reps: DataFrame) -> DataFrame:
    """reps with the inclusive frame ranges <phase>_a and <phase>_b of their phases."""
    start, turn, end = F.col("start_frame"), F.col("turn_frame"), F.col("end_frame")
    half = F.greatest(F.lit(1), F.bround(ENDPOINT_S * F.greatest(F.col("fps"), F.lit(1.0)), 0).cast("int"))
    inside = lambda f: F.greatest(start, F.least(end, f))
    down = F.col("movement").isin(*DESCENDING)
    either = lambda a, b: F.when(down, a).otherwise(b)
    spans = {
        "rep": (start, end),
        "setup": (inside(start - half), inside(start + half)),
        "lifting": (either(turn, start), either(end, turn)),
        "lowering": (either(start, turn), either(turn, end)),
        "support": (either(inside(start - half), inside(turn - half)), either(inside(start + half), inside(turn + half))),
        "turnaround": (F.when(down, inside(turn - half)), F.when(down, inside(turn + half))),
    }
    return reps.withColumns({f"{name}_{k}": v for name, span in spans.items() for k, v in zip("ab", span, strict=True)})


def phase_table(reps: DataFrame) -> DataFrame:
    """rep_id, phase, a and b: a row per phase; transition is bounded by the lift."""
    names = ("rep", "setup", "lifting", "lowering", "support", "turnaround")
    rows = [F.struct(F.lit(n).alias("phase"), F.col(f"{n}_a").alias("a"), F.col(f"{n}_b").alias("b")) for n in names]
    rows.append(F.struct(F.lit("transition").alias("phase"), F.when(F.col("movement").isin(*HAS_TRANSITION), F.col("lifting_a")).alias("a"), F.col("lifting_b").alias("b")))
    return rep_windows(reps).select("rep_id", F.inline(F.array(*rows))).filter("a IS NOT NULL")


def within(phase: str) -> Column:
    return F.col("frame").between(F.col(f"{phase}_a"), F.col(f"{phase}_b"))


def rep_series(frames: DataFrame, reps: DataFrame) -> DataFrame:
    """The frames of each repetition with its heights, sideways travel and confidences.

    A few frames beyond the repetition come along, outside of its phases.
    """
    rows = rep_windows(reps).withColumn("_fps", F.greatest(F.col("fps").cast("double"), F.lit(1.0)))
    rows = rows.withColumn("_half", F.greatest(F.lit(1), F.bround(TURN_S * F.col("_fps"), 0).cast("int")))
    extra = {c: F.lit(None).cast(kind) for c, kind in (("signal", "double"), ("valid", "boolean")) if c not in frames.columns}
    rows = frames.withColumns(extra).join(rows, "video").join(pose.clip_torso(frames), "video", "left")
    rows = rows.filter(F.col("frame").between(F.least("start_frame", F.col("turn_frame") - F.col("_half")), F.greatest("end_frame", F.col("turn_frame") + F.col("_half"))))
    wrist = F.col("movement").isin(*WRIST_ORIGIN)
    pair = lambda joint: (*pose.midpoint(f"left_{joint}", f"right_{joint}"), F.least(f"left_{joint}_c", f"right_{joint}_c"))
    (wx, wy, wc), (hx, hy, hc), (sx, sy, sc) = pair("wrist"), pair("hip"), pair("shoulder")
    ox, oy, oc = F.when(wrist, wx).otherwise(hx), F.when(wrist, wy).otherwise(hy), F.when(wrist, wc).otherwise(hc)
    torso = F.nullif(F.col("torso"), F.lit(0.0))
    rows = rows.withColumns(
        {
            "shoulder_above": (oy - sy) / torso,
            "hip_lateral": (hx - ox) / torso,
            "shoulder_tilt": F.abs(F.col("left_shoulder_y") - F.col("right_shoulder_y")) / torso,
            "conf": F.least(oc, sc),
            "conf_all": sum((F.col(f"{j}_c") for j in BODY), F.lit(0.0)) / len(BODY),
        }
    )
    begin = F.first("shoulder_above").over(Window.partitionBy("rep_id").orderBy(within("rep").cast("int").desc(), "frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    peak = F.max(F.when(within("rep"), F.col("shoulder_above"))).over(Window.partitionBy("rep_id"))
    return rows.withColumns({"_begin": begin, "_peak": peak, "signal": F.coalesce("signal", "shoulder_above")})


def share(hit: Column, of: Column) -> Column:
    """Share of the rows of a phase that hold; null if it has none."""
    return F.avg(F.when(of, F.coalesce(hit, F.lit(False)).cast("double")))


def rep_metrics(frames: DataFrame, reps: DataFrame) -> DataFrame:
    """rep_id and its durations, heights, sway, pose quality and implausibilities."""
    rows = rep_series(frames, reps)
    inside, lift = within("rep"), within("lifting")
    first = lambda c: F.first(c, True)
    at_turn = lambda c: F.max(F.when(F.col("frame") == F.col("turn_frame"), F.col(c)))
    fps = first("_fps")
    seconds = lambda p: F.greatest(first(f"{p}_b") - first(f"{p}_a"), F.lit(1)) / fps
    gate = F.col("_begin") + 0.85 * (F.col("_peak") - F.col("_begin"))
    out = rows.groupBy("rep_id").agg(
        F.first("video").alias("video"),
        F.first("movement").alias("movement"),
        seconds("lifting").alias("concentric_s"),
        seconds("lowering").alias("eccentric_s"),
        ((first("end_frame") - first("start_frame")) / fps).alias("total_s"),
        F.when(F.first("movement").isin(*HAS_TRANSITION), F.count_if(lift & (F.abs("shoulder_above") <= BAR_BAND)) / fps).alias("transition_s"),
        (F.count_if(inside & (F.col("shoulder_above") >= gate)) / fps).alias("top_hold_s"),
        (first("_peak") - first("_begin")).alias("rom"),
        first("_peak").alias("peak_height"),
        (-first("_begin")).alias("start_depth"),
        pct(F.when(lift, F.col("shoulder_tilt")), 50).alias("shoulder_asymmetry"),
        at_turn("shoulder_tilt").alias("turn_asymmetry"),
        spread(F.when(inside, F.col("hip_lateral"))).alias("swing"),
        F.avg(F.when(inside, F.col("conf"))).alias("mean_conf"),
        at_turn("conf").alias("turn_conf"),
        F.avg(F.when(inside, F.col("conf_all"))).alias("body_conf"),
        share(F.col("conf") >= OBSERVED_CONFIDENCE, inside).alias("observed_frac"),
    )
    out = out.withColumn("tempo_ratio", F.col("eccentric_s") / F.col("concentric_s")).withColumn("rep_quality", (F.col("mean_conf") + F.col("turn_conf") + F.col("body_conf") + F.col("observed_frac")) / 4)
    out = out.join(pose.arm_reach(frames), "video", "left")
    usable = F.col("movement").isin(*WRIST_ORIGIN) & F.col("arm_reach").between(*REACH_BAND)
    limit, up = F.col("arm_reach") * REACH_MARGIN, ~F.col("movement").isin(*DESCENDING)
    checks = [
        ("above_reach", usable & (F.abs("peak_height") > limit)),
        ("starts_above", usable & up & (F.col("start_depth") < 0)),
        ("starts_too_deep", usable & up & (F.col("start_depth") > limit)),
        ("rom_beyond_reach", usable & (F.col("rom") > 2 * limit)),
    ]
    problems = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())
    return out.withColumn("problems", problems).withColumn("plausible", F.size("problems") == 0)


def stalled(rows: DataFrame) -> DataFrame:
    """rep_id and the share of the lift's steps that make no progress.

    Steps in the outer tenths of the travel are none; lifts with fewer than 6 frames,
    a missing value or no travel have null.  rows: rep_series; the lift rises.
    """
    up = F.when(F.col("movement").isin(*DESCENDING), -F.col("signal")).otherwise(F.col("signal"))
    lift = rows.filter(within("lifting")).select("rep_id", "frame", finite(up).alias("v"))
    w = Window.partitionBy("rep_id")
    order = w.orderBy("frame")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lift = lift.select("rep_id", "v", F.lead("v").over(order).alias("after"), F.first("v").over(whole).alias("low"), (F.last("v").over(whole) - F.first("v").over(whole)).alias("total"), F.count(F.lit(1)).over(w).alias("n"), F.count("v").over(w).alias("known"))
    progress = ((F.col("v") + F.col("after")) / 2 - F.col("low")) / F.col("total")
    slow = (progress > STALL_EDGE) & (progress < 1 - STALL_EDGE) & (F.col("after") - F.col("v") < STALL_RATE * F.col("total") / (F.col("n") - 1))
    steps = lift.filter(F.col("after").isNotNull() & (F.col("n") >= 6) & (F.col("n") == F.col("known")) & (F.col("total") > 1e-9))
    return steps.groupBy("rep_id").agg(F.avg(slow.cast("double")).alias("stalled_frac"))


def rep_evidence(frames: DataFrame, reps: DataFrame) -> DataFrame:
    """A row per repetition and primitive: value, phase, frames a .. b, coverage, state and reason.

    States: measured, unmeasured (no value, too little of the phase or too few frames
    seen) and view_blocked (the camera's plane doesn't show it).
    """
    series = rep_series(frames, reps)
    torso = F.nullif(F.col("torso"), F.lit(0.0))
    ankle = F.greatest(finite("left_ankle_y"), finite("right_ankle_y"))
    seen_hips = pose.confident("left_hip", "right_hip", "left_ankle", "right_ankle")
    hip_x, hip_y = pose.midpoint("left_hip", "right_hip")
    lean = F.when(pose.confident("left_hip", "right_hip", "left_shoulder", "right_shoulder"), (hip_x - pose.midpoint("left_shoulder", "right_shoulder")[0]) / torso)
    side = {}
    for s in ("left", "right"):
        ok = pose.confident(f"{s}_hip", f"{s}_knee", f"{s}_ankle")
        side[f"knee_{s}"] = F.when(ok, F.abs(F.col(f"{s}_knee_x") - (F.col(f"{s}_hip_x") + F.col(f"{s}_ankle_x")) / 2) / torso)
        side[f"ankle_{s}"] = F.when(pose.confident(f"{s}_ankle"), F.col(f"{s}_ankle_y"))
    series = series.withColumns(
        {
            "elbow": pose.both_sides(("shoulder", "elbow", "wrist")),
            "knee": pose.both_sides(("hip", "knee", "ankle")),
            "stand": pose.hip_above_ankle(torso),
            "stand_low": F.when(seen_hips, (ankle - hip_y) / torso),
            "sag": pose.hip_line_offset(torso),
            "lean": lean,
            **side,
            "speed": F.abs(F.lead("signal").over(Window.partitionBy("rep_id").orderBy("frame")) - F.col("signal")) * F.col("_fps"),
        }
    )
    of = lambda c, phase="rep": F.when(within(phase), finite(c))
    near_turn = F.col("frame").between(F.col("turn_frame") - F.col("_half"), F.col("turn_frame") + F.col("_half") - 1)
    drop = lambda c: pct(of(c), 90) - pct(of(c), 5)
    rise = lambda s: F.when(F.count(of(f"ankle_{s}")) >= 5, (pct(of(f"ankle_{s}"), 90) - pct(of(f"ankle_{s}"), 5)) / F.first("torso"))
    seen = lambda c, phase="rep": share(finite(c).isNotNull(), within(phase))
    phases = ("rep", "setup", "lifting", "lowering", "support", "turnaround")
    ranges = [F.first(f"{p}_{k}", True).alias(f"{p}_{k}") for p in phases for k in "ab"]
    band = F.when(within("lifting") & (F.abs("shoulder_above") <= BAR_BAND), F.col("frame"))
    values = series.groupBy("rep_id").agg(
        *ranges,
        *([F.first("view", True).alias("view")] if "view" in series.columns else [F.lit(None).cast("string").alias("view")]),
        *[F.avg(F.when(within(p), F.col("valid").cast("double"))).alias(f"{p}_seen") for p in phases],
        F.min(band).alias("band_a"),
        F.max(band).alias("band_b"),
        (F.max(of("signal")) - F.min(of("signal"))).alias("travel"),
        F.min(F.when(near_turn, finite("speed"))).alias("turn_speed"),
        *[pct(of("elbow", p), 50).alias(f"{p}_elbow") for p in ("setup", "support", "turnaround")],
        *[seen("elbow", p).alias(f"{p}_elbow_seen") for p in ("rep", "setup", "support", "turnaround")],
        F.avg((of("elbow") >= STRAIGHT).cast("double")).alias("arms_straight_frac"),
        F.avg((of("knee") >= STRAIGHT).cast("double")).alias("legs_straight_frac"),
        seen("knee").alias("knee_angle_seen"),
        drop("stand").alias("squat_depth"),
        seen("stand").alias("stand_seen"),
        drop("stand_low").alias("split_depth"),
        seen("stand_low").alias("stand_low_seen"),
        pct(of("sag"), 90).alias("hip_sag"),
        seen("sag").alias("sag_seen"),
        pct(of("lean"), 90).alias("torso_lean"),
        seen("lean").alias("lean_seen"),
        F.greatest(rise("left"), rise("right")).alias("heel_rise"),
        F.greatest(seen("ankle_left"), seen("ankle_right")).alias("ankle_seen"),
        F.greatest(pct(of("knee_left"), 90), pct(of("knee_right"), 90)).alias("knee_valgus"),
        F.greatest(seen("knee_left"), seen("knee_right")).alias("knee_seen"),
    )
    metrics = rep_metrics(frames, reps)
    sets = Window.partitionBy("video", "movement")
    metrics = metrics.withColumn("_median", F.percentile("concentric_s", F.lit(0.5)).over(sets))
    rows = metrics.join(values, "rep_id").join(stalled(series), "rep_id", "left")
    return states(rows.select("rep_id", "movement", "view", F.inline(F.array(*evidence_cells()))))


def evidence_cells() -> list[Column]:
    """A struct for each primitive of a row of measures."""
    wrist, down = F.col("movement").isin(*WRIST_ORIGIN), F.col("movement").isin(*DESCENDING)
    reach = F.when(wrist & (F.col("arm_reach") > 0), F.col("arm_reach"))

    def cell(name: str, value: Column, phase: str, seen: Column | None = None, applies: Column | None = None, samples: Column | None = None, a: Column | None = None, b: Column | None = None) -> Column:
        cover = F.col(f"{phase}_seen") if seen is None else seen
        first, last = F.col(f"{phase}_a") if a is None else a, F.col(f"{phase}_b") if b is None else b
        count = F.bround(cover * (last - first + 1), 0) if samples is None else samples
        ok = F.lit(True) if applies is None else applies
        kept = lambda c, kind: F.when(ok, c).cast(kind)
        return F.struct(F.lit(name).alias("primitive"), kept(finite(value), "double").alias("value"), F.lit(phase if phase != "band" else "transition").alias("phase"), kept(first, "long").alias("a"), kept(last, "long").alias("b"), kept(cover, "double").alias("coverage"), kept(count, "long").alias("samples"), ok.alias("applies"))

    lifted = F.bround(F.col("lifting_seen") * (F.col("lifting_b") - F.col("lifting_a") + 1), 0)
    crossing = F.col("movement").isin(*HAS_TRANSITION)
    turn = lambda k: F.coalesce(f"turnaround_{k}", f"support_{k}")
    bottom = lambda k: F.when(down, F.col(f"turnaround_{k}")).otherwise(F.col(f"setup_{k}"))
    c = F.col
    return [
        cell("concentric_s", c("concentric_s"), "lifting"),
        cell("eccentric_s", c("eccentric_s"), "lowering"),
        *[cell(name, c(name), "rep") for name in ("total_s", "tempo_ratio", "top_hold_s", "rom", "peak_height", "start_depth")],
        cell("transition_s", c("transition_s"), "lifting", applies=crossing, samples=lifted, a=F.coalesce("band_a", "lifting_a"), b=F.coalesce("band_b", "lifting_b")),
        cell("swing", c("swing"), "rep", applies=wrist),
        cell("lockout_pct", c("peak_height") / reach * 100, "support", applies=wrist),
        cell("hang_pct", c("start_depth") / reach * 100, "setup", applies=wrist),
        cell("stalled_frac", c("stalled_frac"), "lifting"),
        cell("travel", c("travel"), "rep"),
        cell("turn_speed", c("turn_speed"), "turnaround", seen=turn("seen"), a=turn("a"), b=turn("b")),
        cell("fast_ratio", c("concentric_s") / F.nullif(c("_median"), F.lit(0.0)), "lifting"),
        cell("start_elbow_deg", c("setup_elbow"), "setup", seen=c("setup_elbow_seen")),
        cell("bottom_elbow_deg", F.when(down, c("turnaround_elbow")).otherwise(c("setup_elbow")), "turnaround", seen=F.when(down, c("turnaround_elbow_seen")).otherwise(c("setup_elbow_seen")), a=bottom("a"), b=bottom("b")),
        cell("top_elbow_deg", c("support_elbow"), "support", seen=c("support_elbow_seen")),
        cell("arms_straight_frac", c("arms_straight_frac"), "rep", seen=c("rep_elbow_seen")),
        cell("legs_straight_frac", c("legs_straight_frac"), "rep", seen=c("knee_angle_seen")),
        cell("squat_depth", c("squat_depth"), "rep", seen=c("stand_seen")),
        cell("split_depth", c("split_depth"), "rep", seen=c("stand_low_seen"), applies=c("movement").isin(*SPLITS)),
        cell("hip_sag", c("hip_sag"), "rep", seen=c("sag_seen")),
        cell("heel_rise", c("heel_rise"), "rep", seen=c("ankle_seen")),
        cell("torso_lean", c("torso_lean"), "rep", seen=c("lean_seen")),
        cell("knee_valgus", c("knee_valgus"), "rep", seen=c("knee_seen")),
    ]


def states(rows: DataFrame) -> DataFrame:
    """rows of primitives with unit, robustness, plane, state and reason."""
    table = [line.split(",") for line in PRIMITIVES.splitlines()]
    of = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for line in table for x in (line[0], line[i])]), F.col("primitive")), F.lit(""))
    rows = rows.withColumns({"robustness": of(1), "plane": of(2), "unit": of(3)})
    shown = (F.col("plane") == "") | F.coalesce(F.lower("view") == F.col("plane"), F.lit(False))
    reason = (
        F.when(~F.col("applies"), "not applicable")
        .when(F.col("value").isNull(), "tracking loss")
        .when(F.col("coverage") < LEAST_COVERAGE, "too little of the phase seen")
        .when(F.col("samples") < LEAST_SAMPLES, "too few frames seen")
        .when(~shown, "unsuitable view")
    )
    state = F.when(reason.isNull(), "measured").when(reason == "unsuitable view", "view_blocked").otherwise("unmeasured")
    return rows.withColumns({"state": state, "reason": reason}).drop("applies")
