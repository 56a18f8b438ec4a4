"""Feature vectors of whole clips and of their thirds.

One row per frame in (columns <joint>_x, <joint>_y, <joint>_c), one row per clip and
part out.  Part 0 is the clip; parts 1 .. bins are equal stretches of it, each measured
like a clip of its own.  All is dealt by (clip, part) once: which side stands for a
pair of joints, the torso and the medians are windows over that key, the vector is one
wide aggregate.  The least-travelled window and the anchored frames need the order
statistics of a sliding window; a small kernel keeps them running, a clip part at a
time.  A clip, and with it a window's buffer, is as long as a recording.

A feature is null, never 0, where too little was seen.  y grows downwards.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.operators.pose import CONFIDENT, angle, both_sides, confident, even_mean, length
from kinelake.sources.tables import JOINTS

#: Fixed values of the measurement rules.
BOTH_SHARE = 0.55
ANCHOR_FIXED, ANCHOR_WINDOW_S, MIN_SEEN, MOSTLY_UNSEEN = 0.80, 3.0, 0.40, 0.50
OVER_BAR, LOW_MARGIN, HOLD_BAND, MIN_JOINT_SEEN, LEAST_FRAMES = 0.12, 0.15, 0.20, 0.15, 8
PAIRS = ("shoulder", "hip", "wrist", "knee", "ankle")
BODY_POINTS = tuple(f"{side}_{j}" for j in ("shoulder", "elbow", "hip", "knee", "ankle") for side in ("left", "right"))
CHAINS = {"elbow": ("shoulder", "elbow", "wrist"), "knee": ("hip", "knee", "ankle"), "hip": ("shoulder", "hip", "knee"), "shoulder": ("hip", "shoulder", "elbow")}
WATCHED = ("nose", "left_wrist", "left_elbow", "left_hip", "left_knee", "left_ankle")


class RunningSpread:
    """5th to 95th percentile range of a sliding multiset, which stays sorted."""

    def __init__(self, values=()):
        self.values: list[float] = sorted(values)

    def add(self, x: float) -> None:
        bisect.insort(self.values, x)

    def remove(self, x: float) -> None:
        del self.values[bisect.bisect_left(self.values, x)]

    def at(self, q: float) -> float:
        place = q * (len(self.values) - 1)
        low = int(place)
        high = min(low + 1, len(self.values) - 1)
        # one rounding less, as DuckDB's build has it: equal windows are then equal in both
        return math.fma(self.values[low], 1 - (place - low), self.values[high] * (place - low))

    def value(self) -> float:
        return self.at(0.95) - self.at(0.05)


def travel_of(x: RunningSpread, y: RunningSpread) -> float:
    """Robust way of a point; infinite for fewer than 5 places."""
    if len(x.values) < 5:
        return math.inf
    dx, dy = x.value(), y.value()
    return math.sqrt(dx * dx + dy * dy)


def sliding_travel(x: list[float], y: list[float], seen: list[bool], width: int, starts: Callable[[int], bool] = lambda start: True):
    """(start, share seen, travel) of the wanted windows; the whole series if it is no longer than a window."""
    n = len(x)
    width = min(width, n)
    sx, sy = RunningSpread(), RunningSpread()
    for i in range(n):
        if seen[i]:
            sx.add(x[i])
            sy.add(y[i])
        start = i - width + 1
        if start < 0:
            continue
        if starts(start):
            yield start, len(sx.values) / width, travel_of(sx, sy)
        if seen[start]:
            sx.remove(x[start])
            sy.remove(y[start])


def still_windows(x: list[float], y: list[float], seen: list[bool], width: int, step: int = 5) -> tuple[tuple[float, float, int, int], list[tuple[int, int]]]:
    """The least-travelled window (travel, share seen, first, last), and the anchored stretches.

    Windows start at every `step`th frame, or every tenth of a window for the anchored
    stretches; the first of equal ones wins.  A series no longer than a window is one.
    """
    n, tenth = len(x), max(1, width // 10)
    whole = n <= width
    best, spans = (math.inf, 0.0, 0, width - 1), []
    for start, share, travel in sliding_travel(x, y, seen, width, lambda a: a % step == 0 or a % tenth == 0):
        if whole:
            best = (travel, share, 0, max(0, n - 1))
        elif start % step == 0 and share >= MIN_SEEN and travel < best[0]:
            best = (travel, share, start, start + width - 1)
        if start % tenth == 0 and share >= MIN_SEEN and travel <= ANCHOR_FIXED:
            last = start + min(width, n) - 1
            if spans and start <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], last)
            else:
                spans.append((start, last))
    return best, spans


def periodicity(signal: np.ndarray, fps: float) -> tuple[float | None, float | None]:
    """Highest autocorrelation of the measured values at lags from 0.25 s to 8 s, and its rate."""
    a = signal[np.isfinite(signal)]
    if a.size < 16:
        return None, None
    a = a - a.mean()
    power = float((a * a).sum())
    if power <= 1e-9:
        return 0.0, None
    lo, hi = max(2, int(0.25 * fps)), min(a.size - 1, int(8.0 * fps))
    if hi <= lo:
        return None, None
    wide = np.fft.rfft(a, 2 * a.size)
    correlation = np.fft.irfft(wide * np.conj(wide), 2 * a.size)[lo:hi] / power
    # values that differ in the last places only are equal: the shortest lag wins
    k = int(np.flatnonzero(correlation >= correlation.max() - 1e-12)[0])
    return float(correlation[k]), fps / (lo + k)


def window_frames(n: Column, fps: float) -> Column:
    return F.greatest(F.lit(15), F.least(n, F.lit(int(round(ANCHOR_WINDOW_S * fps))))).cast("int")


def in_parts(frames: DataFrame, clip: str, bins: int) -> DataFrame:
    """Each frame in the clip itself (part 0) and in one of its bins, with its place and the part's length."""
    w = Window.partitionBy(clip)
    rows = frames.withColumns({"_at": F.row_number().over(w.orderBy("frame")) - 1, "_n": F.count(F.lit(1)).over(w)})
    starts = [F.floor(F.col("_n") * i / bins).cast("int") for i in range(bins + 1)]
    whole = F.struct(F.lit(0).alias("part"), F.col("_at").alias("at"), F.col("_n").cast("int").alias("n"))
    if bins < 2:
        parts = F.array(whole)
    else:
        inside = [F.when((F.col("_at") >= starts[i]) & (F.col("_at") < starts[i + 1]), F.struct(F.lit(i + 1).alias("part"), (F.col("_at") - starts[i]).alias("at"), (starts[i + 1] - starts[i]).alias("n"))) for i in range(bins)]
        parts = F.array(whole, F.coalesce(*inside))
    return rows.withColumn("_p", F.explode(parts)).select(clip, "_p.part", "_p.at", "_p.n", *[f"{j}_{k}" for j in JOINTS for k in "xyc"])


def with_pairs(rows: DataFrame, key: list[str]) -> DataFrame:
    """<pair>_x, _y and _ok of each part: the midpoint if both sides are seen together, else the near side."""
    w = Window.partitionBy(*key)
    share = {}
    for j in PAIRS:
        lc, rc = (F.coalesce(f"{s}_{j}_c", F.lit(0.0)) for s in ("left", "right"))
        share[f"_{j}_both"] = F.avg(((lc >= CONFIDENT) & (rc >= CONFIDENT)).cast("double")).over(w) >= BOTH_SHARE
        share[f"_{j}_left"] = even_mean(lc).over(w) >= even_mean(rc).over(w)
    rows = rows.withColumns(share)
    out = {}
    for j in PAIRS:
        pick = lambda m, a, b, j=j: F.when(F.col(f"_{j}_both"), m).when(F.col(f"_{j}_left"), a).otherwise(b)
        for k in "xy":
            a, b = F.col(f"left_{j}_{k}"), F.col(f"right_{j}_{k}")
            out[f"{j}_{k}"] = pick((a + b) / 2, a, b)
        out[f"{j}_ok"] = pick(confident(f"left_{j}", f"right_{j}"), confident(f"left_{j}"), confident(f"right_{j}"))
    return rows.withColumns(out).drop(*share)


def with_torso(rows: DataFrame, key: list[str]) -> DataFrame:
    """torso: the median over well seen frames, five at least, else over all."""
    w = Window.partitionBy(*key)
    own = length(F.col("shoulder_x") - F.col("hip_x"), F.col("shoulder_y") - F.col("hip_y"))
    rows = rows.withColumn("_own", F.when(own > 1e-6, own))
    rows = rows.withColumn("_good", F.when(F.col("shoulder_ok") & F.col("hip_ok"), F.col("_own")))
    middle = lambda c: F.percentile(c, F.lit(0.5)).over(w)
    return rows.withColumn("torso", F.when(F.count("_good").over(w) >= 5, middle("_good")).otherwise(middle("_own"))).drop("_own", "_good")


def clip_windows(rows: DataFrame, key: list[str], fps: float) -> DataFrame:
    """Travel, least-travelled windows and anchored stretches of wrists and ankles, and the periodicity of `primary`."""
    kinds = dict(rows.dtypes)
    numbers = [f"{name}_{k}" for name in ("wrist", "ankle") for k in ("travel", "window_travel", "window_seen")] + ["periodicity", "rep_rate_hz"]
    places = [f"{name}_{k}" for name in ("wrist", "ankle") for k in ("first", "last")]

    def work(k: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        n = part.num_rows
        out = dict(zip(key, [v.as_py() for v in k], strict=True))
        for name in ("wrist", "ankle"):
            x, y = (part.column(f"{name}_u{c}").to_pylist() for c in "xy")
            seen = [ok and a is not None and b is not None for ok, a, b in zip(part.column(f"{name}_ok").to_pylist(), x, y, strict=True)]
            held = [[v for v, ok in zip(values, seen, strict=True) if ok] for values in (x, y)]
            out[f"{name}_travel"] = travel_of(*map(RunningSpread, held))
            best, spans = still_windows(x, y, seen, max(15, min(n, int(round(ANCHOR_WINDOW_S * fps)))))
            out[f"{name}_window_travel"], out[f"{name}_window_seen"], out[f"{name}_first"], out[f"{name}_last"] = best
            if name == "wrist":
                out["spans"] = [{"a": a, "b": b} for a, b in spans]
        primary = part.column("primary").to_numpy(zero_copy_only=False).astype(float)
        out["periodicity"], out["rep_rate_hz"] = periodicity(primary, fps)
        fields = [(c, part.schema.field(c).type) for c in key] + [(c, pa.float64()) for c in numbers] + [(c, pa.int32()) for c in places]
        fields.append(("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))))
        return pa.Table.from_pylist([out], pa.schema(fields))

    shape = ", ".join([f"{c} {kinds[c]}" for c in key] + [f"{c} double" for c in numbers] + [f"{c} int" for c in places]) + ", spans array<struct<a: int, b: int>>"
    return rows.select(*key, "at", "wrist_ux", "wrist_uy", "wrist_ok", "ankle_ux", "ankle_uy", "ankle_ok", "primary").groupBy(*key).applyInArrow(work, shape)


def _crooked(a: str, b: str, c: str, ok: Column) -> Column:
    """Inner angle at b; 90 degrees for a side of no length."""
    ux, uy, vx, vy = (F.col(f"{p}_{k}") - F.col(f"{b}_{k}") for p in (a, c) for k in "xy")
    norm = length(ux, uy) * length(vx, vy)
    cos = F.when(norm > 1e-6, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / norm))).otherwise(0.0)
    return F.when(ok & confident(a, b, c), F.degrees(F.acos(cos)))


def frame_series(rows: DataFrame, key: list[str], fps: float) -> DataFrame:
    """The measured series of each frame, in torso lengths and degrees; needs pairs and torso."""
    t, c = F.nullif(F.col("torso"), F.lit(0.0)), F.col
    seen = lambda *pairs: F.when(_all(*[c(f"{p}_ok") for p in pairs]), F.lit(1.0))
    rise = lambda low, high: seen(low, high) * (c(f"{low}_y") - c(f"{high}_y")) / t
    nose_ok = confident("nose")
    both = lambda j: confident(f"left_{j}", f"right_{j}")
    gone = F.lag(F.struct(*[c(f"{j}_{k}") for j in JOINTS for k in "xyc"])).over(Window.partitionBy(*key).orderBy("at"))
    # what is used twice becomes a column first
    rows = rows.withColumn("_before", gone)
    rows = rows.withColumns({f"_step_{j}": F.when(confident(j) & (F.coalesce(c(f"_before.{j}_c"), F.lit(0.0)) >= CONFIDENT), length(c(f"{j}_x") - c(f"_before.{j}_x"), c(f"{j}_y") - c(f"_before.{j}_y"))) for j in JOINTS})
    rows = rows.withColumns({f"_low_{j}": F.when(confident(j), ((c(f"{j}_y") - c("wrist_y")) / t > LOW_MARGIN).cast("int")) for j in BODY_POINTS})
    # nulls are left out of both the sum and the count
    total = lambda columns: sum((F.coalesce(x, F.lit(0)) for x in columns), F.lit(0))
    count = lambda columns: sum((x.isNotNull().cast("int") for x in columns), F.lit(0))
    mean = lambda columns: F.try_divide(total(columns), count(columns))
    edge = lambda f, k: f(*[F.when(confident(j), c(f"{j}_{k}")) for j in JOINTS])
    bx, by = c("hip_x") - c("shoulder_x"), c("hip_y") - c("shoulder_y")
    line = F.nullif(F.when(length(bx, by) > 1e-6, length(bx, by)), F.lit(0.0))
    off_line = lambda px, py, ox, oy: ((px - ox) * -by + (py - oy) * bx) / line / t
    knee_side = seen("shoulder", "hip", "knee") * off_line(c("knee_x"), c("knee_y"), c("hip_x"), c("hip_y"))
    nose_side = F.when(nose_ok, seen("shoulder", "hip") * off_line(c("nose_x"), c("nose_y"), c("shoulder_x"), c("shoulder_y")))
    made = {
        "above_clip": rise("wrist", "shoulder"),
        "hip_over_ankle": rise("ankle", "hip"),
        "knee_over_hip_": rise("hip", "knee"),
        "hip_over_hands": rise("wrist", "hip"),
        "ankle_over_hip": rise("hip", "ankle"),
        "hips_above": -rise("hip", "shoulder"),
        "ankle_below_wrist": rise("ankle", "wrist"),
        "head_below_hips": F.when(nose_ok & c("hip_ok"), (c("nose_y") - c("hip_y")) / t),
        "ankles_above_head": F.when(nose_ok & c("ankle_ok"), (c("nose_y") - c("ankle_y")) / t),
        "tilt": F.when(c("shoulder_ok") & c("hip_ok"), F.degrees(F.atan2(F.abs(bx), F.greatest(F.abs(by), F.lit(1e-6))))),
        "below": F.when(c("wrist_ok"), mean([c(f"_low_{j}") for j in BODY_POINTS])),
        "hand_dy": F.when(both("wrist"), F.abs(c("left_wrist_y") - c("right_wrist_y")) / t),
        "hand_dx": F.when(both("wrist"), F.abs(c("left_wrist_x") - c("right_wrist_x")) / t),
        "wrist_to_shoulder": seen("wrist", "shoulder") * length(c("wrist_x") - c("shoulder_x"), c("wrist_y") - c("shoulder_y")) / t,
        "wrist_to_hip": seen("wrist", "hip") * length(c("wrist_x") - c("hip_x"), c("wrist_y") - c("hip_y")) / t,
        "nose_side": nose_side,
        "knee_side": knee_side,
        "width": (edge(F.greatest, "x") - edge(F.least, "x")) / t,
        "height": (edge(F.greatest, "y") - edge(F.least, "y")) / t,
        "pace": mean([c(f"_step_{j}") for j in JOINTS]) / t * fps,
        "ankle_gap": F.when(both("ankle"), F.abs(c("left_ankle_y") - c("right_ankle_y")) / t),
        **{f"{s}_foot": F.when(both("ankle") & c("hip_ok"), (c(f"{s}_ankle_y") - c("hip_y")) / t) for s in ("left", "right")},
        **{f"arm_{s}": _crooked(f"{s}_shoulder", f"{s}_elbow", f"{s}_wrist", c("shoulder_ok") & c("wrist_ok")) for s in ("left", "right")},
        **{f"leg_{s}": _crooked(f"{s}_hip", f"{s}_knee", f"{s}_ankle", c("hip_ok") & c("ankle_ok")) for s in ("left", "right")},
        **{f"chain_{name}": both_sides(part) for name, part in CHAINS.items()},
        **{f"wrist_u{k}": c(f"wrist_{k}") / t for k in "xy"},
        **{f"ankle_u{k}": c(f"ankle_{k}") / t for k in "xy"},
        "feet_seen": (both("ankle") & c("hip_ok")).cast("double"),
        **{f"seen_{j}": confident(j).cast("double") for j in WATCHED},
    }
    rows = rows.withColumns(made).select(*key, "at", "n", "torso", *[f"{p}_ok" for p in PAIRS], *made)
    w = Window.partitionBy(*key)
    rows = rows.withColumns({
        "stacked": c("hand_dy") / F.greatest("hand_dx", F.lit(0.05)),
        "same_side": F.signum("nose_side") * F.signum("knee_side"),
        "aspect": c("width") / F.greatest("height", F.lit(1e-6)),
        "primary": F.when(F.count("hip_over_ankle").over(w) >= F.count("above_clip").over(w), c("hip_over_ankle")).otherwise(c("above_clip")),
        "_mid_above": F.percentile("above_clip", F.lit(0.5)).over(w),
        "_mid_knee": F.percentile("knee_over_hip_", F.lit(0.5)).over(w),
    })
    return rows


def _all(*conditions: Column) -> Column:
    out = F.lit(True)
    for x in conditions:
        out = out & x
    return out


class _Wanted:
    """Collects percentiles by series, so that each series is counted once."""

    def __init__(self):
        self.places: dict[str, list[float]] = {}

    def pct(self, series: str, q: float) -> Column:
        places = self.places.setdefault(series, [])
        if q not in places:
            places.append(q)
        return F.get(F.col(f"_q_{series}"), F.lit(places.index(q)))

    def spread(self, series: str) -> Column:
        return self.pct(series, 95) - self.pct(series, 5)

    def aggregates(self) -> list[Column]:
        return [F.percentile(s, F.array(*[F.lit(q / 100.0) for q in places])).alias(f"_q_{s}") for s, places in self.places.items()]


def share_from(series: str, least: float, sign: int = 1) -> Column:
    """Share of the measured frames at or above a limit."""
    x = F.col(series) if sign > 0 else -F.col(series)
    return F.avg((x >= least).cast("double"))


def deviation(series: str) -> Column:
    return F.when(F.count(series) > 1, F.stddev_pop(series))


def rule_vector(want: _Wanted, fps: float) -> tuple[dict[str, Column], dict[str, Column]]:
    """Aggregates, and features over them, that the decision list reads."""
    f, n, c = F.col, F.count(F.lit(1)), F.col
    straight = lambda limb: F.try_divide(*[sum((g(F.col(f"{limb}_{s}")) for s in ("left", "right")), F.lit(0.0)) for g in (lambda x: F.coalesce(F.sum((x >= 160.0).cast("double")), F.lit(0.0)), lambda x: F.count(x).cast("double"))])
    parked = lambda s, mid: F.when(F.count(s) >= 6, F.avg((F.abs(F.col(s) - F.col(mid)) <= HOLD_BAND).cast("double")))
    sums = {
        "n_frames": n,
        "wrist_seen": F.avg(c("wrist_ok").cast("double")),
        "ankle_seen": F.avg(c("ankle_ok").cast("double")),
        "on_bar_frac": F.avg(c("on_bar").cast("double")),
        "hands_overhead_frac": share_from("above", 0.05, -1),
        "hands_below_frac": share_from("above", 0.05),
        "shoulder_above_hands_over_bar_frac": share_from("above", OVER_BAR),
        "shoulder_above_hands_std": deviation("above"),
        "hip_travel_std": deviation("hip_over_ankle"),
        "horizontal_frac": share_from("tilt", 70.0),
        "arms_straight_frac": straight("arm"),
        "legs_straight_frac": straight("leg"),
        "legs_lifted_frac": share_from("ankle_over_hip", -0.05),
        "parked_frac": F.coalesce(F.least(parked("above_clip", "_mid_above"), parked("knee_over_hip_", "_mid_knee")), F.lit(0.0)),
        "_feet_seen": F.avg("feet_seen"),
    }
    features = {name: f(name) for name in sums if not name.startswith("_")} | {
        "fps": F.lit(float(fps)),
        "window_frames": window_frames(f("n_frames"), fps),
        "shoulder_above_hands_p05": want.pct("above", 5),
        "shoulder_above_hands_p90": want.pct("above", 90),
        "shoulder_above_hands_p95": want.pct("above", 95),
        "shoulder_above_hands_p95_clip": want.pct("above_clip", 95),
        "arm_articulation": want.spread("above"),
        "arm_articulation_clip": want.spread("above_clip"),
        "hip_travel": want.spread("hip_over_ankle"),
        "torso_tilt": want.pct("tilt", 50),
        "body_line_deg": want.pct("tilt", 50),
        "body_below_hands": want.pct("below", 50),
        "knee_over_hip": want.pct("knee_over_hip_", 50),
        "knee_excursion": want.spread("knee_over_hip_"),
        "hip_articulation": want.spread("hip_over_hands"),
        "l_ankle_below": want.pct("left_foot", 50),
        "r_ankle_below": want.pct("right_foot", 50),
        "split_ankle_heights": want.pct("ankle_gap", 50),
        "rear_raised": want.pct("ankle_gap", 50),
    }
    low = lambda s: F.coalesce(features[f"{s}_ankle_below"] > 0.05, F.lit(False))
    features["single_leg_stance"] = (f("_feet_seen") >= MOSTLY_UNSEEN) & (low("l") != low("r"))
    return sums, features


def kinematic_vector(want: _Wanted, fps: float) -> tuple[dict[str, Column], dict[str, Column]]:
    """Aggregates, and features over them, of the wider view: chains, support, facing, extent, tempo."""
    f, n = F.col, F.count(F.lit(1))
    sums, features = {}, {}
    for name in CHAINS:
        s = f"chain_{name}"
        sums |= {f"{name}_seen": F.count(s) / n, f"_{name}_extended": share_from(s, 160.0), f"_{name}_flexed": share_from(s, -90.0, -1)}
        known = lambda v, name=name: F.when(f(f"{name}_seen") >= MIN_JOINT_SEEN, v)
        features |= {
            f"{name}_seen": f(f"{name}_seen"),
            f"{name}_min": known(want.pct(s, 5)),
            f"{name}_max": known(want.pct(s, 95)),
            f"{name}_median": known(want.pct(s, 50)),
            f"{name}_rom": known(want.spread(s)),
            f"{name}_extended_frac": known(f(f"_{name}_extended")),
            f"{name}_flexed_frac": known(f(f"_{name}_flexed")),
        }
    own = {
        "inverted_frac": share_from("hips_above", 0.30),
        "head_below_hips_frac": share_from("head_below_hips", 0.10),
        "ankles_above_head_frac": share_from("ankles_above_head", 0.20),
        "feet_above_hands_frac": share_from("ankle_below_wrist", 0.10, -1),
        "hands_stacked_frac": share_from("stacked", 1.5),
        "wrist_shoulder_dist_std": deviation("wrist_to_shoulder"),
        "face_knee_same_side_frac": share_from("same_side", 0.5),
        "wide_silhouette_frac": share_from("aspect", 1.2),
        "moving_frac": share_from("pace", 0.25),
        **{f"seen_{j}": F.avg(f"seen_{j}") for j in WATCHED},
    }
    sums |= own | {"_n": n}
    features |= {name: f(name) for name in own} | {
        "hips_above_shoulders_median": want.pct("hips_above", 50),
        "ankle_below_wrist_median": want.pct("ankle_below_wrist", 50),
        "hand_separation_vertical": want.pct("hand_dy", 50),
        "hand_separation_horizontal": want.pct("hand_dx", 50),
        "hands_stacked_ratio": want.pct("stacked", 50),
        "wrist_shoulder_dist_median": want.pct("wrist_to_shoulder", 50),
        "wrist_shoulder_dist_rom": want.spread("wrist_to_shoulder"),
        "wrist_hip_dist_median": want.pct("wrist_to_hip", 50),
        "wrist_hip_dist_rom": want.spread("wrist_to_hip"),
        "wrist_above_ankle_min": want.pct("ankle_below_wrist", 5),
        "nose_offset_signed": want.pct("nose_off", 50),
        "knee_offset_signed": want.pct("knee_off", 50),
        "body_width": want.pct("width", 50),
        "body_height": want.pct("height", 50),
        "body_aspect_median": want.pct("aspect", 50),
        "body_aspect_max": want.pct("aspect", 95),
        "hinge_ratio": features["hip_rom"] / F.greatest(features["knee_rom"] * 1.0, F.when(features["knee_rom"].isNotNull(), F.lit(1.0))),
        "primary_rom": want.spread("primary"),
        "motion_energy_median": want.pct("pace", 50),
        "motion_energy_p95": want.pct("pace", 95),
        "duration_s": f("_n") / F.lit(float(fps)),
    }
    return sums, features


#: Features that the kernel of the sliding windows gives.
WINDOWED = ("wrist_travel", "ankle_travel", "wrist_window_travel", "wrist_window_seen", "ankle_window_travel", "ankle_window_seen", "wrist_first", "wrist_last", "periodicity", "rep_rate_hz")


def joined_vector(*parts: dict[str, Column]) -> dict[str, Column]:
    """One vector of several; a name that two of them have is an error."""
    out: dict[str, Column] = {}
    for p in parts:
        if clash := set(out) & set(p):
            raise ValueError(f"features of the same name: {sorted(clash)}")
        out |= p
    return out


def clip_features(frames: DataFrame, fps: float = 30.0, clip: str = "video", bins: int = 3, kinematic: bool = True) -> DataFrame:
    """clip, part and the feature vector of every clip (part 0) and of each of its bins (1 .. bins).

    A bin of fewer than 8 frames has no features; bins=1 gives the clips alone.
    """
    key = [clip, "part"]
    # dealt by the whole key once; every window and aggregate below keeps to it
    rows = with_torso(with_pairs(in_parts(frames, clip, bins), key), key)
    rows = frame_series(rows, key, fps)
    windows = clip_windows(rows, key, fps)
    rows = rows.join(windows.select(*key, "spans"), key)
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s["b"] - s["a"] + 1)
    some = covered >= F.greatest(F.lit(5), F.floor(window_frames(F.col("n"), fps) / 2).cast("int"))
    on_bar = ~some | F.exists("spans", lambda s: F.col("at").between(s["a"], s["b"]))
    rows = rows.withColumn("on_bar", on_bar).withColumns({"above": F.when(F.col("on_bar"), F.col("above_clip")), "nose_off": F.abs("nose_side"), "knee_off": F.abs("knee_side")})
    want = _Wanted()
    vectors = [rule_vector(want, fps), *([kinematic_vector(want, fps)] if kinematic else [])]
    features = joined_vector(*[v[1] for v in vectors], {name: F.col(name) for name in WINDOWED})
    sums: dict[str, Column] = {}
    for s, _ in vectors:
        sums |= s
    wide = rows.groupBy(*key).agg(*want.aggregates(), *[v.alias(k) for k, v in sums.items()])
    out = wide.join(windows.drop("spans"), key)
    enough = (F.col("part") == 0) | (F.col("n_frames") >= LEAST_FRAMES)
    return out.select(*key, *[F.when(enough, v).alias(k) for k, v in features.items()])


def phased(features: DataFrame, clip: str = "video", bins: int = 3) -> DataFrame:
    """One row per clip: its own features, and those of its bins with the prefixes p1_ .. ."""
    names = [c for c in features.columns if c not in (clip, "part")]
    prefixed = [f"p{i}_{n}" for i in range(1, bins + 1) for n in names]
    if clash := set(names) & set(prefixed):
        raise ValueError(f"features of the same name: {sorted(clash)}")
    all_ = F.struct(*names)
    wide = features.groupBy(clip).agg(*[F.max_by(F.when(F.col("part") == i, all_), F.when(F.col("part") == i, F.lit(1))).alias(f"_{i}") for i in range(bins + 1)])
    return wide.select(clip, *[F.col(f"_0.{n}").alias(n) for n in names], *[F.col(f"_{i}.{n}").alias(f"p{i}_{n}") for i in range(1, bins + 1) for n in names])
