"""Repetition-level measurements and projections over clips, phases and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.num import finite, pct
from kinelake.operators import pose
from kinelake.operators.relational import small

#: Limb segments whose length over the torso describes a body.
SEGMENTS = {"upper_arm": ("shoulder", "elbow"), "forearm": ("elbow", "wrist"), "thigh": ("hip", "knee"), "shank": ("knee", "ankle")}


def trajectory(frames: DataFrame, reps: DataFrame, floor: float = 0.10) -> DataFrame:
    """Frames of each repetition, inclusive, with confidences clipped to [floor, 1]."""
    clipped = {c: F.greatest(F.lit(floor), F.least(F.lit(1.0), F.col(c))) for c in frames.columns if c.startswith("c_")}
    rows = frames.withColumns(clipped).join(reps.select("rep_id", "video", "start_frame", "end_frame"), "video")
    return rows.filter(F.col("frame").between(F.col("start_frame"), F.col("end_frame"))).drop("start_frame", "end_frame")


def anatomy(frames: DataFrame, clip: str = "video", least: int = 10) -> DataFrame:
    """Median and quartiles of each segment over the torso, in confident frames;
    clips and segments need `least` frames."""
    torso = pose.torso_length()
    cells = []
    for name, (a, b) in SEGMENTS.items():
        for side in ("left", "right"):
            ratio = F.when(pose.confident(f"{side}_{a}", f"{side}_{b}") & (torso > 0), pose.distance(f"{side}_{a}", f"{side}_{b}") / torso)
            cells.append(F.struct(F.lit(name).alias("segment"), ratio.alias("ratio")))
    rows = frames.withColumn("_n", F.count_if(pose.frame_confidence() >= pose.CONFIDENT).over(Window.partitionBy(clip))).filter(F.col("_n") >= least)
    q = F.percentile("ratio", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    out = rows.select(F.inline(F.array(*cells))).filter("ratio is not null").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), q.alias("_q")).filter(F.col("n") >= least)
    return out.select("segment", "n", F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(2)).alias("q3"))


def tempo(reps: DataFrame) -> DataFrame:
    """Seconds of both halves (frames less one) and of the whole, and their ratio."""
    half = lambda a, b: (F.col(b) - F.col(a) - 1) / F.col("fps")
    rows = reps.withColumn("first_s", half("start_frame", "turn_frame")).withColumn("second_s", half("turn_frame", "end_frame")).withColumn("rep_s", (F.col("end_frame") - F.col("start_frame")) / F.col("fps"))
    return rows.withColumn("tempo_ratio", F.col("second_s") / F.nullif(F.col("first_s"), F.lit(0.0)))


def rep_measures(points: DataFrame, value: str) -> DataFrame:
    """Travel, peak, depth, coverage and swing of a signal per repetition (rep_id, frame)."""
    v = finite(value)
    return points.groupBy("rep_id").agg((F.max(v) - F.min(v)).alias("travel"), F.max(v).alias("peak"), F.min(v).alias("depth"), (F.count(v) / F.count(F.lit(1))).alias("coverage"), (pct(value, 95) - pct(value, 5)).alias("swing"), F.min_by("frame", v).alias("lowest_frame"))


def planted_rise(points: DataFrame, key: str = "rep_id") -> DataFrame:
    """How far the ankles rise: 90th less 5th percentile per side, the larger one."""
    side = lambda s: F.when(F.count(F.when(pose.confident(f"{s}_ankle"), 1)) >= 5, pct(F.when(pose.confident(f"{s}_ankle"), -F.col(f"{s}_ankle_y")), 90) - pct(F.when(pose.confident(f"{s}_ankle"), -F.col(f"{s}_ankle_y")), 5))
    return points.groupBy(key).agg(side("left").alias("_l"), side("right").alias("_r"), F.first("torso").alias("_t")).select(key, (F.greatest("_l", "_r") / F.col("_t")).alias("heel_rise"))


def knee_deviation(torso: Column, side: str) -> Column:
    """Lateral distance of a knee from the line of hip and ankle, in torso lengths."""
    hx, hy, _ = pose.xy(f"{side}_hip")
    kx, ky, _ = pose.xy(f"{side}_knee")
    ax, ay, _ = pose.xy(f"{side}_ankle")
    on_line = hx + (ax - hx) * (ky - hy) / F.nullif(ay - hy, F.lit(0.0))
    return F.when(pose.confident(f"{side}_hip", f"{side}_knee", f"{side}_ankle"), F.abs(kx - on_line) / torso)


def parked(points: DataFrame, key: str, value: str, within: float = 0.20, least: int = 6) -> DataFrame:
    """Share of observed frames within a band around the median."""
    w = Window.partitionBy(key)
    rows = points.filter(F.col(value).isNotNull()).withColumn("_m", F.percentile(value, F.lit(0.5)).over(w))
    return rows.groupBy(key).agg(F.when(F.count(F.lit(1)) >= least, F.avg((F.abs(F.col(value) - F.col("_m")) <= within).cast("double"))).alias("parked"))


def joint_weights(frames: DataFrame, template: DataFrame, key: str) -> DataFrame:
    """Weights per joint: product of the clipped mean confidences, summing to 1.

    frames: key, joint, c; template: joint, c.
    """
    clip = lambda c: F.greatest(F.lit(0.1), F.least(F.lit(1.0), c))
    rows = frames.groupBy(key, "joint").agg(F.avg("c").alias("_a")).join(small(template.groupBy("joint").agg(F.avg("c").alias("_b"))), "joint")
    product = clip(F.col("_a")) * clip(F.col("_b"))
    return rows.select(key, "joint", (product / F.sum(product).over(Window.partitionBy(key))).alias("weight"))


def turn_index(start: Column, turn: Column, end: Column, length: int) -> Column:
    """Place of the turn after resampling to `length` points."""
    share = (turn - start) / F.nullif((end - start).cast("double"), F.lit(0.0))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (length - 1), 0).cast("int")


def phase_of(t: Column, turn: Column, length: int) -> Column:
    """Name of the third before (ecc_1 .. 3) or after (con_1 .. 3) the turn."""
    before = F.least(F.floor(3 * t / F.greatest(turn, F.lit(1))), F.lit(2)) + 1
    after = F.least(F.floor(3 * (t - turn) / F.greatest(F.lit(length) - turn, F.lit(1))), F.lit(2)) + 1
    return F.when(t < turn, F.concat(F.lit("ecc_"), before.cast("string"))).otherwise(F.concat(F.lit("con_"), after.cast("string")))


def moments(reps: DataFrame) -> DataFrame:
    """Five time points of each repetition in seconds."""
    half = lambda a, b: (F.col(a) + F.col(b)) / 2
    points = F.array(*[F.struct(F.lit(n).alias("moment"), (f / F.col("fps")).alias("at_s")) for n, f in (("start", F.col("start_frame")), ("first_half", half("start_frame", "turn_frame")), ("turn", F.col("turn_frame")), ("second_half", half("turn_frame", "end_frame")), ("end", F.col("end_frame")))])
    return reps.select("rep_id", F.inline(points))


def shortest_phase(points: DataFrame, spans: DataFrame, default: str = "rep") -> DataFrame:
    """The shortest phase (rep_id, phase, a, b) that holds each point (rep_id, frame)."""
    hit = points.join(spans, "rep_id", "left").withColumn("_in", F.col("frame").between(F.col("a"), F.col("b")))
    return hit.groupBy("rep_id", "frame").agg(F.coalesce(F.min_by(F.when(F.col("_in"), F.col("phase")), F.when(F.col("_in"), F.struct(F.col("b") - F.col("a"), F.col("phase")))), F.lit(default)).alias("phase"))


def evidence_rows(values: DataFrame, key: str, primitives: DataFrame) -> DataFrame:
    """A map of values as evidence rows with the primitives' plane, unit and phase."""
    long = values.select(key, F.explode("values").alias("primitive", "value"))
    return long.withColumn("value", finite("value")).join(small(primitives), "primitive", "left")


def names_by_state(evidence: DataFrame, key: str) -> DataFrame:
    by = lambda s: F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("primitive")))).alias(s)
    return evidence.groupBy(key).agg(by("measured"), by("unmeasured"), by("view_blocked"))


def clamped_windows(rows: DataFrame, least_s: float = 3.0, most_share: float = 0.98) -> DataFrame:
    """Technique windows clamped to the clip; usable if long enough and not nearly all of it."""
    start = F.greatest(F.lit(0.0), F.col("start").try_cast("double"))
    end = F.least(F.col("duration"), F.col("end").try_cast("double"))
    rows = rows.withColumn("start_s", start).withColumn("end_s", end)
    # greatest and least skip nulls: an unreadable end is no window
    readable = F.col("start").try_cast("double").isNotNull() & F.col("end").try_cast("double").isNotNull()
    length = F.when(readable, F.col("end_s") - F.col("start_s"))
    return rows.withColumn("usable", F.coalesce((length >= least_s) & (length < most_share * F.col("duration")), F.lit(False)))


def invented_numbers(texts: DataFrame, facts: DataFrame, key: str, most_ordinal: int = 10) -> DataFrame:
    """Numbers of a text that no fact of its key gives at that precision; small
    whole numbers are allowed.  Rounding is half up."""
    found = texts.select(key, F.explode(F.regexp_extract_all("text", F.lit(r"(-?\d+(?:[.,]\d+)?)"), F.lit(1))).alias("raw"))
    found = found.withColumn("_d", F.length(F.regexp_extract("raw", r"[.,](\d+)$", 1))).withColumn("number", F.replace("raw", F.lit(","), F.lit(".")).cast("double"))
    found = found.filter(~((F.col("_d") == 0) & F.col("number").between(0, most_ordinal)))
    keyed = facts.select(key, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("_d"), "fact").withColumn("number", F.expr("round(fact * pow(10, _d)) / pow(10, _d)"))
    return found.join(keyed.select(key, "_d", "number").distinct(), [key, "_d", "number"], "left_anti").select(key, "raw").distinct()
