"""Holds: runs of frames with a level body, their phases and measures.

frames: one row per video and frame (columns <joint>_x, <joint>_y, <joint>_c), frames
counted without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.num import finite, frac, pct, spread
from kinelake.operators import pose, sequences

#: The body line of a hold in degrees, its least length and window in seconds, straight limbs.
HORIZONTAL, LEAST_S, ENDPOINT_S, STRAIGHT = 70.0, 0.6, 0.10, 160.0
LEAST_CONFIDENCE = 0.35


def attempts(frames: DataFrame, fps: float = 30.0, horizontal: float = HORIZONTAL, least_s: float = LEAST_S) -> DataFrame:
    """video, hold (1, 2, ...), start_frame and end_frame of runs with the body held level long enough."""
    rows = frames.select("video", "frame", pose.body_line(LEAST_CONFIDENCE).alias("line"))
    runs = sequences.islands(rows, ["video"], "frame", F.coalesce(F.col("line") >= horizontal, F.lit(False)))
    runs = runs.filter(F.col("length") / F.lit(float(fps)) >= least_s)
    number = F.row_number().over(Window.partitionBy("video").orderBy("first"))
    return runs.select("video", number.alias("hold"), F.col("first").alias("start_frame"), F.col("last").alias("end_frame"))


def phases(holds: DataFrame, fps: float = 30.0) -> DataFrame:
    """video, hold, phase, a and b: the hold, its onset, sustained middle and exit."""
    start, end = F.col("start_frame"), F.col("end_frame")
    half = max(1, round(ENDPOINT_S * max(fps, 1.0)))
    onset, leave = F.least(end, start + half), F.greatest(start, end - half)
    middle_a, middle_b = F.least(onset + 1, end), F.greatest(leave - 1, start)
    crossed = middle_b < middle_a
    rows = [("hold", start, end), ("onset", start, onset), ("sustained", F.when(crossed, start).otherwise(middle_a), F.when(crossed, end).otherwise(middle_b)), ("exit", leave, end)]
    return holds.select("video", "hold", F.inline(F.array(*[F.struct(F.lit(n).alias("phase"), a.cast("long").alias("a"), b.cast("long").alias("b")) for n, a, b in rows])))


def _limb(part: tuple[str, str, str], ok: Column) -> Column:
    """Both sides' angles as an array, null where not seen."""
    return F.array(*[F.when(ok, pose.angle(*(f"{s}_{j}" for j in part), least=0.0)) for s in ("left", "right")])


def metrics(frames: DataFrame, holds: DataFrame, fps: float = 30.0, horizontal: float = HORIZONTAL) -> DataFrame:
    """Body line, level share, pike, swing and length of each hold.

    Straight arms and legs and the hips' angle are those of the whole clip.
    """
    seen = {j: pose.confident(f"left_{j}", f"right_{j}", least=LEAST_CONFIDENCE) for j in ("shoulder", "hip", "ankle", "wrist")}
    limbs = {
        "arms": _limb(("shoulder", "elbow", "wrist"), seen["shoulder"] & seen["wrist"]),
        "legs": _limb(("hip", "knee", "ankle"), seen["hip"] & seen["ankle"]),
        "pike": _limb(("shoulder", "hip", "knee"), seen["shoulder"] & seen["hip"]),
    }
    long = frames.select("video", F.inline(F.arrays_zip(*[v.alias(k) for k, v in limbs.items()])))
    clips = long.groupBy("video").agg(frac("arms", STRAIGHT).alias("arms_straight_frac"), frac("legs", STRAIGHT).alias("legs_straight_frac"), pct("pike", 50).alias("hip_pike_deg"))
    side = (pose.midpoint("left_hip", "right_hip")[0] - pose.midpoint("left_shoulder", "right_shoulder")[0]) / F.nullif(F.col("torso"), F.lit(0.0))
    rows = frames.join(pose.clip_torso(frames), "video").select("video", "frame", pose.body_line(LEAST_CONFIDENCE).alias("line"), side.alias("side"))
    rows = rows.join(holds, "video").filter(F.col("frame").between(F.col("start_frame"), F.col("end_frame")))
    out = rows.groupBy("video", "hold").agg(
        pct("line", 50).alias("body_line_deg"),
        frac("line", horizontal).alias("horizontal_frac"),
        spread(finite("side")).alias("swing"),
        ((F.first("end_frame") - F.first("start_frame")) / F.lit(float(fps))).alias("sustain_s"),
    )
    return out.join(clips, "video")


def evidence(measures: DataFrame) -> DataFrame:
    """measures as rows of primitives for the rules: measured where there is a value."""
    names = [c for c in measures.columns if c not in ("video", "hold")]
    cells = F.array(*[F.struct(F.lit(n).alias("primitive"), finite(n).alias("value")) for n in names])
    rows = measures.select("video", "hold", F.inline(cells))
    return rows.withColumn("state", F.when(F.col("value").isNull(), "unmeasured").otherwise("measured"))
