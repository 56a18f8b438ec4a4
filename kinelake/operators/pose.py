"""Pose geometry over one row per frame (columns <joint>_x, <joint>_y, <joint>_c).

y grows downwards.  A measurement is null where its joints are not confident.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.num import finite, med, pct
from kinelake.sources.tables import BODY

CONFIDENT = 0.5
#: Azimuth limits of the camera bins.
BIN_EDGES = (("SAGITTAL", 0.0, 20.0), ("OBLIQUE", 20.0, 65.0), ("FRONTAL", 65.0, 91.0))


def xy(joint: str) -> tuple[Column, Column, Column]:
    return F.col(f"{joint}_x"), F.col(f"{joint}_y"), F.col(f"{joint}_c")


def midpoint(a: str, b: str) -> tuple[Column, Column]:
    return (F.col(f"{a}_x") + F.col(f"{b}_x")) / 2, (F.col(f"{a}_y") + F.col(f"{b}_y")) / 2


def confident(*joints: str, least: float = CONFIDENT) -> Column:
    out = F.lit(True)
    for j in joints:
        out = out & (F.coalesce(F.col(f"{j}_c"), F.lit(0.0)) >= least)
    return out


def frame_confidence() -> Column:
    return sum((F.coalesce(F.col(f"{j}_c"), F.lit(0.0)) for j in BODY), F.lit(0.0)) / len(BODY)


def length(dx: Column, dy: Column) -> Column:
    """As SQL writes it, so that values on a limit fall on the same side of it."""
    return F.sqrt(dx * dx + dy * dy)


def even_mean(confidence: Column) -> Column:
    """A mean for comparisons: sums of whole billionths have no order, so equal means are equal."""
    return F.avg(F.rint(confidence * 1e9))


def torso_length() -> Column:
    (sx, sy), (hx, hy) = midpoint("left_shoulder", "right_shoulder"), midpoint("left_hip", "right_hip")
    return length(sx - hx, sy - hy)


def distance(a: str, b: str) -> Column:
    return length(F.col(f"{a}_x") - F.col(f"{b}_x"), F.col(f"{a}_y") - F.col(f"{b}_y"))


def angle(a: str, b: str, c: str, least: float = CONFIDENT) -> Column:
    """Inner angle at b in degrees; null for unseen joints and a side of length 0."""
    ux, uy = F.col(f"{a}_x") - F.col(f"{b}_x"), F.col(f"{a}_y") - F.col(f"{b}_y")
    vx, vy = F.col(f"{c}_x") - F.col(f"{b}_x"), F.col(f"{c}_y") - F.col(f"{b}_y")
    cos = (ux * vx + uy * vy) / F.nullif(length(ux, uy) * length(vx, vy), F.lit(0.0))
    # greatest and least skip nulls
    return F.when(confident(a, b, c, least=least) & cos.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def both_sides(part: tuple[str, str, str]) -> Column:
    """Mean of the left and right angle, or the one that is seen."""
    left, right = (angle(*[f"{side}_{j}" for j in part]) for side in ("left", "right"))
    return F.coalesce((left + right) / 2, left, right)


def hip_above_ankle(torso: Column, lower: bool = False) -> Column:
    """Height of the hips over the ankles (over the lower one) in torso lengths."""
    ankle = F.greatest("left_ankle_y", "right_ankle_y") if lower else midpoint("left_ankle", "right_ankle")[1]
    return F.when(confident("left_hip", "right_hip", "left_ankle", "right_ankle"), (ankle - midpoint("left_hip", "right_hip")[1]) / torso)


def hip_line_offset(torso: Column) -> Column:
    """Signed distance of the hips from the line of shoulders and ankles; a vertical line counts as one to the right."""
    (sx, sy), (hx, hy), (ax, ay) = midpoint("left_shoulder", "right_shoulder"), midpoint("left_hip", "right_hip"), midpoint("left_ankle", "right_ankle")
    cross = (ax - sx) * (hy - sy) - (ay - sy) * (hx - sx)
    return F.when(confident("left_shoulder", "right_shoulder", "left_hip", "right_hip", "left_ankle", "right_ankle"), cross / F.nullif(length(ax - sx, ay - sy), F.lit(0.0)) / torso * F.when(ax - sx < 0, -1.0).otherwise(1.0))


def body_line(least: float = CONFIDENT) -> Column:
    """Angle of the trunk from the vertical, in degrees."""
    (sx, sy), (hx, hy) = midpoint("left_shoulder", "right_shoulder"), midpoint("left_hip", "right_hip")
    return F.when(confident("left_shoulder", "right_shoulder", "left_hip", "right_hip", least=least), F.degrees(F.atan2(F.abs(sx - hx), F.greatest(F.abs(sy - hy), F.lit(1e-6)))))


def side_pair(frames: DataFrame, joint: str, clip: str = "video", both_share: float = 0.55) -> DataFrame:
    """<joint>_px, _py and _pc: the midpoint of both sides, or the near side.

    Decided once per clip: the midpoint if both are seen in enough frames, else
    the side with the higher mean confidence (of equal ones, the left).
    """
    (lx, ly, lc), (rx, ry, rc) = xy(f"left_{joint}"), xy(f"right_{joint}")
    w = Window.partitionBy(clip)
    both = F.avg(((lc >= CONFIDENT) & (rc >= CONFIDENT)).cast("double")).over(w) >= both_share
    left = even_mean(lc).over(w) >= even_mean(rc).over(w)
    pick = lambda m, a, b: F.when(both, m).when(left, a).otherwise(b)
    return frames.withColumns({f"{joint}_px": pick((lx + rx) / 2, lx, rx), f"{joint}_py": pick((ly + ry) / 2, ly, ry), f"{joint}_pc": pick(F.least(lc, rc), lc, rc)})


def clip_torso(frames: DataFrame, clip: str = "video") -> DataFrame:
    """Median torso of confident frames per clip, of any positive one otherwise."""
    rows = frames.select(clip, torso_length().alias("_t"), frame_confidence().alias("_c")).filter("_t > 0")
    return rows.groupBy(clip).agg(F.coalesce(F.percentile(F.when(F.col("_c") >= CONFIDENT, F.col("_t")), F.lit(0.5)), F.percentile("_t", F.lit(0.5))).alias("torso"))


def normalised(frames: DataFrame, clip: str = "video", per_frame: bool = False) -> DataFrame:
    """Hip midpoint at the origin, torso of the clip (or frame) as unit; rotation stays."""
    hx, hy = midpoint("left_hip", "right_hip")
    rows = frames.withColumns({"_hx": hx, "_hy": hy, "_own": torso_length()})
    rows = rows.withColumn("torso", F.col("_own")) if per_frame else rows.join(clip_torso(frames, clip), clip)
    unit = F.nullif(F.col("torso"), F.lit(0.0))
    out = [((F.col(f"{j}_{k}") - F.col(f"_h{k}")) / unit).alias(f"n_{j}_{k}") for j in BODY for k in "xy"]
    return rows.select(clip, "frame", *out, *[F.col(f"{j}_c").alias(f"c_{j}") for j in BODY], "torso")


def anchor_travel(frames: DataFrame, joint: str, clip: str = "video") -> DataFrame:
    """Robust travel of a joint pair in torso lengths; infinite for fewer than 5 frames."""
    rows = side_pair(frames, joint, clip).filter(F.col(f"{joint}_pc") >= CONFIDENT).join(clip_torso(frames, clip), clip)
    q = lambda c: F.percentile(c, F.lit(0.95)) - F.percentile(c, F.lit(0.05))
    out = rows.groupBy(clip).agg((length(q(f"{joint}_px"), q(f"{joint}_py")) / F.first("torso")).alias("_t"), F.count(F.lit(1)).alias("_n"))
    return out.select(clip, F.when(F.col("_n") < 5, float("inf")).otherwise(F.col("_t")).alias("travel"))


def arm_reach(frames: DataFrame, clip: str = "video") -> DataFrame:
    """97th percentile of shoulder to wrist per side (10 frames or more), mean of the sides."""
    side = lambda s: F.when(confident(f"{s}_shoulder", f"{s}_wrist"), distance(f"{s}_shoulder", f"{s}_wrist"))
    rows = frames.join(clip_torso(frames, clip), clip).select(clip, "torso", side("left").alias("l"), side("right").alias("r"))
    reach = lambda c: F.when(F.count(c) >= 10, pct(c, 97))
    out = rows.groupBy(clip).agg(reach("l").alias("l"), reach("r").alias("r"), F.first("torso").alias("torso"))
    return out.select(clip, (F.coalesce((F.col("l") + F.col("r")) / 2, "l", "r") / F.col("torso")).alias("arm_reach"))


def azimuth_bin(theta: Column) -> Column:
    return F.when(theta < 20, "SAGITTAL").when(theta < 65, "OBLIQUE").when(theta >= 65, "FRONTAL").otherwise("UNKNOWN")


def azimuth(apparent: Column, true_ratio: Column) -> Column:
    """Camera azimuth from the apparent over the true shoulder width, in degrees."""
    ratio = apparent / true_ratio
    return F.when(ratio.isNotNull(), F.degrees(F.asin(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))))


def settled_bin(theta: Column, low: Column, high: Column, share: float = 0.8) -> Column:
    """theta's bin if it covers a share of [low, high], else UNKNOWN."""
    name = azimuth_bin(theta)
    inside = None
    for b, lo, hi in BIN_EDGES:
        part = F.greatest(F.lit(0.0), F.least(high, F.lit(hi)) - F.greatest(low, F.lit(lo)))
        inside = F.when(name == b, part) if inside is None else inside.when(name == b, part)
    return F.when(high <= low, name).when(inside / (high - low) >= share, name).otherwise("UNKNOWN")


def camera_side(frames: DataFrame, clip: str = "video", least: int = 10, agree: float = 0.7) -> DataFrame:
    """Side of the camera by the majority sign of shoulder order."""
    dx = F.when(confident("left_shoulder", "right_shoulder"), F.col("left_shoulder_x") - F.col("right_shoulder_x"))
    rows = frames.select(clip, dx.alias("_d")).groupBy(clip).agg(F.count("_d").alias("_n"), F.avg((F.col("_d") > 0).cast("double")).alias("_p"))
    share = F.greatest("_p", 1 - F.col("_p"))
    side = F.when((F.col("_n") >= least) & (share >= agree), F.when(F.col("_p") >= 0.5, "left").otherwise("right")).otherwise("unknown")
    return rows.select(clip, side.alias("side"), share.alias("side_confidence"))


def measured_phases(frames: DataFrame, spans: DataFrame, value: str) -> DataFrame:
    """Median, range and coverage of a frame value in each phase."""
    rows = spans.join(frames.select("video", "frame", value), "video").filter(F.col("frame").between(F.col("a"), F.col("b")))
    return rows.groupBy("rep_id", "phase").agg(med(value).alias("median"), (F.max(finite(value)) - F.min(finite(value))).alias("travel"), (F.count(finite(value)) / F.count(F.lit(1))).alias("coverage"), F.count(finite(value)).alias("samples"))


def mirrored(pose: DataFrame) -> DataFrame:
    """Long pose rows reflected in x, with left and right exchanged."""
    swapped = F.when(F.startswith("joint", F.lit("left_")), F.concat(F.lit("right_"), F.substring("joint", 6, 99))).when(F.startswith("joint", F.lit("right_")), F.concat(F.lit("left_"), F.substring("joint", 7, 99))).otherwise(F.col("joint"))
    return pose.withColumn("x", -F.col("x")).withColumn("joint", swapped)


def cropped(frames: DataFrame, start: float, end: float, clip: str = "video") -> DataFrame:
    """The part of each clip between two fractions of its length."""
    w = Window.partitionBy(clip)
    n = F.max("frame").over(w) + 1
    return frames.withColumn("_n", n).filter((F.col("frame") >= F.floor(F.col("_n") * start)) & (F.col("frame") < F.ceil(F.col("_n") * end))).drop("_n")


#: Range of a plausible shoulder width in torsos, and the agreement on a side.
PRIOR_RANGE, SIDE_AGREEMENT = (0.65, 0.95), 0.70


def apparent_ratios(frames: DataFrame, clip: str = "video") -> DataFrame:
    """Shoulder width over the clip's torso in frames that see both shoulders."""
    rows = frames.filter(confident("left_shoulder", "right_shoulder")).join(clip_torso(frames, clip), clip)
    return rows.select(clip, "frame", (distance("left_shoulder", "right_shoulder") / F.nullif(F.col("torso"), F.lit(0.0))).alias("ratio"))


def estimated_view(frames: DataFrame, clip: str = "video", least: int = 10) -> DataFrame:
    """Camera bin of each clip from its own widest shoulders, and why it can't be trusted.

    theta from the median ratio against the 97th percentile; refused for few frames, a
    ruler outside the plausible range, an unclear side or an angle outside every bin.
    """
    ratio = apparent_ratios(frames, clip).groupBy(clip).agg(F.count("ratio").alias("n"), pct("ratio", 97).alias("ruler"), med("ratio").alias("_median"))
    rows = frames.select(clip).distinct().join(ratio, clip, "left").join(camera_side(frames, clip, least, SIDE_AGREEMENT), clip, "left")
    theta = azimuth(F.col("_median"), F.greatest("ruler", F.lit(1e-6)))
    rows = rows.withColumn("theta", theta).withColumn("bin", azimuth_bin(F.col("theta")))
    few = F.coalesce("n", F.lit(0)) < least
    reason = F.when(few, "few frames").when(~F.col("ruler").between(*PRIOR_RANGE), "implausible ruler").when(~F.coalesce(F.col("side_confidence") >= SIDE_AGREEMENT, F.lit(False)), "unclear side").when(F.col("bin") == "UNKNOWN", "outside every bin")
    return rows.select(clip, F.when(~few, F.col("bin")).otherwise("UNKNOWN").alias("bin"), "side", "ruler", F.when(~few, F.col("theta")).alias("theta"), reason.isNull().alias("knowable"), reason.alias("reason"))
