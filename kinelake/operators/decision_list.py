"""Which movement a clip shows: an ordered decision list over its features.

Branches are data: gates that must all hold, an outcome, a margin and the next best
outcome.  The first branch whose gates hold decides.  A gate is three-valued: a
feature that was not measured neither passes nor fails, it leaves the gate unmeasured,
and an unmeasured gate never lets a branch through, be it the opposite of another.
The first gate that kept each earlier branch from deciding stays in `trace`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.num import finite
from kinelake.operators.clip_features import ANCHOR_FIXED, MIN_SEEN, MOSTLY_UNSEEN, OVER_BAR

#: The limits of the gates.
ARTICULATION, BELOW_HANDS_DIP, KNEES_UP, HOLD_FRAC = 0.20, 0.25, 0.10, 0.55
SPLIT_HEIGHT_MIN, BULGARIAN_REAR = 0.08, 0.25
CLEAR_MARGIN = 0.65


@dataclass(frozen=True)
class Gate:
    """feature (comparison) limit; the limit is a number or another feature.

    `missing` and `not known >=` ask what was measured and so are never unmeasured.
    """

    feature: str
    comparison: str
    limit: float | str

    def column(self) -> Column:
        value = finite(F.col(self.feature))
        limit = finite(F.col(self.limit)) if isinstance(self.limit, str) else F.lit(float(self.limit))
        at_least = value >= limit
        return {">=": at_least, "<=": value <= limit, "<": value < limit, "missing": value.isNull(), "not known >=": ~F.coalesce(at_least, F.lit(False))}[self.comparison]


@dataclass(frozen=True)
class Branch:
    """name: what was seen; gates in order; outcome; margin as a number or (base, width, sign, feature, limit)."""

    name: str
    gates: tuple[Gate, ...]
    outcome: str
    margin: float | tuple[float, float, int, str, float] = 0.0
    runner_up: str | None = None

    def margin_column(self) -> Column:
        if not isinstance(self.margin, tuple):
            return F.lit(float(self.margin))
        base, width, sign, feature, limit = self.margin
        return F.lit(base) + F.lit(width) * F.least(F.lit(1.0), sign * (F.col(feature) - limit) / 0.35)


ANCHORED = (Gate("wrist_window_travel", "<=", ANCHOR_FIXED), Gate("wrist_window_seen", ">=", MIN_SEEN))
PLANTED = (Gate("ankle_window_travel", "<=", ANCHOR_FIXED), Gate("ankle_window_seen", ">=", MIN_SEEN))
OVERHEAD = Gate("hands_overhead_frac", ">=", 0.35)
BELOW = Gate("hands_below_frac", ">=", 0.80)
LEVEL = Gate("body_line_deg", ">=", 70.0)
ARTICULATED = Gate("arm_articulation", ">=", ARTICULATION)
DESCENT = Gate("hip_travel", ">=", 0.35)
SPLIT = (*PLANTED, Gate("split_ankle_heights", ">=", SPLIT_HEIGHT_MIN), DESCENT)
PRESS = (*ANCHORED, ARTICULATED, BELOW)
LEGS_BELOW = Gate("body_below_hands", ">=", BELOW_HANDS_DIP)

#: The sixteen outcomes, in the order of their trial.
BRANCHES = (
    Branch("horizontal_hang", (*ANCHORED, OVERHEAD, LEVEL), "front_lever", 0.72, "pull_up"),
    Branch("horizontal_press", (*ANCHORED, BELOW, LEVEL, Gate("legs_lifted_frac", ">=", 0.5)), "planche", 0.72, "push_up"),
    Branch("parked", (*ANCHORED, OVERHEAD, Gate("parked_frac", ">=", HOLD_FRAC)), "unknown"),
    Branch("knees_up", (*ANCHORED, OVERHEAD, Gate("knee_over_hip", ">=", KNEES_UP), Gate("knee_excursion", ">=", "arm_articulation")), "knee_raise", 0.80, "pull_up"),
    Branch("over_the_bar", (*ANCHORED, ARTICULATED, OVERHEAD, Gate("shoulder_above_hands_p95", ">=", OVER_BAR)), "muscle_up", (0.70, 0.28, 1, "shoulder_above_hands_p95", OVER_BAR), "pull_up"),
    Branch("below_the_bar", (*ANCHORED, ARTICULATED, OVERHEAD), "pull_up", (0.70, 0.25, -1, "shoulder_above_hands_p95", OVER_BAR), "muscle_up"),
    Branch("one_leg", (*PLANTED, Gate("single_leg_stance", ">=", 1.0), DESCENT), "pistol_squat", 0.74, "squat"),
    Branch("rear_foot_raised", (*SPLIT, Gate("rear_raised", ">=", BULGARIAN_REAR)), "bulgarian_split_squat", 0.74, "split_squat"),
    Branch("split_stance", SPLIT, "split_squat", 0.70, "bulgarian_split_squat"),
    Branch("rigid_arms", (*PLANTED, Gate("arm_articulation", "<", ARTICULATION), DESCENT), "squat", 0.78),
    Branch("body_unseen", (*PRESS, Gate("body_below_hands", "missing", 0)), "unknown"),
    Branch("feet_unseen", (*PRESS, LEGS_BELOW, Gate("ankle_window_seen", "not known >=", MIN_SEEN), Gate("ankle_seen", "not known >=", MIN_SEEN)), "unknown", 0.0, "squat"),
    Branch("legs_below_hands", (*PRESS, LEGS_BELOW), "dip", 0.78, "push_up"),
    Branch("nothing_below_hands", PRESS, "push_up", 0.78, "dip"),
    Branch("nothing_fixed", (Gate("fixed", "<", 1.0),), "unknown"),
    Branch("no_branch", (), "unknown"),
)


def not_fixed(travel: Column, seen: Column, seen_clip: Column) -> Column:
    """What kept a pair of joints from counting as fixed: unseen, out_of_frame or moved."""
    unmeasured = finite(travel).isNull() | F.coalesce(seen < MIN_SEEN, F.lit(True))
    return F.when(unmeasured, "unseen").when(seen_clip < MOSTLY_UNSEEN, "out_of_frame").otherwise("moved")


def decided(features: DataFrame, branches: tuple[Branch, ...] = BRANCHES) -> DataFrame:
    """features with movement, branch, margin, runner_up, clear, trace and, where nothing was fixed, hands and feet.

    trace: for each branch before the deciding one, its first gate that failed or
    could not be measured (branch, gate, measured).
    """
    whole = lambda gates: reduce(lambda a, b: a & b, [F.coalesce(g.column(), F.lit(False)) for g in gates])
    # infinite travel is an unseen joint: not finite, so unmeasured
    rows = features.withColumn("fixed", (whole(ANCHORED) | whole(PLANTED)).cast("double"))

    def kept_out(branch: Branch) -> Column:
        """The first gate that didn't pass; null if all did."""
        out = F.lit(None)
        for g in reversed(branch.gates):
            passed = F.coalesce(g.column(), F.lit(False))
            gate = F.struct(F.lit(branch.name).alias("branch"), F.lit(f"{g.feature} {g.comparison} {g.limit}").alias("gate"), g.column().isNotNull().alias("measured"))
            out = F.when(passed, out).otherwise(gate)
        return out.cast("struct<branch: string, gate: string, measured: boolean>")

    rows = rows.withColumn("_out", F.array(*[kept_out(b) for b in branches]))
    # the place of the first branch that nothing kept out; the last one has no gate
    rows = rows.withColumn("_k", F.array_position(F.transform("_out", lambda g: g.isNull()), True).cast("int"))
    pick = lambda value: F.element_at(F.array(*[value(b) for b in branches]), F.col("_k"))
    text = lambda v: F.lit(v).cast("string")
    rows = rows.withColumns({
        "movement": pick(lambda b: text(b.outcome)),
        "branch": pick(lambda b: text(b.name)),
        "margin": pick(lambda b: b.margin_column()),
        "runner_up": pick(lambda b: text(b.runner_up)),
        "trace": F.slice("_out", F.lit(1), F.col("_k") - 1),
    })
    rows = rows.withColumn("clear", F.col("margin") >= CLEAR_MARGIN)
    loose = F.col("branch") == "nothing_fixed"
    rows = rows.withColumns({part: F.when(loose, not_fixed(F.col(f"{j}_window_travel"), F.col(f"{j}_window_seen"), F.col(f"{j}_seen"))) for part, j in (("hands", "wrist"), ("feet", "ankle"))})
    return rows.drop("_out", "_k", "fixed")
