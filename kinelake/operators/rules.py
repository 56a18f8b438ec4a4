"""Rule registry, three-valued evidence, verdicts and the choice of what to fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.num import exceedance, fires
from kinelake.operators.relational import small

RULE_SCHEMA = "rule string, movement string, error string, name string, phase string, primitive string, comparison string, threshold double, variants array<string>"

#: The rules in order of the catalogue.  Columns: movement, error, display
#: name, phase, primitive, comparison, threshold, variants.  A rule's id is movement.error;
#: a rule with variants depends on the variant and counts for an unstated one too.
REGISTRY = """\
front_lever,body_below_horizontal,poor range of motion,hold,body_line_deg,<,75,
front_lever,bent_arms,poor scapular retraction,hold,arms_straight_frac,<,0.25,
front_lever,bent_knees,bent knees,hold,legs_straight_frac,<,0.6,full
front_lever,piked_hips,piked hips,hold,hip_pike_deg,<,150,full straddle
front_lever,body_swing,momentum,hold,swing,>,0.4,
planche,body_below_horizontal,poor range of motion,hold,body_line_deg,<,75,
planche,bent_arms,poor scapular protraction,hold,arms_straight_frac,<,0.35,
planche,bent_knees,bent knees,hold,legs_straight_frac,<,0.6,full
planche,piked_body,piked body,hold,hip_pike_deg,<,150,full straddle
planche,body_swing,momentum,hold,swing,>,0.4,
muscle_up,body_swing,momentum,rep,swing,>,0.4,strict
muscle_up,incomplete_lockout,lockout,support,lockout_pct,<,85,
muscle_up,incomplete_hang,dead hang,setup,hang_pct,<,75,
muscle_up,dropped_descent,control,rep,tempo_ratio,<,0.7,
muscle_up,lift_stall,stall,lifting,stalled_frac,>=,0.05,
muscle_up,slow_transition,poor transition,transition,transition_s,>,0.6,
muscle_up,incomplete_support_extension,bent arms,support,top_elbow_deg,<,160,
pull_up,body_swing,momentum,rep,swing,>,0.4,strict
pull_up,incomplete_lockout,lockout,support,lockout_pct,<,-27.6,
pull_up,incomplete_hang,dead hang,setup,hang_pct,<,75,
pull_up,dropped_descent,control,rep,tempo_ratio,<,0.7,
pull_up,lift_stall,stall,lifting,stalled_frac,>=,0.05,
pull_up,no_active_hang,no active hang,setup,start_elbow_deg,<,150,
pull_up,fast_lift,too fast,lifting,fast_ratio,<,0.5,
dip,incomplete_lockout,lockout,support,start_elbow_deg,<,160,
dip,excessive_depth,too deep,turnaround,bottom_elbow_deg,<,90,
dip,bounce,bounce at bottom,turnaround,turn_speed,>,0.15,
dip,dropped_descent,control,rep,tempo_ratio,<,0.7,
dip,lift_stall,stall,lifting,stalled_frac,>=,0.05,
push_up,short_travel,poor range of motion,rep,travel,<,0.35,
push_up,incomplete_lockout,lockout,support,start_elbow_deg,<,160,
push_up,hip_sag,sagging hips,rep,hip_sag,>,0.12,
push_up,dropped_descent,control,rep,tempo_ratio,<,0.7,
push_up,lift_stall,stall,lifting,stalled_frac,>=,0.05,
squat,shallow_depth,poor range of motion,rep,squat_depth,<,0.35,
squat,dropped_descent,uncontrolled descent,rep,tempo_ratio,<,0.7,
squat,knee_medial_drift,knee valgus,rep,knee_valgus,>,0.12,
squat,planted_ankle_rise,heel raise,rep,heel_rise,>,0.06,
squat,lift_stall,stall,lifting,stalled_frac,>=,0.05,
pistol_squat,shallow_depth,poor range of motion,rep,pistol_depth,<,0.55,
pistol_squat,knee_medial_drift,knee valgus,rep,knee_valgus,>,0.12,
pistol_squat,planted_ankle_rise,heel raise,rep,heel_rise,>,0.06,
pistol_squat,backward_lean,leaning back,rep,torso_lean,<,-0.3,
pistol_squat,dropped_descent,uncontrolled descent,rep,tempo_ratio,<,0.7,
pistol_squat,arm_swing,arm swing,rep,swing,>,0.4,
split_squat,shallow_depth,poor range of motion,rep,split_depth,<,0.35,
split_squat,knee_medial_drift,knee valgus,rep,knee_valgus,>,0.12,
split_squat,planted_ankle_rise,heel raise,rep,heel_rise,>,0.06,
split_squat,backward_lean,leaning back,rep,torso_lean,<,-0.3,
split_squat,dropped_descent,uncontrolled descent,rep,tempo_ratio,<,0.7,
bulgarian_split_squat,shallow_depth,poor range of motion,rep,split_depth,<,0.35,
bulgarian_split_squat,knee_medial_drift,knee valgus,rep,knee_valgus,>,0.12,
bulgarian_split_squat,planted_ankle_rise,heel raise,rep,heel_rise,>,0.06,
bulgarian_split_squat,backward_lean,leaning back,rep,torso_lean,<,-0.3,
bulgarian_split_squat,dropped_descent,uncontrolled descent,rep,tempo_ratio,<,0.7,
"""

#: Variants that a movement may declare.
KNOWN_VARIANTS = {"pull_up": ("strict", "kipping"), "muscle_up": ("strict", "kipping"), "front_lever": ("full", "tuck", "straddle"), "planche": ("full", "tuck", "straddle")}


def registry(spark: SparkSession) -> DataFrame:
    """The rules as a table of fixed size."""
    rows = []
    for line in REGISTRY.splitlines():
        movement, error, name, phase, primitive, comparison, threshold, variants = line.split(",")
        rows.append((f"{movement}.{error}", movement, error, name, phase, primitive, comparison, float(threshold), variants.split()))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def declared_variant(movement: Column, declared: Column) -> Column:
    """The declared variant if its movement knows it, else unspecified."""
    raw = F.translate(F.lower(F.trim(F.coalesce(declared, F.lit("")))), "- ", "__")
    known = F.lit(False)
    for name, variants in KNOWN_VARIANTS.items():
        known = known | ((movement == name) & raw.isin(*variants))
    return F.when(known, raw).otherwise("unspecified")


def knowability(value: Column, coverage: Column, samples: Column, shown: Column, least_coverage: float = 0.60, least_samples: int = 3) -> Column:
    """unmeasured, view_blocked or measured; the first reason counts."""
    return F.when(value.isNull() | F.isnan(value), "unmeasured").when(coverage < least_coverage, "unmeasured").when(samples < least_samples, "unmeasured").when(~F.coalesce(shown, F.lit(False)), "view_blocked").otherwise("measured")


def applies(variant: Column, variants: Column) -> Column:
    return (F.size(variants) == 0) | variant.isNull() | variant.isin("", "unspecified") | F.array_contains(variants, variant)


def assessed(subjects: DataFrame, rules: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """Every rule of a subject's movement: observed, not_observed or unobservable.

    subjects: key, movement, variant, blocked; evidence: key, primitive, value,
    state.  A blocked subject is unobservable throughout.
    """
    rows = subjects.join(small(rules), "movement").filter(applies(F.col("variant"), F.col("variants")))
    rows = rows.join(evidence.select(*key, "primitive", "value", "state"), [*key, "primitive"], "left")
    fired = fires(F.col("value"), F.col("comparison"), F.col("threshold"))
    status = F.when(F.coalesce("blocked", F.lit(False)), "unobservable").when(F.coalesce(F.col("state") != "measured", F.lit(True)), "unobservable").when(fired, "observed").otherwise("not_observed")
    reason = F.when(F.coalesce("blocked", F.lit(False)), "blocked").when(F.col("state").isNull(), "no_evidence").when(F.col("state") != "measured", F.col("state"))
    return rows.withColumn("status", status).withColumn("reason", reason).withColumn("exceedance", F.when(F.col("status") == "observed", exceedance(F.col("value"), F.col("threshold"), F.col("comparison"))))


def summarised(assessments: DataFrame, group: list[str]) -> DataFrame:
    return assessments.groupBy(*group, "error").agg(F.count_if(F.col("status") == "observed").alias("observed"), F.count_if(F.col("status") == "not_observed").alias("not_observed"), F.count_if(F.col("status") == "unobservable").alias("unobservable"))


def consensus_faults(assessments: DataFrame, clip: list[str], rep: str, least: int = 2) -> DataFrame:
    """Faults observed in min(least, repetitions) repetitions or more."""
    reps = assessments.groupBy(*clip).agg(F.count_distinct(rep).alias("_reps"))
    faults = assessments.filter(F.col("status") == "observed").groupBy(*clip, "error").agg(F.count_distinct(rep).alias("n"), F.max("exceedance").alias("exceedance"))
    return faults.join(reps, clip).filter(F.col("n") >= F.least(F.lit(least), F.col("_reps"))).drop("_reps")


def top_fixes(faults: DataFrame, clip: list[str], order: DataFrame | None = None, n: int = 3) -> DataFrame:
    """Up to n faults by coaching order, then prevalence, then exceedance, then name."""
    rows = faults if order is None else faults.join(small(order), "error", "left")
    place = F.lit(0) if order is None else F.coalesce("place", F.lit(1 << 20))
    w = Window.partitionBy(*clip).orderBy(place, F.desc("n"), F.desc("exceedance"), "error")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def blocked_observations(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """The first failing check of each row as `reason`; null where all hold."""
    reason = None
    for name, ok in checks:
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    return rows.withColumn("reason", reason)


def score_band(score: Column) -> Column:
    """Fixed value: bands from 73, 47 and 20; no score is unmeasured."""
    return F.when(score.isNull(), "unmeasured").when(score >= 73, "strong").when(score >= 47, "solid").when(score >= 20, "shaky").otherwise("broken down")
