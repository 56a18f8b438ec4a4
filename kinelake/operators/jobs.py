"""Job logs: latest state, stage durations, stale jobs, claims and credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(events: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last value of columns per key."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_l")).select(*key, *[F.col(f"_l.{c}").alias(c) for c in columns])


def first_times(events: DataFrame, key: list[str], event: str, at: str, names: list[str]) -> DataFrame:
    return events.groupBy(*key).agg(*[F.min(F.when(F.col(event) == n, F.col(at))).alias(n) for n in names])


def durations(events: DataFrame, key: list[str], event: str, at: str, stages: list[tuple[str, str, str]]) -> DataFrame:
    """Long rows (key, stage, seconds): last less first event; missing stages are left out."""
    names = list(dict.fromkeys(n for _, a, b in stages for n in (a, b)))
    times = first_times(events, key, event, at, names)
    seconds = [F.struct(F.lit(s).alias("stage"), ((F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / F.lit(1e6)).alias("seconds")) for s, a, b in stages]
    return times.select(*key, F.inline(F.array(*seconds))).filter("seconds is not null")


def stale(jobs: DataFrame, status: str, at: str, now: Column, minutes: float, live: list[str]) -> DataFrame:
    """Jobs in a live status without an update for so long, as failed."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(60e6)
    return jobs.filter(F.col(status).isin(*live) & (age > minutes)).withColumn("failed", F.lit(True)).withColumn("age_minutes", age)


def first_claims(claims: DataFrame, referee: str, order: list[str]) -> DataFrame:
    """A referee's first redemption counts."""
    w = Window.partitionBy(referee).orderBy(*order)
    return claims.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def accepted_charges(ledger: DataFrame, owner: str, order: list[str], delta: str) -> DataFrame:
    """Running balance per owner, and whether it stays at 0 or more."""
    w = Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("balance", F.sum(delta).over(w)).withColumn("accepted", F.col("balance") >= 0)


def counters(deltas: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Counters as sums of appended deltas."""
    return deltas.groupBy(*key).agg(*[F.sum(c).alias(c) for c in columns])


def waterfall(entries: DataFrame, key: list[str], stage: str, at: str) -> DataFrame:
    """First time per stage and its running maximum."""
    first = entries.groupBy(*key, stage).agg(F.min(at).alias("at"))
    w = Window.partitionBy(*key).orderBy("at", stage).rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("reached", F.max("at").over(w))


#: Transitions of a job: (event, from, to).  An event that doesn't fit the status is refused.
TRANSITIONS = (
    ("created", "none", "created"),
    ("uploaded", "created", "queued"),
    ("started", "queued", "processing"),
    ("stage", "processing", "processing"),
    ("finished", "processing", "done"),
    ("refined", "done", "done"),
    *[("error", s, "failed") for s in ("created", "queued", "processing")],
    ("timeout", "created", "aborted"),
    *[("timeout", s, "failed") for s in ("queued", "processing")],
)


def job_runs(events: DataFrame, key: list[str], order: list[str], event: str, at: str, minutes: float, upload_minutes: float, now: Column, transitions: tuple[tuple[str, str, str], ...] = TRANSITIONS) -> DataFrame:
    """key, status, since, applied and refused: each job's events run through the transitions.

    Events count once per order key and in its order, however they arrive.  A job that
    hears nothing for so long (upload_minutes after `created`) times out before the
    next event, or before now; the limit is that of the last event, and `timeout` is a
    transition like others, so a job that has ended is not failed again.  An update is
    conditional on the status it finds: what doesn't fit changes nothing and is counted.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    rows = events.dropDuplicates([*key, *order]).select(*key, *order, F.col(event).alias("_e"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    limit = F.when(F.col("_e") == "created", F.lit(int(upload_minutes * 60_000_000))).otherwise(F.lit(int(minutes * 60_000_000)))
    until = F.coalesce(F.lead("_t").over(w), F.unix_micros(now))
    rows = rows.withColumns({"_place": F.row_number().over(w), "_limit": limit, "_late": until - F.col("_t") > limit})
    steps = F.array(F.struct(F.col("_place"), F.lit(0).alias("_k"), F.col("_e"), F.col("_t")), F.when(F.col("_late"), F.struct(F.col("_place"), F.lit(1).alias("_k"), F.lit("timeout").alias("_e"), (F.col("_t") + F.col("_limit")).alias("_t"))))
    # a job's own events, in order
    log = rows.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list(F.array_compact(steps)))).alias("_log"))
    to = F.create_map(*[F.lit(x) for e, a, b in transitions for x in (f"{a}|{e}", b)])
    start = F.struct(F.lit("none").alias("status"), F.lit(None).cast("long").alias("since"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("refused"))

    def step(s: Column, x: Column) -> Column:
        new = F.element_at(to, F.concat(s["status"], F.lit("|"), x["_e"]))
        # a timeout of a job that has ended is nobody's event
        refused = (new.isNull() & (x["_k"] == 0)).cast("long")
        return F.struct(F.coalesce(new, s["status"]).alias("status"), F.when(new.isNotNull(), x["_t"]).otherwise(s["since"]).alias("since"), (s["applied"] + new.isNotNull().cast("long")).alias("applied"), (s["refused"] + refused).alias("refused"))

    out = log.withColumn("_s", F.aggregate("_log", start, step))
    return out.select(*key, F.col("_s.status").alias("status"), F.timestamp_micros("_s.since").alias("since"), F.col("_s.applied").alias("applied"), F.col("_s.refused").alias("refused"))
