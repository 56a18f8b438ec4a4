"""Streaming twins of the job operators: windowed counts, latest state, timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; a zone-less ts becomes a timestamp,
    as watermarks ask for."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events per type and tumbling window; rows later than `late` are dropped by
    the watermark, which also bounds the state."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def job_states(events: DataFrame, live: list[str], minutes: float = 30.0, late: str = "2 hours") -> DataFrame:
    """user_id, status, at: every change of a job's status, and `failed` when a
    live job has no event for so long (in event time)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, at = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "status": ["failed"], "at": [pd.Timestamp(at, unit="ms")]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = rows.iloc[-1]
        at = int(last.ts.value // 1_000_000)
        if state.exists and state.get[1] > at:
            return
        state.update((last.event_type, at))
        if last.event_type in live:
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + int(minutes * 60_000))
        yield pd.DataFrame({"user_id": [key[0]], "status": [last.event_type], "at": [last.ts]})

    rows = events.withWatermark("ts", late).select("user_id", "event_id", "event_type", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, status string, at timestamp", "status string, at long", "append", GroupStateTimeout.EventTimeTimeout)
