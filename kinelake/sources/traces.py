"""A store of trace records: appends with an expiry and dead letters, pruned reads.

The table is Parquet, dealt over folders by state (kept or dead) and by a bucket of
the trace's id, so that one append is one pass, a look-up of an id reads one bucket
and equality filters reach the scan.  Appends add files; nothing is rewritten, and of
records with one id the newest counts (`latest`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of a payload that are kept, days until a record expires.
MOST_CHARS = 350_000
TTL_DAYS = 90
#: Folders of a state. A part of the table's layout: one value for its whole life.
BUCKETS = 64
#: Rows of a listing and of a search.
LISTED, FOUND = 60, 50

SCHEMA = "trace_id string, job_id string, kind string, status string, created_at timestamp, expires_at timestamp, payload string, error string, state string, bucket int"


def bucket_of(trace_id: Column) -> Column:
    return (F.crc32(F.coalesce(trace_id, F.lit(""))) % BUCKETS).cast("int")


def put(rows: DataFrame, path: str, days: int = TTL_DAYS) -> None:
    """Append records with trace_id, job_id, kind, status, created_at and payload.

    A payload is cut to MOST_CHARS characters; a record without job_id takes its
    trace_id for it.  Records without an id, a time or a payload become dead letters
    with the reason in error, and keep what they have.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    error = F.nullif(F.concat_ws(", ", *[F.when(empty(c), f"no {c}") for c in ("trace_id", "created_at", "payload")]), F.lit(""))
    out = rows.select(
        "trace_id",
        F.when(empty("job_id"), F.col("trace_id")).otherwise(F.col("job_id")).alias("job_id"),
        "kind",
        "status",
        "created_at",
        (F.col("created_at") + F.make_dt_interval(F.lit(days))).alias("expires_at"),
        F.substring("payload", 1, MOST_CHARS).alias("payload"),
        error.alias("error"),
        F.when(error.isNull(), "kept").otherwise("dead").alias("state"),
        bucket_of(F.col("trace_id")).alias("bucket"),
    )
    # each task holds a few folders; one bucket's rows (dead letters have no id) go to eight
    salt = F.pmod(F.xxhash64("payload", "created_at", "job_id"), F.lit(8))
    out.repartition("state", "bucket", salt).write.mode("append").partitionBy("state", "bucket").parquet(path)


def put_failures(failures: DataFrame, path: str) -> None:
    """Append a record for each job that failed before it had a trace: job_id, stage, error, at."""
    payload = F.to_json(F.struct("job_id", "stage", "error", F.lit("worker-failure").alias("kind")))
    named = F.when(F.coalesce("job_id", F.lit("")) != "", F.concat(F.lit("failure:"), "job_id"))
    put(failures.select(named.alias("trace_id"), "job_id", F.lit("worker-failure").alias("kind"), F.lit("failed").alias("status"), F.col("at").alias("created_at"), payload.alias("payload")), path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def kept(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Records that have not expired at `now`."""
    return _stored(spark, path).filter((F.col("state") == "kept") & (F.col("expires_at") > now)).drop("error", "state")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).filter(F.col("state") == "dead").drop("state")


def latest(records: DataFrame) -> DataFrame:
    """The newest record of each id; of equally new ones that with the greatest payload."""
    w = Window.partitionBy("trace_id").orderBy(F.col("created_at").desc(), F.col("payload").desc())
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def by_id(spark: SparkSession, path: str, trace_id: str, now: Column) -> DataFrame:
    """The newest record of one id, from its bucket alone; no row if there is none."""
    one = kept(spark, path, now).filter((F.col("bucket") == bucket_of(F.lit(trace_id))) & (F.col("trace_id") == trace_id))
    return one.orderBy(F.col("created_at").desc(), F.col("payload").desc()).limit(1)


def found(records: DataFrame, limit: int = FOUND, **equal: str | None) -> DataFrame:
    """At most `limit` records with the given values, newest last; None asks for nothing."""
    for name, value in equal.items():
        if value:
            records = records.filter(F.col(name) == value)
    return records.orderBy(F.col("created_at").desc(), "trace_id").limit(limit).orderBy("created_at", F.col("trace_id").desc())


def listing(records: DataFrame, limit: int = LISTED) -> DataFrame:
    """The newest records without their payloads, newest first."""
    rows = latest(records).select("trace_id", "job_id", "kind", "status", "created_at", F.length("payload").alias("chars"))
    return rows.orderBy(F.col("created_at").desc(), "trace_id").limit(limit)
