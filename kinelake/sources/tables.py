"""Typed table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOINTS = ["nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle"]
#: The twelve joints of analysis: all below the head.
BODY = JOINTS[5:]

REPS = "rep_id string, video string, session_id string, exercise string, set_index int, view string, declared_bin string, rep_index int, start_frame int, turn_frame int, end_frame int, fps double"
LEDGER = "video_sha string, video string, session_id string, exercise string, n_reps int, fps double, mean_confidence double, no_rep_reasons string, mean_rep_quality double, arm_reach double, bin string, side string, azimuth_deg double, pose_backend string, first_seen string, last_seen string, note string"
POSE = "video string, frame int, joint string, x double, y double, c double"


class MissingArtefact(FileNotFoundError):
    """An input that an earlier stage should have written is not there."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def required(spark: SparkSession, path: str, produced_by: str) -> str:
    """path if it exists, in any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise MissingArtefact(f"{path} is missing; run {produced_by} first")
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema: dates in text columns stay text."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, below a folder; broken files are skipped."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinite numbers become null."""
    cleaned = {f.name: F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    df.withColumns(cleaned).write.mode("overwrite").json(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write the partitions that df holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def files(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """path, length, modificationTime and a 16-digit content key of a folder's files."""
    pattern = "*.{" + ",".join(suffixes) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", "length", "modificationTime", F.left(F.sha2("content", 256), F.lit(16)).alias("content_key"))


def indexed(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Listing against catalogue by path: added, known (same size and time), changed, gone."""
    a = listing.select("path", F.col("length").alias("_l"), F.col("modificationTime").alias("_m"))
    b = catalogue.select("path", F.col("length").alias("_cl"), F.col("modificationTime").alias("_cm"))
    state = F.when(F.col("_cl").isNull(), "added").when(F.col("_l").isNull(), "gone").when((F.col("_l") == F.col("_cl")) & (F.col("_m") == F.col("_cm")), "known").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def canonical_paths(copies: DataFrame) -> DataFrame:
    """One path per content key: lowest directory rank, then path."""
    return copies.groupBy("content_key").agg(F.min_by("path", F.struct("rank", "path")).alias("path"), F.count(F.lit(1)).alias("copies"))


def wide(pose: DataFrame) -> DataFrame:
    """Long pose rows as one row per frame: <joint>_x, _y and _c."""
    return pose.groupBy("video", "frame").pivot("joint", JOINTS).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("c").alias("c"))


def long(frames: DataFrame) -> DataFrame:
    """The inverse of `wide`; joints that were not seen are left out."""
    cells = [F.struct(F.lit(j).alias("joint"), *[F.col(f"{j}_{k}").alias(k) for k in "xyc"]) for j in JOINTS]
    return frames.select("video", "frame", F.inline(F.array(*cells))).filter("c is not null")


def remapped(pose: DataFrame, mapping: DataFrame) -> DataFrame:
    """Landmarks of another topology (mapping: source, joint); unseen joints have c = 0."""
    # one row per landmark of the other topology: a few dozen
    pairs = F.array(*[F.struct(F.lit(r["source"]).alias("source"), F.lit(r["joint"]).alias("joint")) for r in mapping.select("source", "joint").collect()])
    grid = pose.select("video", "frame").distinct().select("video", "frame", F.inline(pairs))
    rows = grid.join(pose.withColumnRenamed("joint", "source"), ["video", "frame", "source"], "left")
    return rows.select("video", "frame", "joint", "x", "y", F.coalesce("c", F.lit(0.0)).alias("c"))


def catalogue_entries(spark: SparkSession, text: DataFrame) -> DataFrame:
    """Exercises and weighted variants of a catalogue document (column value), one row each."""
    item = "struct<id:string,nameEs:string,nameEn:string,family:string,measurable:boolean,errors:array<struct<name:string,ruleId:string,why:string,fix:string>>>"
    doc = F.from_json("value", f"struct<exercises:array<{item}>,weightedCalisthenics:array<{item}>>")
    parts = text.select(doc.alias("d")).select(F.explode(F.concat(F.coalesce("d.exercises", F.array()), F.coalesce("d.weightedCalisthenics", F.array()))).alias("e"))
    return parts.select("e.*")
