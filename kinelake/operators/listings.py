"""Lookups, batch counters, payload projections, chunk plans and a linear load model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.num import finite
from kinelake.functions.text import words_in
from kinelake.operators.aggregates import running
from kinelake.sources.tables import BODY

#: Common Spanish words, and marks that only Spanish text has.
SPANISH_WORDS = "el la los las de del que en y se un una por con para es sin al lo su más muy ya".split()
SPANISH_MARKS = r"(?i)[áéíóúñ¿¡]"
#: Warm-up frames of a chunk and its least length; grid of the skill tree.
WARM_UP, LEAST_CHUNK = 45, 240
COLUMN_W, ROW_H, PAD_X, PAD_Y, BAND_GAP = 180.0, 46.0, 90.0, 60.0, 34.0


def content_fingerprint(rows: DataFrame, column: str) -> DataFrame:
    """One row: the sha256 of the sorted values of a column, whatever their order."""
    return rows.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.col(column).cast("string")))), 256).alias("fingerprint"))


def row_fingerprint(*columns: str) -> Column:
    """The sha256 of a row's columns as one JSON object."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def found(rows: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    """asked (ident) with the rows that have it in any of the columns; each row once.

    One join for each column, so that no pair is compared that shares no value.
    """
    parts = [asked.join(rows.withColumn("ident", F.col(c).cast("string")), "ident") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def batch_counters(results: DataFrame, checks: dict[str, Column], group: list[str] = ()) -> DataFrame:
    """Rows and how many of them meet each check; a null check is not met."""
    return results.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])


def audited(ledger: DataFrame, present: DataFrame, key: str, group: list[str], most: int = 50) -> DataFrame:
    """Per group: rows whose key is present or missing, and the first `most` missing keys (a report)."""
    rows = ledger.join(present.select(key).distinct().withColumn("_here", F.lit(True)), key, "left")
    here = F.coalesce("_here", F.lit(False))
    counts = rows.groupBy(*group).agg(F.count_if(here).alias("present"), F.count_if(~here).alias("missing"))
    # a group's first keys are taken in each partition before they are shuffled
    place = F.row_number().over(Window.partitionBy(*group).orderBy(key))
    first = rows.filter(~here & F.col(key).isNotNull()).select(*group, key).distinct().withColumn("_place", place).filter(F.col("_place") <= most)
    first = first.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.array_sort(F.collect_list(key)).alias("first_missing"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    out = counts.join(first, same, "left").drop(*[f"_{g}" for g in group])
    return out.withColumn("first_missing", F.coalesce("first_missing", F.array().cast(rows.select(F.array(key)).schema[0].dataType)))


def parity(lists: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Whether the lists of a row hold the same values, in any order; null is an empty list."""
    sets = [F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))) for c in columns]
    same = F.lit(True)
    for s in sets[1:]:
        same = same & (s == sets[0])
    return lists.select(*key, same.alias("agrees"))


def focus(totals: DataFrame, key: list[str], item: str, amount: str) -> DataFrame:
    """The item with the largest total of each key, the first by name of equals."""
    sums = totals.groupBy(*key, item).agg(F.sum(amount).alias("_n"))
    return sums.groupBy(*key).agg(F.min_by(item, F.struct(-F.col("_n"), F.col(item))).alias("focus"), F.max("_n").alias("total"))


def overall(bins: DataFrame, key: list[str], name: str) -> DataFrame:
    """Bins that pass (passed, reason), the first of them by name, and the reasons of the others."""
    ok = F.coalesce("passed", F.lit(False))
    why = F.array_join(F.array_sort(F.collect_set(F.when(~ok, F.col("reason")))), "; ")
    return bins.groupBy(*key).agg(F.count_if(ok).alias("passing"), F.min(F.when(ok, F.col(name))).alias("reported"), why.alias("reasons"))


def first_seen(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values numbered in the order in which they first occur."""
    firsts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("_at"))
    # one row per distinct value
    return firsts.select(value, F.row_number().over(Window.orderBy("_at", value)).alias("place"))


def bank_deviation(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Mean absolute difference over all pairs of two banks, without forming them.

    With both banks sorted together, a value x above n_b values of b that sum up to s_b
    adds x * n_b - s_b, and a value of b likewise.
    """
    both = a.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("s")).unionAll(b.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("s"))).filter("v IS NOT NULL")
    # equal values are one row with their counts; running sums over ranges of them
    per = both.groupBy(F.lit(0).alias("_all"), "v").agg(F.count_if(F.col("s") == 0).cast("double").alias("a"), F.count_if(F.col("s") == 1).cast("double").alias("b"))
    rows = running(per.withColumns({f"{k}v": F.col(k) * F.col("v") for k in "ab"}), ["_all"], "v", ["a", "b", "av", "bv"])
    below = lambda c: F.col(f"{c}_upto") - F.col(c)
    total = F.sum(F.col("a") * (F.col("v") * below("b") - below("bv")) + F.col("b") * (F.col("v") * below("a") - below("av")))
    return rows.agg((total / F.nullif(F.sum("a") * F.sum("b"), F.lit(0))).alias("deviation"))


def chunk_plan(clips: DataFrame, workers: int, overlap: int = WARM_UP, least: int = LEAST_CHUNK) -> DataFrame:
    """video, chunk, read_from, start and end: frame ranges to be posed in parallel.

    As many chunks as workers, of `least` frames at least; all but the first read
    `overlap` frames before their start.
    """
    n = F.greatest(F.lit(1), F.least(F.lit(workers), F.floor(F.col("n_frames") / F.lit(least)))).cast("int")
    rows = clips.select("video", "n_frames", n.alias("_n")).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk"))
    edge = lambda i: F.bround(i * F.col("n_frames") / F.col("_n"), 0).cast("long")
    rows = rows.withColumn("start", edge(F.col("chunk"))).withColumn("end", edge(F.col("chunk") + 1))
    return rows.select("video", "chunk", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0), F.col("start") - overlap)).alias("read_from"), "start", "end")


def stitched(plan: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of all chunks in one count, and the chunks that are wrong.

    parts: video, chunk, at (from 0) and columns.  All chunks but a video's last must
    have their planned length; the last must have a frame.
    """
    sizes = parts.groupBy("video", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    last = F.max("chunk").over(Window.partitionBy("video"))
    rows = plan.withColumn("_last", last == F.col("chunk")).join(sizes, ["video", "chunk"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    wrong = rows.filter(F.when(F.col("_last"), F.col("_n") == 0).otherwise(F.col("_n") != F.col("end") - F.col("start"))).select("video", "chunk", F.col("_n").alias("frames"))
    good = parts.join(plan.select("video", "chunk", "start"), ["video", "chunk"]).join(wrong.select("video").distinct(), "video", "left_anti")
    return good.withColumn("frame", F.col("start") + F.col("at")).drop("start", "at", "chunk"), wrong


def rest_level(frames: DataFrame, spans: DataFrame, value: str, fps: float = 30.0) -> DataFrame:
    """rep_id and the level of the better end: the median of the frames at each end, the one nearer to 0.

    frames: video, frame, valid and the value; spans: rep_id, video, a, b.
    """
    half = max(1, round(0.10 * max(fps, 1.0)))
    rows = spans.join(frames, "video").filter(F.col("frame").between(F.col("a"), F.col("b")) & F.col("valid"))
    end = lambda on: F.percentile(F.when(on, finite(value)), F.lit(0.5))
    out = rows.groupBy("rep_id").agg(end(F.col("frame") <= F.col("a") + half).alias("_a"), end(F.col("frame") >= F.col("b") - half).alias("_b"))
    return out.select("rep_id", F.when(F.col("_b").isNull() | (F.abs("_a") <= F.abs("_b")), F.col("_a")).otherwise(F.col("_b")).alias("rest"))


def pose_contract(frames: DataFrame, least: float = 0.10, visible: float = 0.5) -> DataFrame:
    """video and broken rules of pose frames (with fps): a plausible rate and enough joints tracked."""
    ok = sum((F.coalesce((F.col(f"{j}_c") > visible) & finite(f"{j}_x").isNotNull() & finite(f"{j}_y").isNotNull(), F.lit(False)).cast("int") for j in BODY), F.lit(0)) / len(BODY)
    rows = frames.groupBy("video").agg(F.first("fps").alias("fps"), F.avg(ok).alias("tracked"))
    broken = F.array(F.when(~F.coalesce(F.col("fps").between(1, 480), F.lit(False)), F.lit("fps_plausible")), F.when(F.col("tracked") < least, F.lit("tracked_enough")))
    return rows.select("video", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def looks_spanish(x: Column, english: list[str]) -> Column:
    """Spanish enough to stay: no listed English word, and short, or with a mark or common word of Spanish."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    common = F.size(F.array_intersect(words, F.array(*map(F.lit, SPANISH_WORDS)))) > 0
    return (F.size(words_in(x, english)) == 0) & ((F.size(words) < 4) | x.rlike(SPANISH_MARKS) | common)


def claimed(rows: DataFrame, owner: str, device: str) -> DataFrame:
    """Rows of a device that are done move to a new owner; the others stay."""
    return rows.withColumn("owner", F.when((F.col("owner") == device) & (F.col("status") == "done"), F.lit(owner)).otherwise(F.col("owner")))


def grouped_names(rows: DataFrame, group: str, name: str) -> DataFrame:
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(name)).alias("names"))


def tree_layout(tiered: DataFrame, family: str, order: DataFrame) -> DataFrame:
    """node, x and y: columns by tier, bands by family, nodes centred in their band by name.

    tiered: node, name, tier and the family; order: family and place, a row per family.
    """
    cell = Window.partitionBy(family, "tier")
    rows = tiered.withColumn("_i", F.row_number().over(cell.orderBy("name", "node")) - 1).withColumn("_k", F.count(F.lit(1)).over(cell))
    heights = order.join(rows.groupBy(family).agg(F.max("_k").alias("_rows")), family, "left").withColumn("_h", F.coalesce("_rows", F.lit(1)) * F.lit(ROW_H))
    above = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    bands = heights.select(family, "_h", (F.lit(PAD_Y) + F.coalesce(F.sum(F.col("_h") + BAND_GAP).over(above), F.lit(0.0))).alias("_top"))
    rows = rows.join(bands, family)
    y = F.col("_top") + (F.col("_h") - F.col("_k") * ROW_H) / 2 + F.col("_i") * ROW_H + ROW_H / 2
    return rows.select("node", (F.lit(PAD_X) + F.col("tier") * COLUMN_W).alias("x"), y.alias("y"))


def payload_digest(payload: DataFrame, key: str, faults: str, reps: str, notes: str) -> DataFrame:
    """The first 30 repetitions, 5 faults and 3 notes of each payload (a report)."""
    return payload.select(key, F.slice(reps, 1, 30).alias(reps), F.slice(faults, 1, 5).alias(faults), F.slice(notes, 1, 3).alias(notes))


def load_model(rows: DataFrame, features: list[str], target: str) -> tuple[list[float], float]:
    """Weights and bias of least squares; all zero where no target is other than 0.

    The products of the features are summed in Spark: a table of features squared.
    """
    import numpy as np

    names = [*features, "_one"]
    data = rows.filter(F.col(target).isNotNull()).withColumn("_one", F.lit(1.0))
    cells = [F.sum(finite(a) * finite(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums = data.agg(*cells, *[F.sum(finite(a) * F.col(target)).alias(f"y{i}") for i, a in enumerate(names)], F.max(F.abs(target)).alias("_most")).first()
    if not sums["_most"]:
        return [0.0] * len(features), 0.0
    gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], float)
    weights = np.linalg.lstsq(gram, np.array([sums[f"y{i}"] for i in range(len(names))], float), rcond=None)[0]
    return weights[:-1].tolist(), float(weights[-1])


def predicted_load(rows: DataFrame, features: list[str], model: tuple[list[float], float]) -> DataFrame:
    """rows with kg, in two decimals, and whether it is an estimate."""
    weights, bias = model
    kg = F.round(sum((F.col(f) * w for f, w in zip(features, weights, strict=True)), F.lit(bias)), 2)
    return rows.withColumn("kg", kg).withColumn("estimated", F.col("kg") > 1e-6)
