"""Mixing sources to target weights, with DataFrame operations only.

Words are packed, source by source in hash order of the documents, into blocks
of BLOCK_WORDS.  The mix is a run of slots as long as the corpus, in output shards
of SHARD_SLOTS.  shard_counts draws how many slots each source has in each shard:
a multinomial draw by shard, conditioned on the totals of the sources, which are
fixed by their targets (so it is made by a pseudorandom permutation of all slots).
The slots of a source number on from shard to shard; its j-th slot takes block j mod
n of its n blocks, mapped through a pseudorandom permutation that differs by source
and round j div n, and sits at a pseudorandom place of its shard.  Blocks and slots
are joined by source and block index.  op8 adds up the words taken; the pipeline's
stage deals its rows to the shards and orders them by slot.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share the corpus's words; a target stops at 3 times its source's size and the
excess is shared anew by weight, in closed form as a water level.  A block is
taken at most 3 times, so no document exceeds 3 times its size.

Defined results: null or empty text has size 0 and takes 0; repeated rows are
separate rows (also with equal doc_id); an empty table gives no rows; a corpus
without words has target 0 throughout.  Only text, source and doc_id are read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD_PATTERN, shuffle_parts, table, written

#: Words of a block; the last block of a source may be shorter.
BLOCK_WORDS = 32
#: Slots of an output shard, and shards of a group in prefix sums.
SHARD_SLOTS = 1 << 14
SHARD_GROUP = 1 << 12
#: Fixed values of the contract: weights by rank, and the most that a source grows.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Documents of a prefix-sum bucket, about.
BUCKET_ROWS = 1024
SEED = "mix"
#: Rounds of the swap-or-not shuffle.
SHUFFLE_ROUNDS = 12


def permuted(index: Column, size: Column, key: Column) -> Column:
    """index's image under a pseudorandom permutation of 0 .. size - 1.

    The swap-or-not shuffle: round r pairs x with (k_r - x) mod size and swaps
    the two or not, by a bit of the hash of the larger one; any size will do.
    """

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), size) - x, size)
        swap = F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SHUFFLE_ROUNDS)), index.cast("long"), turn)


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight and target (double), one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(rank) % len(WEIGHTS)
    weight = F.when(turn == 1, WEIGHTS[0]).when(turn == 2, WEIGHTS[1]).otherwise(WEIGHTS[2]).cast("double")
    rows = by_source.withColumn("weight", weight).withColumn("most", (MOST_REPEATS * F.col("source_size")).cast("double"))
    # Sources reach their most in order of most / weight: with the first k of
    # them full the water level is (all - their most) / (weight of the rest).
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", level).withColumn("_full", F.col("most") <= F.col("weight") * F.col("_level"))
    water = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    target = F.when(F.col("_full") | water.isNull(), F.col("most")).otherwise(F.col("weight") * water)
    return rows.select("source", "source_size", "weight", target.alias("target"))


def packed(docs: DataFrame, rows: int) -> DataFrame:
    """docs with _from, the words of their source before them in hash order.

    Prefix sums in two levels: within hash buckets, and over bucket totals.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    keyed = docs.withColumn("_h", F.xxhash64(F.lit(SEED), "doc_id", "size")).withColumn("_bucket", F.floor((F.shiftrightunsigned("_h", 33) * F.lit(buckets)) / F.lit(1 << 31)).cast("int"))
    totals = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    # one row per source and bucket; a source's buckets number rows / BUCKET_ROWS
    start = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("_src"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(start), F.lit(0)).alias("_start"))
    within = Window.partitionBy("source", "_bucket").orderBy("_h", "_row").rowsBetween(Window.unboundedPreceding, -1)
    inner = keyed.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = inner.join(totals, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_from", F.col("_start") + F.col("_in")).drop("_src", "_b", "_start", "_in", "_h", "_bucket")


def before_in(partition: list[str], order: str, value: str) -> Column:
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def shard_counts(targets: DataFrame) -> DataFrame:
    """_s, _n, _shard and _count: the drawn number of slots of each source in each output shard."""
    all_ = Window.partitionBy(F.lit(1))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    # one row per source
    plan = targets.filter("source_size > 0").select(
        F.col("source").alias("_s"),
        F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long").alias("_n"),
        # a shorter last block: slots by the mean words of a source's blocks
        (F.col("target") / (F.col("source_size") / F.ceil(F.col("source_size") / BLOCK_WORDS))).alias("_want"),
        "source",
    )
    plan = plan.withColumn("_hi", F.round(F.sum("_want").over(turn.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    plan = plan.withColumn("_lo", F.coalesce(F.lag("_hi").over(turn), F.lit(0))).withColumn("_slots", F.max("_hi").over(all_)).filter("_hi > _lo").drop("source", "_want")
    # Slots lo .. hi - 1 of a permutation of all slots are the source's: their
    # images fall into the shards as draws without replacement.
    parts = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("_hi") - F.col("_lo") - 1) / SHARD_SLOTS).cast("long"))).alias("_part"))
    parts = parts.repartition(shuffle_parts(targets.sparkSession), F.xxhash64("_s", "_part"))
    first = F.col("_lo") + F.col("_part") * SHARD_SLOTS
    drawn = parts.select("_s", "_n", "_slots", F.explode(F.sequence(first, F.least(first + SHARD_SLOTS, F.col("_hi")) - 1)).alias("_t"))
    drawn = drawn.select("_s", "_n", shard_of(permuted(F.col("_t"), F.col("_slots"), F.xxhash64(F.lit(SEED), F.lit("slot")))).alias("_shard"))
    return drawn.groupBy("_s", "_n", "_shard").agg(F.count(F.lit(1)).alias("_count"))


def block_draws(targets: DataFrame) -> DataFrame:
    """_s, _block, _round and _slot: the block of each slot of the mix."""
    counts = written(shard_counts(targets).withColumn("_group", F.floor(F.col("_shard") / SHARD_GROUP)), "shards")
    # a source's slots before each shard, in two levels: groups of shards, then shards
    groups = counts.groupBy("_s", "_group").agg(F.sum("_count").alias("_sum"))
    groups = groups.select(F.col("_s").alias("_gs"), F.col("_group").alias("_gg"), before_in(["_s"], "_group", "_sum").alias("_start"))
    counts = counts.join(groups, F.col("_s").eqNullSafe(F.col("_gs")) & (F.col("_group") == F.col("_gg")))
    counts = counts.withColumn("_first", F.col("_start") + before_in(["_s", "_group"], "_shard", "_count"))
    shard = Window.partitionBy("_shard")
    # few rows that become many: a number of partitions that Spark doesn't lower
    counts = counts.repartition(shuffle_parts(targets.sparkSession), "_shard")
    counts = counts.withColumn("_offset", F.coalesce(F.sum("_count").over(shard.orderBy(F.col("_s").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_size", F.sum("_count").over(shard))
    slots = counts.select("_s", "_n", "_shard", "_first", "_offset", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)).alias("_i"))
    turn = F.col("_first") + F.col("_i")
    round_ = F.floor(turn / F.col("_n")).cast("long")
    place = permuted(F.col("_offset") + F.col("_i"), F.col("_size"), F.xxhash64(F.lit(SEED), F.lit("place"), "_shard"))
    return slots.filter(turn < MOST_REPEATS * F.col("_n")).select(
        "_s",
        permuted(turn % F.col("_n"), F.col("_n"), F.xxhash64(F.lit(SEED), "_s", round_)).alias("_block"),
        round_.cast("int").alias("_round"),
        (F.col("_shard").cast("long") * SHARD_SLOTS + place).alias("_slot"),
    )


def mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of docs: its rows with _row and size, the targets, and the sequence.

    The sequence has a row for each slot and document in it: _row, _round, _slot, and
    lo and n, the run of the document's words that is in the slot.
    """
    rows = docs if "_row" in docs.columns else docs.withColumn("_row", F.monotonically_increasing_id())
    light = written(sized(rows).select("doc_id", "source", "size", "_row"), "sized")
    targets = written(source_targets(light), "targets").coalesce(1)
    placed = packed(light, light.count())
    first, last = F.floor(F.col("_from") / BLOCK_WORDS), F.floor((F.col("_from") + F.col("size") - 1) / BLOCK_WORDS)
    pieces = placed.filter("size > 0").select("source", "_row", "_from", "size", F.explode(F.sequence(first, last)).alias("_b"))
    draws = block_draws(targets)
    # the optimiser takes the exploded plan of the draws for small: no broadcast
    pieces = pieces.join(draws.hint("merge"), pieces["source"].eqNullSafe(draws["_s"]) & (pieces["_b"] == draws["_block"]))
    lo = F.greatest(F.col("_b") * BLOCK_WORDS - F.col("_from"), F.lit(0))
    hi = F.least((F.col("_b") + 1) * BLOCK_WORDS - F.col("_from"), F.col("size"))
    return light, targets, pieces.select("_row", "_round", "_slot", lo.alias("lo"), (hi - lo).alias("n"))


def located(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns of docs and _row, which is the same however often and in whatever splits they are read.

    Of a scan of Parquet files it is the file and the place in it; other tables are
    written with numbers first.
    """
    try:
        return docs.select(*columns, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("_row"))
    except AnalysisException:
        return written(docs.select(*columns, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")).alias("_row")), "numbered")


def shard_of(slot: Column) -> Column:
    return F.floor(slot / SHARD_SLOTS).cast("int")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    light, targets, sequence = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = sequence.groupBy("_row").agg(F.sum("n").alias("taken"))
    targets = targets.select(F.col("source").alias("_s"), "source_size", "target")
    # one row per source: a table as large as the number of sources
    out = light.join(taken, "_row", "left").join(targets, F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the words that the mix takes, as documents.

    A document gives one row for each round that takes any of it, with the
    taken words in text order; taken whole, the text stays as it is.  A row is in
    the shard of the slot of its first word; a shard is in one partition, and its
    rows are in order of these slots.  docs is the table that the stage before wrote and
    is read twice: a row is known by its file and its place in it.
    """
    names = docs.columns
    # other columns travel in a struct, so their names can't clash
    others = [c for c in names if c not in ("doc_id", "text", "source")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    docs = located(docs, "doc_id", "text", "source", rest.alias("_rest"))
    _, _, sequence = mixed(docs)
    runs = sequence.groupBy("_row", "_round").agg(F.array_sort(F.collect_list(F.struct("lo", "n"))).alias("_runs"), F.min_by("_slot", "lo").alias("_slot"), F.sum("n").alias("_words"))
    # a document's rounds come together, so that its words are split once
    runs = runs.groupBy("_row").agg(F.collect_list(F.struct("_slot", "_words", "_runs")).alias("_rounds"))
    split = F.when(F.exists("_rounds", lambda r: r["_words"] < F.col("size")), F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})"), F.lit(1)))
    rows = sized(docs).join(runs, "_row").withColumn("_split", split)
    rows = rows.select("doc_id", "text", "source", "_rest", "size", "_split", F.explode("_rounds").alias("_r"))
    part = F.array_join(F.flatten(F.transform("_r._runs", lambda p: F.slice("_split", (p["lo"] + 1).cast("int"), p["n"].cast("int")))), " ")
    rows = rows.withColumn("text", F.when(F.col("_r._words") == F.col("size"), F.col("text")).otherwise(part))
    given = {"n_chars": F.length("text").cast("long")}
    dealt = rows.select("doc_id", "text", "source", "_rest", F.col("_r._slot").alias("_slot"), shard_of(F.col("_r._slot")).alias("_shard"))
    dealt = dealt.repartition(shuffle_parts(spark), "_shard").sortWithinPartitions("_shard", "_slot", "doc_id")
    return dealt.select(*[given.get(c, F.col(f"_rest.`{c}`") if c in others else F.col(c)).alias(c) for c in names])
