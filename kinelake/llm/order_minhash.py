"""Document fingerprints: order MinHash, with DataFrame functions only.

The elements of a text are its k-mers of K words, numbered by occurrence: the
o-th occurrence of a k-mer is an element of its own.  An element's hash sends
it to one of BINS bins, and each bin selects its minimal element.  Signature
entry t is the hash of the elements of bins t and t + 1 (cyclically), taken in
the order in which they stand in the text: two texts share an entry when they
share both elements in the same order, so the share of equal entries falls with
the edit distance and not only with the overlap.  An empty bin takes the
element of the next one that is not empty.

All of it happens inside a row: the hashes of a text are packed as (hash, place)
into longs and sorted; equal neighbours give the occurrence numbers and the
first hash of each bin the minimum, in time n log n without an explode.

Words are runs between spaces and the bytes 9 to 13; a text with fewer than K
words is one k-mer of them all.  Defined results: null counts as empty; a text
without words has the fixed fingerprint of no element; the likeness of two such
texts is 1, of one such text and another 0; equal texts have equal fingerprints
and likeness 1.  Repeated rows, also with equal doc_id, are kept; documents
with equal doc_id follow one another in order of text; a null doc_id is the
last of the descending order.  Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import table

#: Words of a k-mer.
K = 3
#: Bins, entries of a signature.
BINS = 64
#: Bits of the place in a packed long; k-mers from place 2 ** 24 - 1 on share that place.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
#: Documents of a neighbour range, about.
RANGE_ROWS = 500
#: Quantiles of doc_id; each is cut into equal ranges, as many as its rows ask for.
QUANTILES = 256
#: Ranges up to which their ends are broadcast: two numbers each.
BROADCAST_RANGES = 1 << 16
NO_ELEMENT = "-" * (4 * BINS)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE_BITS)


def _pack(hash64: Column, place: Column) -> Column:
    """A non-negative long of 39 hash bits and the place."""
    return F.shiftleft(F.shiftrightunsigned(hash64, 25), PLACE_BITS).bitwiseOR(F.least(place.cast("long"), F.lit(PLACE)))


def packed_kmers(words: Column) -> Column:
    """Sorted packed hashes of the k-mers of an array of words."""
    n = F.size(words)
    last = F.greatest(n - K, F.lit(0))
    whole = F.array(_pack(F.xxhash64(words), F.lit(0)))
    several = F.transform(F.sequence(F.lit(0), last), lambda i: _pack(F.xxhash64(*[F.get(words, i + j) for j in range(K)]), i))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < K, whole).otherwise(F.sort_array(several))


#: Bits below the bin in a packed long.
BIN_SHIFT = PLACE_BITS + 39 - BINS.bit_length() + 1


def _bin(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, BIN_SHIFT)


def selected(s: Column) -> Column:
    """The elements of a sorted k-mer array that can matter, in its order.

    These are the first of each bin and every repeat of a k-mer: a neighbour
    that differs in the place alone is a repeat, one that differs in the bin's
    bits is the first of its bin.
    """

    def matters(x: Column, j: Column) -> Column:
        return ~F.coalesce(x.bitwiseXOR(F.get(s, j - 1)), F.lit(0).cast("long")).between(F.lit(1 << PLACE_BITS), F.lit((1 << BIN_SHIFT) - 1))

    return F.filter(s, matters)


def numbered_repeats(d: Column) -> Column:
    """Repeats hashed anew with their occurrence number; d is sorted.

    Runs of equal hashes are found by comparing neighbours; the k-mer's first
    occurrence is not in d, so the i-th of a run is occurrence i + 2.
    """
    starts = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda j: (j == 0) | (_hash_of(F.get(d, j)) != _hash_of(F.get(d, F.greatest(j - 1, F.lit(0))))))

    def runs(b: Column) -> Column:
        spans = F.transform(b, lambda a, r: F.struct(a.alias("a"), F.coalesce(F.get(b, r + 1), F.size(d)).alias("z")))
        return F.flatten(F.transform(spans, lambda r: F.transform(F.sequence(r["a"], r["z"] - 1), lambda j: _pack(F.xxhash64(_hash_of(F.get(d, j)), j - r["a"]), F.get(d, j).bitwiseAND(F.lit(PLACE))))))

    return _let(starts, runs)


def bin_minima(kmers: Column) -> Column:
    """BINS packed longs: the minimal (k-mer, occurrence) of each bin.

    kmers is sorted and not empty; the bin is the top bits of the hash.
    """

    def first_of_bin(c: Column) -> Column:
        return F.filter(c, lambda x, j: (j == 0) | (_bin(x) != _bin(F.get(c, F.greatest(j - 1, F.lit(0))))))

    def with_repeats(c: Column) -> Column:
        repeats = F.filter(c, lambda x, j: (j > 0) & (_bin(x) == _bin(F.get(c, F.greatest(j - 1, F.lit(0))))))
        renewed = lambda d: F.when(F.size(d) == 0, c).otherwise(_let(F.sort_array(F.concat(first_of_bin(c), numbered_repeats(d))), first_of_bin))
        return _let(repeats, renewed)

    def dense(m: Column) -> Column:
        # an empty bin takes the next one's element, cyclically
        steps = F.transform(m, lambda x, i: F.array_repeat(x, (_bin(x) - F.coalesce(_bin(F.get(m, i - 1)), F.lit(-1).cast("long"))).cast("int")))
        return _let(F.flatten(steps), lambda head: F.concat(head, F.array_repeat(F.get(m, F.lit(0)), F.lit(BINS) - F.size(head))))

    return _let(_let(selected(kmers), with_repeats), lambda m: F.when(F.size(m) == BINS, m).otherwise(dense(m)))


def signature(text: Column) -> Column:
    """The fingerprint: BINS times four hexadecimal digits."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))

    def entries(m: Column) -> Column:
        def entry(t: Column) -> Column:
            a, b = F.get(m, t), F.get(m, (t + 1) % BINS)
            lo = F.when(a.bitwiseAND(F.lit(PLACE)) <= b.bitwiseAND(F.lit(PLACE)), a).otherwise(b)
            hi = F.when(a.bitwiseAND(F.lit(PLACE)) <= b.bitwiseAND(F.lit(PLACE)), b).otherwise(a)
            return F.lpad(F.hex(F.xxhash64(_hash_of(lo), _hash_of(hi)).bitwiseAND(F.lit(0xFFFF))), 4, "0")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), entry), "")

    of_kmers = lambda s: F.when(F.size(s) == 0, F.lit(NO_ELEMENT)).otherwise(_let(bin_minima(s), entries))
    return _let(_let(words, packed_kmers), of_kmers)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries of two fingerprints."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda n, t: n + (F.substring(a, t * 4 + 1, F.lit(4)) == F.substring(b, t * 4 + 1, F.lit(4))).cast("int"))
    return F.when(a == b, F.lit(1.0)).otherwise(same / F.lit(float(BINS)))


def ranged(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with _q and _r, ranges of doc_id in its order, and about the number of ranges.

    A range holds about RANGE_ROWS documents, however many there are; null doc_ids
    are a range below the others.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    quantiles = min(ranges, QUANTILES)
    cuts = rows.approxQuantile("doc_id", [i / quantiles for i in range(quantiles + 1)], 1.0 / (4 * quantiles))
    edges = sorted({int(c) for c in cuts})
    each = -(-ranges // quantiles)
    if len(edges) < 2:
        return rows.withColumn("_q", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(0)).withColumn("_r", F.lit(0).cast("long")), 1
    inner = F.array(*[F.lit(e).cast("long") for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<bigint>")
    below = F.aggregate(inner, F.lit(0), lambda n, c: n + (c <= F.col("doc_id")).cast("int"))
    rows = rows.withColumn("_q", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(below))
    low = F.get(F.array(*[F.lit(e).cast("double") for e in edges]), F.col("_q"))
    high = F.get(F.array(*[F.lit(e).cast("double") for e in edges]), F.col("_q") + 1)
    part = F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * each)
    return rows.withColumn("_r", F.when(F.col("_q") < 0, F.lit(0)).otherwise(F.least(F.greatest(part, F.lit(0)), F.lit(each - 1))).cast("long")), ranges


def next_heads(rows: DataFrame, ranges: int) -> DataFrame:
    """_q, _r and text: for each range the first text of the next one below, the highest's for the lowest."""
    tops = rows.groupBy("_q", "_r").agg(F.max("doc_id").alias("_top"))
    ends = F.broadcast(tops) if ranges <= BROADCAST_RANGES else tops
    heads = rows.join(ends, ["_q", "_r"]).filter(F.col("doc_id").eqNullSafe(F.col("_top"))).groupBy("_q", "_r").agg(F.min("text").alias("text"))
    # within a quantile the range below; its lowest has the next quantile's highest: a row per quantile
    quantiles = heads.groupBy("_q").agg(F.max("_r").alias("_high"))
    down = Window.orderBy(F.col("_q").desc())
    around = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.struct("_q", "_high")
    quantiles = quantiles.select("_q", F.coalesce(F.lead(after).over(down), F.first(after).over(around)).alias("_after"))
    inside = Window.partitionBy("_q").orderBy(F.col("_r").desc())
    below = heads.select("_q", "_r", F.lead("_r").over(inside).alias("_lower")).join(quantiles, "_q")
    own = F.col("_lower").isNotNull()
    below = below.select("_q", "_r", F.when(own, F.col("_q")).otherwise(F.col("_after._q")).alias("_nq"), F.when(own, F.col("_lower")).otherwise(F.col("_after._high")).alias("_nr"))
    return below.join(heads.select(F.col("_q").alias("_nq"), F.col("_r").alias("_nr"), "text"), ["_nq", "_nr"]).select("_q", "_r", "text")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, and text and fingerprint of the next document.

    The next one in descending order of doc_id; the first one after the last.
    Each range gets the first text of the range below as an extra last row, so
    one window over ranges sees every neighbour.
    """
    rows, ranges = ranged(docs)
    ends = next_heads(rows, ranges).select(F.lit(None).cast("long").alias("doc_id"), "text", "_q", "_r", F.lit(1).alias("_extra"))
    both = rows.withColumn("_extra", F.lit(0)).unionByName(ends).withColumn("fingerprint", signature(F.col("text")))
    order = Window.partitionBy("_q", "_r").orderBy("_extra", F.col("doc_id").desc_nulls_last(), "text")
    return both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).filter(F.col("_extra") == 0).drop("_q", "_r", "_extra")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The fingerprints of docs' texts and edited texts, with likenesses."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", signature(F.col("edited")).alias("edited_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
