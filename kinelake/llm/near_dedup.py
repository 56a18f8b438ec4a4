"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct 5-word shingles.  Documents with equal sets
are one node from the start, so copies are never paired.  A link is a similarity
of percent in a hundred: PERCENT for op5, STAGE_PERCENT for the pipeline's stage.
Candidates are nodes that share a band of min-hashes, bands and rows by percent.  A candidate's signatures are
compared in batches of BATCH hashes; after n hashes with m matches, the
posterior of the similarity under a uniform prior is Beta(m + 1, n - m + 1) and
the pair is dropped when P(J >= percent / 100) is less than an equal share of MISS
for each look.  Survivors are confirmed
exactly on the full sets.

Pairs are not expanded within a band's bucket at first: round 1 pairs every
member with the bucket's medoid, confirms these links and merges components.
Round 2 compares only members of buckets that still hold several components, and
only across components; it is exact for the rest, as a link inside a component
changes nothing.  Its candidates are never rows: members that have one get their set,
a bucket's task confirms the pairs itself and returns a forest of the links, fewer
than the bucket's members.  Buckets of more than CHUNK members, or in round 2 of more
than SET_CHUNK shingles, are split into chunks (and pairs of chunks), so no task holds
an unbounded bucket.

Defined results: null text and text without words have an empty set, belong to
no group and have themselves as component; fewer than 5 words are one shingle;
rows with an equal doc_id are separate rows; an empty table gives no rows; ties
do not arise, as the smallest doc_id names a component.  Only doc_id and text
are read.  Shingles are told apart by 54 or more bits of a hash, nodes by 64.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, hot_join, mix64, rows_of, shuffle_parts, table, utf8, word_hashes, word_spans, written

SHINGLE_WORDS = 5
#: A link of op5: 100 * intersection >= PERCENT * union; of the pipeline's stage.
PERCENT = 85
STAGE_PERCENT = 80
HASHES = 256
#: Most pairs at the threshold that share no band.
BAND_MISS = 4e-5
BATCH = 32
#: Most pairs at the threshold that the sequential test loses, over all looks.
MISS = 2e-4
CHUNK = 1024
#: Shingles that a chunk of round 2 has at most, but for a single longer set.
SET_CHUNK = 1 << 21
#: A node with more pairs in a bucket than HUB_PAIRS has them dealt to HUB_PARTS.
HUB_PAIRS = 128
HUB_PARTS = 64
#: Bits of the bitmap of chosen documents, at least and at most.
SLOTS, MOST_SLOTS = 1 << 23, 1 << 27
BLOCK = 4 << 20

_A = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_B = mix64(np.arange(1001, HASHES + 1001, dtype=np.uint64)).astype(np.uint32)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands that HASHES leave room for."""
    t = percent / 100
    for rows in range(HASHES, 0, -1):
        bands = math.ceil(math.log(BAND_MISS) / math.log1p(-(t**rows)))
        if bands * rows <= HASHES:
            return bands, rows
    raise ValueError(f"no banding of {HASHES} hashes for {percent} %")


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and their n + 1 offsets."""
    data = ascii_lower(data)
    n_text = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    count = np.diff(first)
    owner = np.repeat(np.arange(n_text, dtype=np.int64), count)
    size = len(words)
    full = np.zeros(size, np.uint64)
    for j in range(SHINGLE_WORDS):
        full[: max(size - j, 0)] = full[: max(size - j, 0)] * _STEP + words[j:]
    ok = np.arange(size) + SHINGLE_WORDS <= first[owner + 1] if size else np.zeros(0, bool)
    hashes, of = [mix64(full[ok])], [owner[ok]]
    short = np.flatnonzero((count > 0) & (count < SHINGLE_WORDS))
    for i in short:
        value = np.uint64(count[i])
        for w in words[first[i] : first[i + 1]]:
            value = np.uint64((int(value) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        hashes.append(mix64(np.array([value], np.uint64)))
        of.append(np.array([i]))
    h, o = np.concatenate(hashes), np.concatenate(of).astype(np.uint64)
    # the text's number in the top bits: one sort gives sorted sets
    bits = np.uint64(max(1, int(n_text - 1).bit_length()))
    key = np.sort((o << (np.uint64(64) - bits)) | (h >> bits))
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    at = np.searchsorted(key >> (np.uint64(64) - bits), np.arange(n_text + 1, dtype=np.uint64)) if n_text > 1 else np.array([0, len(key)])[: n_text + 1]
    return key & ((np.uint64(1) << (np.uint64(64) - bits)) - np.uint64(1)), at


def uniform_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets with hashes cut to 54 bits whatever the number of texts (1024 at most)."""
    values, at = shingle_sets(data, offsets)
    bits = max(1, int(len(offsets) - 2).bit_length())
    cut = values >> np.uint64(10 - bits)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = np.ones(len(cut), bool)
    keep[1:] = (cut[1:] != cut[:-1]) | (owner[1:] != owner[:-1])
    return cut[keep], np.searchsorted(owner[keep], np.arange(len(at)))


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES 32-bit min-hashes of each set that is not empty."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.full((len(at) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    if len(full):
        x = (mix64(values) >> np.uint64(32)).astype(np.uint32)
        where = at[:-1][full]
        for i in range(HASHES):
            out[full, i] = np.minimum.reduceat(x * _A[i] + _B[i], where)
    return out


def signed(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, node, sig (HASHES uint16) and bands (int64 each) of each row."""
    bands, _ = banding(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BLOCK, "text"):
            values, at = uniform_sets(*utf8(batch.column("text")))
            full = signatures(values, at)
            sig = ((full * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
            band = mix64(band_keys(sig, percent) + np.arange(1, bands + 1, dtype=np.uint64))
            raw = values.tobytes()
            node = [int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(node, pa.int64()), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([r.tobytes() for r in band], pa.binary())], names=["doc_id", "n", "node", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n long, node long, sig binary, bands binary")


def band_rows(nodes: DataFrame, percent: int) -> DataFrame:
    """bucket, band and node, a row per band."""
    bands, _ = banding(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, _ = utf8(batch.column("bands"))
            band = np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.tobytes(), np.int64)), pa.array(band), pa.array(np.repeat(batch.column("node").to_numpy(), bands))], names=["bucket", "band", "node"])

    return nodes.select("node", "bands").mapInArrow(work, "bucket long, band int, node long")


@cache
def least_matches(percent: int = PERCENT) -> list[int]:
    """Matches that a pair needs after BATCH, 2 * BATCH, ... hashes.

    P(J >= t) under Beta(m + 1, n - m + 1) is P(Binomial(n + 1, t) <= m).
    """
    looks = range(BATCH, HASHES + 1, BATCH)
    t = percent / 100
    out = []
    for n in looks:
        total, m = 0.0, -1
        while total < MISS / len(looks):
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def band_keys(sig: np.ndarray, percent: int) -> np.ndarray:
    """The bands of each signature as 64-bit hashes, up to a number by band."""
    bands, rows = banding(percent)
    keys = np.zeros((len(sig), bands), np.uint64)
    # of the same 16 bits as the signature: a pair's first shared band is where its buckets are
    for r in range(rows):
        keys = mix64(keys * _STEP + sig[:, r : bands * rows : rows])
    return keys


def plausible(sig: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose similarity may reach the threshold, by sequential tests.

    With the rows' keys of the bands before the one they met in, a pair is kept
    in the first band that it shares alone.
    """
    fits = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
    a, b = a[fits], b[fits]
    matches = np.zeros(len(a), np.int64)
    for i, least in enumerate(least_matches(percent)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (sig[a, part] == sig[b, part]).sum(1)
        alive = matches >= least
        if i == 0 and before is not None:
            alive[alive] = ~(before[a[alive]] == before[b[alive]]).any(1)
        a, b, matches = a[alive], b[alive], matches[alive]
    return a, b


def medoid(sig: np.ndarray) -> int:
    """The member that agrees best with the most frequent hash of each column."""
    score = np.zeros(len(sig), np.int64)
    for column in sig.T[:64]:
        _, which, times = np.unique(column, return_inverse=True, return_counts=True)
        score += times[which] == times.max()
    return int(score.argmax())


def by_bucket(members: DataFrame) -> DataFrame:
    """The rows with each bucket's pair of chunks in one task, one after the other."""
    return members.repartition(shuffle_parts(members.sparkSession), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole buckets (pairs of chunks), and the edges between these."""

    def edges(held: pa.Table) -> np.ndarray:
        key = [held.column(c).to_numpy() for c in ("bucket", "lo", "hi")]
        return np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1

    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        edge = edges(held)
        if len(edge):
            # whole buckets only; the last one may go on
            yield held.slice(0, int(edge[-1])), np.r_[0, edge]
            held = held.slice(int(edge[-1]))
    if held is not None and held.num_rows:
        yield held, np.r_[0, edges(held), held.num_rows]


def signature_rows(rows: pa.Table) -> np.ndarray:
    raw, _ = utf8(rows.column("sig"))
    return np.frombuffer(raw.tobytes(), np.uint16).reshape(-1, HASHES)


def medoid_pairs(members: DataFrame, percent: int) -> DataFrame:
    """a, b and part: plausible pairs of each bucket's members with its medoid.

    members: bucket, lo, hi (chunks), node, n, sig.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edge in whole_buckets(batches):
            node, size = (rows.column(c).to_numpy() for c in ("node", "n"))
            sig = signature_rows(rows)
            width = np.diff(edge)
            two = edge[:-1][width == 2]
            got = [plausible(sig, size, two, two + 1, percent)]
            for s, e in zip(edge[:-1][width > 2], edge[1:][width > 2], strict=True):
                pivot = s + medoid(sig[s:e])
                b = np.delete(np.arange(s, e), pivot - s)
                got.append(plausible(sig, size, np.full(len(b), pivot), b, percent))
            a, b = (node[np.concatenate([g[i] for g in got])] for i in (0, 1))
            # pairs of a node that has many here are dealt by their other node too
            _, at, times = np.unique(a, return_inverse=True, return_counts=True)
            part = np.where(times[at] > HUB_PAIRS, 1 + (mix64(b.view(np.uint64)) % np.uint64(HUB_PARTS)).astype(np.int64), 0)
            pair = np.unique(np.stack([a, b, part]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pair], names=["a", "b", "part"])

    return by_bucket(members).select("bucket", "lo", "hi", "node", "n", "sig").mapInArrow(work, "a long, b long, part long").distinct()


MEMBER = ["bucket", "band", "lo", "hi", "chunk", "label", "node", "n", "sig"]


def across(i: int, root: np.ndarray, chunk: np.ndarray, one_chunk: bool) -> np.ndarray:
    """Later members of a bucket (pair of chunks) that i is compared with: those under another root."""
    apart = root[i + 1 :] != root[i]
    if not one_chunk:
        apart &= chunk[i + 1 :] != chunk[i]
    return np.flatnonzero(apart) + i + 1


def with_candidates(members: DataFrame, percent: int) -> DataFrame:
    """The members (MEMBER) that have a candidate with another label in their bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edge in whole_buckets(batches):
            label, chunk, lo, hi, size, band = (rows.column(c).to_numpy() for c in ("label", "chunk", "lo", "hi", "n", "band"))
            sig = signature_rows(rows)
            keep = np.zeros(len(label), bool)
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                before, kept = band_keys(sig[s:e], percent)[:, : band[s]], keep[s:e]
                for i in range(e - s):
                    other = across(i, label[s:e], chunk[s:e], lo[s] == hi[s])
                    if kept[i]:
                        other = other[~kept[other]]
                    if len(other):
                        a, b = plausible(sig[s:e], size[s:e], np.full(len(other), i), other, percent, before)
                        kept[a] = kept[b] = True
            yield from rows.filter(pa.array(keep)).to_batches()

    return by_bucket(members).select(*MEMBER).mapInArrow(work, members.select(*MEMBER).schema)


def common_shingles(code: np.ndarray, at: np.ndarray, i: int, others: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of set i with others; code, at: all sets; mark: all False."""
    mark[code[at[i] : at[i + 1]]] = True
    width = at[others + 1] - at[others]
    first = np.cumsum(width) - width
    where = np.repeat(at[others] - first, width) + np.arange(width.sum())
    out = np.add.reduceat(mark[code[where]], first, dtype=np.int64)
    mark[code[at[i] : at[i + 1]]] = False
    return out


def bucket_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a and b: a forest of the links between members (MEMBER) with different labels.

    Each candidate is confirmed on the full sets where it is found, unless links that
    were found before already join its members.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edge in whole_buckets(batches):
            node, label, chunk, lo, hi, size, band = (rows.column(c).to_numpy() for c in ("node", "label", "chunk", "lo", "hi", "n", "band"))
            sig = signature_rows(rows)
            found_a, found_b = [], []
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                raw, at = utf8(rows.column("shingles").slice(s, e - s))
                values, code = np.unique(np.frombuffer(raw.tobytes(), np.uint64), return_inverse=True)
                at, mark = at // 8, np.zeros(len(values), bool)
                root, before = np.unique(label[s:e], return_inverse=True)[1], band_keys(sig[s:e], percent)[:, : band[s]]
                for i in range(e - s):
                    b = across(i, root, chunk[s:e], lo[s] == hi[s])
                    if len(b):
                        _, b = plausible(sig[s:e], size[s:e], np.full(len(b), i), b, percent, before)
                    if len(b):
                        both = common_shingles(code, at, i, b, mark)
                        b = b[100 * both >= percent * (at[i + 1] - at[i] + at[b + 1] - at[b] - both)]
                        b = b[np.unique(root[b], return_index=True)[1]]
                        found_a.append(np.full(len(b), node[s + i]))
                        found_b.append(node[s + b])
                        root[np.isin(root, root[b])] = root[i]
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x]), pa.int64()) for x in (found_a, found_b)], names=["a", "b"])

    # a member's rows in many buckets compress well and so look small: no broadcast
    full = with_candidates(members, percent).join(sets.hint("merge"), "node")
    return by_bucket(full).select(*MEMBER, "shingles").mapInArrow(work, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union; sets: node, shingles.

    A node's set goes once to each part of its pairs, and not to every pair.
    """
    pairs = written(pairs, "pairs")
    left = pairs.select("a", "part").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    first = pairs.join(left.hint("merge"), ["a", "part"])
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both_ = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both_ >= percent * (len(x) + len(y) - both_))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of all linked nodes.

    Labels fall to the smallest of the neighbours' labels and then jump to their
    label's label, until nothing changes; every step is a written table.
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        # a hub's edges and a large component's nodes are dealt over tasks
        near = hot_join(edges, labels.select(F.col("node").alias("v"), "label"), "v", "u").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = written(lower, "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("far"))
        fresh = hot_join(lower, jump, "label", "node", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        fresh = written(fresh, "labels")
        if fresh.filter("old <> label").isEmpty():
            return fresh.select("node", "label")
        labels = fresh.select("node", "label")


def chunked(members: DataFrame, every: bool) -> DataFrame:
    """Rows of members (bucket, size, node, ...) dealt to chunks of a bucket.

    With every, a row goes to each pair of chunks that its own is part of, and a
    bucket's shingles (all of its members') count too.
    """
    chunks = F.ceil(F.col("size") / CHUNK)
    if every:
        chunks = F.least(F.greatest(chunks, F.ceil(F.col("shingles") / SET_CHUNK)), "size")
    chunks = chunks.cast("int")
    rows = members.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    if not every:
        return rows.withColumn("lo", F.col("chunk")).withColumn("hi", F.col("chunk"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return rows.withColumn("lo", F.least("chunk", "_other")).withColumn("hi", F.greatest("chunk", "_other")).drop("_other")


def near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    rows = written(signed(docs, percent), "signed")
    nodes = written(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    bands = band_rows(nodes, percent)
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(bands.join(shared, "bucket"), "members")
    wanted = members.select("node").distinct()
    light = written(nodes.join(wanted, "node", "left_semi").select("node", "low", "n", "sig"), "light")
    sets = written(node_sets(docs, light.select("low"), light.count()), "sets")
    light = light.select("node", "n", "sig")

    first = chunked(members.withColumn("label", F.col("node")), False).join(light, "node")
    links = written(confirmed(medoid_pairs(first, percent), sets, percent), "links1")
    labels = components(links)
    marked = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = written(marked, "marked")
    # round 1 has compared the one pair of a bucket of two
    rest = marked.filter("size > 2").join(light.select("node", "n"), "node")
    mixed = rest.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.sum("n").alias("shingles")).filter("_lo <> _hi").select("bucket", "shingles")
    second = chunked(marked.join(mixed, "bucket"), True).join(light, "node")
    more = written(bucket_links(second, sets, percent), "links2")
    labels = components(links.union(more))

    low = nodes.select("node", "low").join(labels, "node")
    least = low.groupBy("label").agg(F.min("low").alias("component_id"))
    of_node = nodes.select("node", "low").join(hot_join(labels, least, "label", "node").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    # equal texts are one node: any share of the rows
    out = hot_join(rows.select("doc_id", "n", "node"), of_node, "node", "doc_id", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def slot_bitmap(chosen: DataFrame, slots: int) -> np.ndarray:
    """The bits of the slots (column slot) as packed bytes, put together from pieces of 8 KB."""
    bits = 1 << 16

    def work(piece: tuple, part: pa.Table) -> pa.Table:
        hit = np.zeros(bits, bool)
        hit[part.column("slot").to_numpy() & (bits - 1)] = True
        return pa.table({"piece": pa.array([piece[0].as_py()], pa.int64()), "hit": pa.array([np.packbits(hit).tobytes()], pa.binary())})

    out = np.zeros(max(slots, bits) // 8, np.uint8)
    pieces = chosen.select("slot", F.shiftright("slot", 16).alias("piece")).distinct().groupBy("piece").applyInArrow(work, "piece long, hit binary")
    for r in pieces.toLocalIterator():
        out[r["piece"] * (bits // 8) : (r["piece"] + 1) * (bits // 8)] = np.frombuffer(r["hit"], np.uint8)
    return out


def node_sets(docs: DataFrame, chosen: DataFrame, count: int) -> DataFrame:
    """node and shingles (sorted 64-bit hashes) of documents, the chosen among them, once each.

    chosen: doc_ids, count of them.  They set a bitmap, of SLOTS bits or, for many,
    sixteen a document up to MOST_SLOTS; the texts whose doc_id hits it are made into
    sets anew, so no text is moved.  Others that hit it by chance come along and do no
    harm.  A set that several texts have leaves a task once, and then each partition.
    """
    slots = min(max(SLOTS, 1 << (16 * count - 1).bit_length()), MOST_SLOTS) if count else SLOTS
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    shared = docs.sparkSession.sparkContext.broadcast(slot_bitmap(chosen.select(slot("low").alias("slot")), slots))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("text", slot("doc_id").alias("slot"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            at = batch.column("slot").to_numpy()
            hit = batch.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7))) & 1 == 1))
            for part in rows_of([hit], BLOCK, "text"):
                values, at = uniform_sets(*utf8(part.column("text")))
                raw = values.tobytes()
                node, sets = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    shingles = raw[8 * a : 8 * b]
                    name = int.from_bytes(hashlib.blake2b(shingles, digest_size=8).digest(), "little", signed=True)
                    if name not in sent:
                        sent.add(name)
                        node.append(name)
                        sets.append(shingles)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows.mapInArrow(work, "node long, shingles binary").dropDuplicates(["node"])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), PERCENT)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays.

    Rows with an equal doc_id are one document and stay or go together.
    """
    kept = near_duplicates(docs, STAGE_PERCENT).filter("kept").select("doc_id").distinct()
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    return docs.toDF(*inner).join(kept, F.col(inner[names.index("doc_id")]).eqNullSafe(kept["doc_id"]), "left_semi").toDF(*names)
