"""Repeated substrings by the interval tree of an enhanced suffix array.

A corpus's suffix array is built in independent parts.  Every window of LENGTH
bytes has a minimiser, the K-byte gram with the least hash in it; windows with
equal bytes have equal minimisers, so the suffixes that can share LENGTH bytes
meet when windows are dealt by minimiser.  Consecutive windows with the same
minimiser travel together as one piece of text; pieces whose minimiser occurs
once in the corpus hold no repeat and never leave the first pass.

In a part, the suffixes that start at the pieces' windows are ordered by their
first LENGTH bytes and then by the rest; the common prefixes of neighbours make
the array an enhanced one.  Runs of suffixes that agree in LENGTH bytes are
tested for diversity of the byte to their left (a piece's border counts as
diverse): a run that is not diverse belongs to a repeat that starts further
left.  A scan with a stack over the common prefixes of the other runs yields the
nodes of the common-prefix interval tree, each a repeat that can be extended
neither to the left nor to the right, with all its occurrences.

A minimiser with more than HOT pieces (a frequent line or passage) is dealt anew
by the bytes that GRID consecutive windows share, so that only windows with
nearly all bytes equal meet; equal pieces of a batch travel as one row.

Defined results: null text is empty; texts shorter than LENGTH have no repeat;
repeated rows, also with equal doc_id, are separate documents and repeat each
other; an empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SpanHash, mix64, rows_of, shuffle_parts, table, utf8, written

LENGTH = 200
#: Bytes of a minimiser.
K = 40
HOT = 2000
GRID = 16
BLOCK = 4 << 20
#: Windows whose minimisers are found at once; their place has PLACE_BITS bits.
SEGMENT = (1 << 22) - LENGTH
PLACE_BITS = 22
#: Bytes of pieces that are ordered at once (a minimiser's pieces stay together).
PART_BYTES = 1 << 20


def minimised(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the minimiser of each window of data, and the hashes of all k-grams."""
    n = len(data) - k + 1
    at = np.arange(n)
    h = SpanHash(data).of(at, at + k)
    shift = np.uint64(PLACE_BITS)
    low = ((h >> shift) << shift) | at.astype(np.uint64)
    span, have = length - k + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    rest = span - have
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    return (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), h


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
    """(text, start, windows, place of the minimiser, its hash) arrays of all pieces."""
    out: list[tuple] = []
    for base in range(0, max(len(data) - length + 1, 0), SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        place, h = minimised(part, length, k)
        start = base + np.arange(len(place))
        text = np.searchsorted(offsets, start, side="right") - 1
        inside = start + length <= offsets[text + 1]
        new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]
        new[1:] |= inside[1:] != inside[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(place)])
        ok = inside[first]
        first, size = first[ok], size[ok]
        out.append((text[first], start[first] - offsets[text[first]], size, base + place[first] - offsets[text[first]], h[place[first]]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(5))


def interval_nodes(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of the interval tree's nodes, by a stack.

    lcp[i] is the common prefix of suffixes i - 1 and i of a sorted run, lcp[0]
    is not used; nodes with a shorter prefix than least are left out.
    """
    nodes = []
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        value = lcp[i] if i < len(lcp) else 0
        left = i - 1
        while stack[-1][0] > value:
            depth, left = stack.pop()
            if depth >= least:
                nodes.append((depth, left, i - 1))
        if stack[-1][0] < value:
            stack.append((value, left))
    return nodes


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def maximal_repeats(contents: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(piece, start), ...]) of the repeats of at least `length` bytes.

    contents: different byte strings, each at least `length` long.  A repeat is
    maximal within the pieces; at a piece's border it may go on beyond it.
    """
    data = np.frombuffer(b"".join(contents), np.uint8)
    size = np.array([len(c) for c in contents])
    base = np.cumsum(size) - size
    windows = size - length + 1
    piece = np.repeat(np.arange(len(contents)), windows)
    inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    start = base[piece] + inner
    h = SpanHash(data).of(start, start + length)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    count = np.diff(np.r_[first, len(h)])
    left = np.where(inner == 0, 256 + piece, data[start - 1])[order]
    diverse = (count > 1) & (np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first))
    for a, n in zip(first[diverse].tolist(), count[diverse].tolist(), strict=True):
        members = [(int(piece[m]), int(inner[m])) for m in order[a : a + n]]
        suffixes = sorted((contents[p][i:], p, i) for p, i in members)
        lcp = [0] + [common_prefix(x[0], y[0]) for x, y in zip(suffixes, suffixes[1:], strict=False)]
        for depth, lo, hi in interval_nodes(lcp, length):
            yield depth, [(p, i) for _, p, i in suffixes[lo : hi + 1]]


def covered(contents: list[bytes], times: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Merged (start, end) ranges of each piece that repeats cover.

    times: how often a piece occurs; one that occurs again is covered whole.
    """
    ranges: list[list[tuple[int, int]]] = [[(0, len(c))] if t > 1 else [] for c, t in zip(contents, times, strict=True)]
    for depth, places in maximal_repeats(contents, length):
        for p, i in places:
            if times[p] == 1:
                ranges[p].append((i, i + depth))
    return [merged(r) for r in ranges]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _find_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches, BLOCK, "text"):
        data, at = utf8(batch.column("text"))
        text, start, size, place, h = pieces(data, at)
        key = batch.column("key").to_numpy()[text]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key, pa.int64()), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array((place - start).astype(np.int32))], names=["h", "key", "start", "windows", "offset"])


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, content and the occurrences (keys, starts) of the pieces of texts."""
    for batch in rows_of(batches, BLOCK, "text"):
        data, at = utf8(batch.column("text"))
        raw = data.tobytes()
        lists = batch.column("found")
        rows = lists.flatten()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        field = {f: rows.field(f).to_numpy() for f in ("start", "windows", "offset", "h", "n")}
        keys = batch.column("key").to_numpy()
        got: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        hot = field["n"] > HOT
        start, size = field["start"].astype(np.int64), field["windows"].astype(np.int64)
        for i in np.flatnonzero(~hot).tolist():
            o = owner[i]
            a = at[o] + start[i]
            got.setdefault((int(field["h"][i]), raw[a : a + size[i] + LENGTH - 1]), []).append((keys[o], start[i]))
        if hot.any():
            hashes = SpanHash(data)
            for i in np.flatnonzero(hot).tolist():
                # windows by the minimiser's place in them, in fixed groups
                o, s, w, offset = owner[i], int(start[i]), int(size[i]), int(field["offset"][i])
                lowest = offset - w + 1
                for g in range(lowest // GRID, offset // GRID + 1):
                    lo, hi = max(lowest, g * GRID), min(offset, g * GRID + GRID - 1)
                    place = s + offset
                    core = at[o] + place - g * GRID
                    end = core + LENGTH - GRID + 1
                    part = int(mix64(hashes.of(np.array([core]), np.array([end])) + np.uint64(g + 1)).view(np.int64)[0])
                    a = place - hi
                    got.setdefault((part, raw[at[o] + a : at[o] + a + hi - lo + LENGTH]), []).append((keys[o], a))
        parts, contents, spots = [], [], []
        for (part, content), where in got.items():
            parts.append(part)
            contents.append(content)
            spots.append(np.array(where, np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(contents, pa.binary()), pa.array(spots, pa.binary())], names=["part", "content", "spots"])


def _order_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, start and length of covered ranges; rows come sorted by part."""

    def solve(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch | None:
        place: dict[bytes, int] = {}
        spots: list[list[bytes]] = []
        for _, content, where in rows:
            i = place.setdefault(content, len(spots))
            if i == len(spots):
                spots.append([])
            spots[i].append(where)
        where = [np.frombuffer(b"".join(s), np.int64).reshape(-1, 2) for s in spots]
        out = []
        for w, ranges in zip(where, covered(list(place), [len(w) for w in where]), strict=True):
            for a, b in ranges:
                out.append(np.c_[w[:, 0], w[:, 1] + a, np.full(len(w), b - a)])
        if not out:
            return None
        found = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(3)], names=["key", "start", "length"])

    held: list[tuple[int, bytes, bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(batch.column("part").to_pylist(), batch.column("content").to_pylist(), batch.column("spots").to_pylist(), strict=True):
            if size >= PART_BYTES and row[0] != held[-1][0]:
                if (found := solve(held)) is not None:
                    yield found
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held and (found := solve(held)) is not None:
        yield found


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """key, start and length of ranges that repeats cover; docs: key, doc_id, text."""
    spark = docs.sparkSession
    found = docs.select("key", "text").mapInArrow(_find_pieces, "h long, key long, start int, windows int, offset int")
    # counts are a written table, so that the join's sides are shuffles of their own and
    # Spark can split a frequent minimiser's rows over tasks
    counts = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "minimisers")
    counted = found.join(counts.hint("merge"), "h")
    # the pieces of one text, as many as its length allows
    lists = counted.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "offset", "h", "n")).alias("found"))
    # doc_id comes along so that the texts are dealt as for the result, once
    cut = docs.join(lists, "key").select("key", "doc_id", "text", "found").mapInArrow(_cut_pieces, "part long, content binary, spots binary")
    dealt = cut.repartition(shuffle_parts(spark), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_order_parts, "key long, start long, length long")


def without_repeats(docs: DataFrame, scanned: bool = False) -> DataFrame:
    """doc_id, kept bytes, spans and n_bytes of each row of docs (doc_id, text).

    spans: maximal removed ranges as (start, length) of the text's bytes.  docs are
    read three times and their rows must have the same numbers each time: scanned says
    that they are a plain scan of files, which is split alike each time; else the
    numbered rows are written first.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not scanned:
        rows = written(rows, "numbered")
    spans = repeated_ranges(rows).groupBy("key").agg(F.collect_list(F.struct("start", "length")).alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BLOCK, "text"):
            data, at = utf8(batch.column("text"))
            raw = data.tobytes()
            kept, out = [], []
            for i, spans_ in enumerate(batch.column("spans").to_pylist()):
                text = raw[at[i] : at[i + 1]]
                ranges = merged([(s["start"], s["start"] + s["length"]) for s in spans_ or ()])
                edges = [0, *[e for r in ranges for e in r], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                out.append([{"start": a, "length": b - a} for a, b in ranges])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(kept, pa.binary()), pa.array(out, kind)], names=["doc_id", "n_bytes", "kept", "spans"])

    joined = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(work, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,length:long>>")


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), scanned=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

