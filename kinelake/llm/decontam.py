"""Benchmark decontamination by q-gram lemma filtering.

A document is contaminated if a stretch of it is within the edit budget of a
benchmark item, both in lower case and with white space read as spaces.  An
item of L bytes has the budget e = L // EDIT_PART edits (fewer if the lemma asks
for it).  A stretch with at most e edits shares at least L - Q + 1 - Q * e
q-grams with the item, all on diagonals (place in the text minus place in the
item) that differ by e at most.  So the shared q-grams are counted in
overlapping bands of 2 * (e + 1) diagonals, bands below the bound are dropped,
and the regions of the others are verified by banded alignment.

Items often begin alike.  A gram that more than COMMON items hold is left out of an
item's index while enough others remain: with k of its places indexed, a stretch
within the budget shares k - Q * e of them at least, so the bound falls by one for
each place left out and no stretch is missed.  An item whose grams are mostly common
keeps its Q * e + 1 rarest places.  Equal items are indexed once.  Hits are paired with
items EXPANDED pairs at a time.

The items are an index that is broadcast in blocks of at most INDEX_BYTES of
text; a larger benchmark takes more than one pass.

Defined results: null or empty text is not contaminated; null or empty items
match nothing, nor do items without an item_id; an item shorter than Q must occur
exactly; equal items are all reported; repeated rows are judged one by one; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE_BYTES, ascii_lower, mix64, rows_of, table, utf8

Q = 16
EDIT_PART = 25
INDEX_BYTES = 4 << 20
BLOCK = 2 << 20
#: Bytes of text whose shared q-grams are counted at once, and bands that are aligned at once.
WINDOW = 1 << 16
BANDS_AT_ONCE = 256
#: Items that may share a gram before other places of theirs are preferred; pairs of hits and items at once.
COMMON = 32
EXPANDED = 1 << 20
_FILTER_BITS = 22


def normalised(data: np.ndarray) -> np.ndarray:
    table_ = ascii_lower(np.arange(256, dtype=np.uint8))
    table_[list(SPACE_BYTES)] = 0x20
    return table_[data]


def gram_keys(data: np.ndarray) -> np.ndarray:
    """A 64-bit key of the Q bytes from each place on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return mix64(eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(eight[8 : n + 8] + np.uint64(0x632BE59BD9B4E019)))


def budget(length: int) -> int:
    """Edits allowed for an item; the lemma's bound stays at 1 or more."""
    return min(length // EDIT_PART, max(length - Q, 0) // Q)


def within(item: np.ndarray, texts: list[np.ndarray], lows: np.ndarray, most: int) -> np.ndarray:
    """Whether item is within `most` edits of a stretch of each text that starts on one
    of the diagonals low .. low + 2 * most + 1, by alignment in that band and `most` beyond."""
    width = 4 * most + 2
    step = np.arange(width)
    first = lows - most
    padded = np.full((len(texts), width + len(item)), 256, np.int32)
    for row, text, a in zip(padded, texts, first.tolist(), strict=True):
        part = text[max(a, 0) : max(a + width + len(item), 0)]
        row[max(-a, 0) : max(-a, 0) + len(part)] = part
    size = np.array([len(t) for t in texts])[:, None]
    # entry d of a row: edits of the item so far, ending at diagonal first + d
    start = first[:, None] + step
    row = np.where((start >= 0) & (start <= size), 0, most + 1)
    for i, c in enumerate(item):
        beside = np.c_[row[:, 1:], np.full(len(row), most + 1)] + 1
        here = np.minimum(row + (padded[:, i : i + width] != c), beside)
        row = np.minimum.accumulate(here - step, axis=1) + step
        if i % 64 == 0 and row.min() > most:
            break
    return row.min(1) <= most


class ItemIndex:
    """Q-grams of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str]):
        held: dict[bytes, list[int]] = {}
        for i, t in zip(ids, texts, strict=True):
            held.setdefault(normalised(np.frombuffer(t.encode(), np.uint8)).tobytes(), []).append(i)
        self.ids = list(held.values())
        self.items = [np.frombuffer(t, np.uint8) for t in held]
        self.budget = np.array([budget(len(t)) for t in self.items], np.int64)
        self.short = [i for i, t in enumerate(self.items) if 0 < len(t) < Q]
        keys = [gram_keys(t) for t in self.items]
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        kept = self._indexed(keys, item)
        keys, item, place = keys[kept], item[kept], place[kept]
        self.bound = np.bincount(item, minlength=len(self.items)) - Q * self.budget
        order = np.lexsort((place, item, keys))
        keys, item, self.place = keys[order], item[order], place[order]
        # a row for each gram and item: its places in the item are count from first on
        new = np.r_[True, (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])] if len(keys) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.r_[self.first, len(keys)])
        self.item = item[self.first]
        # and the rows of a gram
        self.keys, self.rows_first = np.unique(keys[self.first], return_index=True)
        self.rows_count = np.diff(np.r_[self.rows_first, len(self.first)])
        # rows by gram and item, to find a gram's rows of a range of items
        self.by_gram = np.repeat(np.arange(len(self.keys)), self.rows_count) * len(self.items) + self.item
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def _indexed(self, keys: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which places are indexed: those of uncommon grams, Q * e + 1 of the rarest at least."""
        if not len(keys):
            return np.zeros(0, bool)
        order = np.lexsort((item, keys))
        k, i = keys[order], item[order]
        gram = np.r_[True, k[1:] != k[:-1]]
        pair = gram | np.r_[True, i[1:] != i[:-1]]
        held = np.empty(len(keys), np.int64)
        held[order] = np.add.reduceat(pair.astype(np.int64), np.flatnonzero(gram))[np.cumsum(gram) - 1]
        # the rank of each place in its item, rarest first
        order = np.lexsort((held, item))
        start = np.r_[True, item[order][1:] != item[order][:-1]]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys)) - np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0))
        return (held <= COMMON) | (rank <= Q * self.budget[item])

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[set[int]]:
        """The ids of the items that each text holds."""
        found: list[set[int]] = [set() for _ in range(len(offsets) - 1)]
        data = normalised(data)
        for i in self.short:
            needle, raw = self.items[i].tobytes(), data.tobytes()
            at = raw.find(needle)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(needle) <= offsets[doc + 1]:
                    found[doc].update(self.ids[i])
                at = raw.find(needle, at + 1)
        if not len(self.keys):
            return found
        keys = gram_keys(data)
        hit = np.flatnonzero(self.filter[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
        true = self.keys[row] == keys[hit]
        hit, row = hit[true], row[true]
        doc = np.searchsorted(offsets, hit, side="right") - 1
        inside = hit + Q <= offsets[doc + 1]
        hit, row, doc = hit[inside], row[inside], doc[inside]
        for some in self._windows(hit - offsets[doc], doc):
            self._judge(data, offsets, hit[some] - offsets[doc[some]], doc[some], row[some], found)
        return found

    def _windows(self, place: np.ndarray, doc: np.ndarray) -> Iterator[slice]:
        """Runs of the hits, in order of text and place, such that any stretch lies in one of them."""
        longest = max((len(t) + int(e) for t, e in zip(self.items, self.budget, strict=True)), default=0)
        edge = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)] if len(doc) else np.zeros(1, np.int64)
        first = 0
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - first > WINDOW and a > first:
                yield slice(first, a)
                first = a
            if place[b - 1] - place[a] > WINDOW + longest:  # a long text: windows that overlap by the longest item
                if a > first:
                    yield slice(first, a)
                for left in range(int(place[a]), int(place[b - 1]) + 1, WINDOW):
                    x, y = a + np.searchsorted(place[a:b], [left, left + WINDOW + longest])
                    if y > x:
                        yield slice(int(x), int(y))
                first = b
        if first < len(doc):
            yield slice(first, len(doc))

    def _judge(self, data: np.ndarray, offsets: np.ndarray, place: np.ndarray, doc: np.ndarray, row: np.ndarray, found: list[set[int]]) -> None:
        """Hits (place and text of a shared gram), item range by item range."""
        parts = -(-int(self.rows_count[row].sum()) // EXPANDED)
        edges = np.linspace(0, len(self.items), parts + 1).astype(np.int64)
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            a, b = (np.searchsorted(self.by_gram, row * len(self.items) + i) for i in (low, high))
            some = np.flatnonzero(b > a)
            if len(some):
                self._count(data, offsets, place[some], doc[some], a[some], b[some] - a[some], found)

    def _count(self, data: np.ndarray, offsets: np.ndarray, place: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, found: list[set[int]]) -> None:
        # all (place in text, item) of the shared q-grams
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place, doc = np.repeat(place, n), np.repeat(doc, n)
        width = self.budget[self.item[at]] + 1
        # A gram's places within a cell of `width` bytes lie in the bands of the first
        # or of the last of them, whatever the place in the item: those two will do.
        cell = place // width
        order = np.lexsort((place, cell, doc, at))
        at, place, doc, cell = at[order], place[order], doc[order], cell[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])]
        keep = new | np.r_[new[1:], True]
        at, place, doc = at[keep], place[keep], doc[keep]
        # all (place in text, item, place in item)
        n = self.count[at]
        within_item = self.place[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        item, doc, place = np.repeat(self.item[at], n), np.repeat(doc, n), np.repeat(place, n)
        band = np.floor_divide(place - within_item, self.budget[item] + 1)
        # each diagonal lies in two overlapping bands; a place of the item counts once in a band
        rows = np.stack([np.r_[doc, doc], np.r_[item, item], np.r_[band, band - 1], np.r_[within_item, within_item]])
        rows = rows[:, np.lexsort(rows[::-1])]
        rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)]][:3]
        start = np.flatnonzero(np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)])
        shared, bands = np.diff(np.r_[start, rows.shape[1]]), rows[:, start]
        bands = bands[:, shared >= self.bound[bands[1]]]
        for i in np.unique(bands[1]).tolist():
            self._verify(data, offsets, i, bands[0, bands[1] == i], bands[2, bands[1] == i], found)

    def _verify(self, data: np.ndarray, offsets: np.ndarray, i: int, docs: np.ndarray, bands: np.ndarray, found: list[set[int]]) -> None:
        most, needle = int(self.budget[i]), self.items[i].tobytes()
        left = []
        for doc, band in zip(docs.tolist(), bands.tolist(), strict=True):
            text = data[offsets[doc] : offsets[doc + 1]]
            low = band * (most + 1)
            region = text[max(0, low - most) : max(0, low + 2 * most + 1) + len(needle) + 2 * most]
            if needle in region.tobytes():
                found[doc].update(self.ids[i])
            elif most:
                left.append((doc, text, low))
        for a in range(0, len(left), BANDS_AT_ONCE):
            part = [x for x in left[a : a + BANDS_AT_ONCE] if self.ids[i][0] not in found[x[0]]]
            if part:
                good = within(self.items[i], [t for _, t, _ in part], np.array([low for *_, low in part]), most)
                for (doc, *_), ok in zip(part, good.tolist(), strict=True):
                    if ok:
                        found[doc].update(self.ids[i])


def item_blocks(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """Indexes over at most INDEX_BYTES of items each, one item at least."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in benchmark.select("item_id", F.lower("text").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        if ids and size + len(r["text"]) > INDEX_BYTES:
            yield ItemIndex(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
    if ids:
        yield ItemIndex(ids, texts)


def matched(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns of other names, and these names; _items: the sorted ids of the items they hold.

    A block of items is a broadcast of at most INDEX_BYTES of text, or one item; a
    larger benchmark takes one pass in the same stage for each block.
    """
    spark = docs.sparkSession
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    rows = docs.toDF(*inner).withColumn("_text", F.lower(F.col(inner[names.index("text")]))).withColumn("_items", F.array().cast("array<bigint>"))

    def passed(rows: DataFrame, index: ItemIndex) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows_of(batches, BLOCK, "_text"):
                found = shared.value.matches(*utf8(batch.column("_text")))
                items = [sorted({*old, *new}) for old, new in zip(batch.column("_items").to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in inner], batch.column("_text"), pa.array(items, pa.list_(pa.int64()))], names=[*inner, "_text", "_items"])

        return rows.mapInArrow(work, rows.schema)

    for index in item_blocks(benchmark):
        rows = passed(rows, index)
    return rows.drop("_text"), inner


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids of every document."""
    found, (doc_id, _) = matched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col(doc_id).alias("doc_id"), (F.size("_items") > 0).alias("contaminated"), F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("item_ids"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    found, inner = matched(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("_items") == 0).select(*inner).toDF(*docs.columns)
