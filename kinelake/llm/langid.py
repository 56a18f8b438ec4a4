"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts (orders 0 to ORDER)
with escape method C: in a context seen n times with d distinct followers a
follower seen c times costs -log2(c / (n + d)) bits, and the escape to the
next shorter context costs -log2(d / (n + d)).  A context that was never seen
is left without cost.  Below order 0 a byte costs 8 bits.  The statistics are
frozen after training, so the code length of a byte depends on the ORDER
bytes before it alone; the exact lengths of all grams seen in training are
tabulated per language and a text's length is a sum of table rows.

Defined results: null text, text without a letter and an empty model give
`und` and score 0; ties go to the language that sorts first; repeated rows
are scored one by one; other columns of the input do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import rows_of, sample_fraction, table, utf8

ORDER = 4
#: Bytes scored at once in a worker.
BLOCK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


class GramIndex:
    """Open-addressing index from 64-bit keys to their rows, probed with numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(math.ceil(math.log2(max(len(keys), 1) * 4))))
        size = 1 << self.bits
        self.slots = np.full(size, -1, np.int32)
        self.keys = np.zeros(size, np.uint64)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            # of several keys that want a slot, the last writer wins
            self.slots[at[free]] = left[free]
            won = self.slots[at] == left
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._home(keys)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[wrong]
        mask = len(self.slots) - 1
        while len(wrong):
            at = (at + 1) & mask
            got = self.slots[at]
            out[wrong] = got
            again = (got >= 0) & (self.keys[at] != keys[wrong])
            wrong, at = wrong[again], at[again]
        return out


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """The width-byte gram that ends at each byte from index width - 1 on."""
    n = len(data) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(width):
        out = (out << np.uint64(8)) | data[i : i + n].astype(np.uint64)
    return out


class PpmModel:
    """Frozen code lengths of several languages; plain arrays, cheap to send."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.langs = sorted(samples)
        self.order = order
        n_lang = len(self.langs)
        texts = {x: np.frombuffer("".join("\n" * order + t.lower() for t in samples[x]).encode(), np.uint8) for x in self.langs}
        self._index: list | None = None
        self.cost: list[tuple[np.ndarray, np.ndarray]] = []
        self.escape: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(order + 1):
            counted = [np.unique(grams(texts[x], k + 1), return_counts=True) for x in self.langs]
            keys = np.unique(np.concatenate([c[0] for c in counted])) if n_lang else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            escape = np.zeros((len(contexts), n_lang), np.float32)
            total = np.zeros((len(contexts), n_lang))
            for i, (g, c) in enumerate(counted):
                at = np.searchsorted(contexts, g >> np.uint64(8))
                n = np.bincount(at, c, len(contexts))
                d = np.bincount(at, minlength=len(contexts))
                seen = n > 0
                total[:, i] = n + d
                escape[seen, i] = -np.log2(d[seen] / (n + d)[seen])
            below = self._lengths(keys & np.uint64((1 << (8 * k)) - 1), k - 1)
            cost = below + escape[np.searchsorted(contexts, keys >> np.uint64(8))]
            for i, (g, c) in enumerate(counted):
                cost[np.searchsorted(keys, g), i] = -np.log2(c / total[np.searchsorted(contexts, g >> np.uint64(8)), i])
            self.escape.append((contexts, escape))
            self.cost.append((keys, cost.astype(np.float32)))
        self._index = None

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    def _tables(self):
        if self._index is None or len(self._index) < len(self.cost):
            self._index = [(GramIndex(k[0]), GramIndex(e[0])) for k, e in zip(self.cost, self.escape, strict=True)]
        return self._index

    def _lengths(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each (k + 1)-byte gram, per language."""
        if k < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        by_gram, by_context = self._tables()[k]
        row = by_gram.rows(keys)
        out = self.cost[k][1][row] if len(self.cost[k][1]) else np.zeros((len(keys), len(self.langs)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            part = keys[miss]
            bits = self._lengths(part & np.uint64((1 << (8 * k)) - 1), k - 1)
            context = by_context.rows(part >> np.uint64(8))
            known = context >= 0
            bits[known] += self.escape[k][1][context[known]]
            out[miss] = bits
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text (rows) under every language (columns)."""
        n_text, k = len(offsets) - 1, self.order
        out = np.zeros((n_text, len(self.langs)))
        if n_text == 0 or not self.langs:
            return out
        for a in range(0, len(data), BLOCK):
            b = min(a + BLOCK, len(data))
            owner = np.searchsorted(offsets, np.arange(a, b), side="right") - 1
            # each text is preceded by `order` line feeds, as in training
            place = np.arange(b - a) + (owner - owner[0] + 1) * k
            padded = np.full(int(place[-1]) + 1, 10, np.uint8)
            padded[place] = data[a:b]
            before = min(k, a - int(offsets[owner[0]]))  # of a text that began in an earlier block
            padded[k - before : k] = data[a - before : a]
            bits = self._lengths(grams(padded, k + 1)[place - k], k)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the shortest code and its posterior under equal priors."""
        bits = self.code_lengths(data, offsets)
        best = bits.argmin(1)
        gap = np.minimum(bits - bits[np.arange(len(bits)), best][:, None], 1000)
        return best, 1.0 / np.exp2(-gap).sum(1)


def training_sample(docs: DataFrame, docs_per_language: int) -> dict[str, list[str]]:
    """About docs_per_language labelled texts of each language, chosen by hash.

    A bounded sample: its number of rows does not grow with the input.  Whole texts
    of any length are taken; the languages, as many as the model has, are collected.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, docs_per_language / n)])
    picked = rows.filter(sample_fraction(F.struct("doc_id", F.length("text")), "langid") < F.element_at(share, F.col("lang")))
    out: dict[str, list[str]] = {}
    for r in picked.select("doc_id", "lang", "text").toLocalIterator():
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: sorted(v) for k, v in out.items()}


def fit(docs: DataFrame, docs_per_language: int = 400, order: int = ORDER) -> PpmModel:
    """Train on a bounded sample of the rows of docs that have a lang."""
    return PpmModel(training_sample(docs, docs_per_language), order)


def identify(docs: DataFrame, model: PpmModel, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with lang_pred, score and bits_per_byte."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    names = [f"_k{i}" for i in range(len(keep))]
    ready = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.lower("text").alias("_t"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_ok"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in rows_of(batches, 4 * BLOCK, "_t"):
            data, at = utf8(batch.column("_t"))
            ok = batch.column("_ok").to_numpy(zero_copy_only=False).astype(bool)
            bits = m.code_lengths(data, at)
            if m.langs:
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                score = np.where(ok, 1.0 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1), 0.0)
                lang = [m.langs[b] if y else "und" for b, y in zip(best, ok, strict=True)]
                rate = np.where(ok, least / np.maximum(np.diff(at), 1), 0.0)
            else:
                lang, score, rate = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[*keep, "lang_pred", "score", "bits_per_byte"])

    return ready.mapInArrow(work, f"{schema}, lang_pred string, score double, bits_per_byte double")


def remainder(column: str, by: int):
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0)) % by


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(remainder("doc_id", 3) != 1))
    found = identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a language (und: no letters) go, however sure the others' is."""
    model = fit(docs.filter(remainder("doc_id", 3) != 1))
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    rows = docs.toDF(*inner).withColumn("text", F.col(inner[names.index("text")]))
    found = identify(rows, model, inner)
    return found.filter(F.col("lang_pred") != "und").select(*inner).toDF(*names)
