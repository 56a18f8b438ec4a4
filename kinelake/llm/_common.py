"""Helpers shared by the training-data operators.

Everything that runs inside an executor works on Arrow buffers through numpy:
a text column's value buffer already is the concatenation of the UTF-8 bytes
of its rows, so no per-row Python string is made on a hot path.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the word rule: bytes that end a word (space, tab .. CR).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows that a Python worker takes at once, whatever the session's Arrow batches are.
ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^,\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder: master is {master}")
        # one process, as in tests: driver and tasks share the machine's folders
        base = f"file://{tempfile.gettempdir()}/kinelake-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/kinelake-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def hot_join(rows: DataFrame, one_each: DataFrame, key: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined with one_each (a row for each key, or none) on key.

    A key may have any share of the rows: they are dealt by key and a hash of `by`.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    one_each = one_each.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # repeated rows compress well and so look small: no broadcast
    return rows.join(one_each.hint("merge"), [key, "_salt"], how).drop("_salt")


def sample_fraction(column, seed: str):
    """A deterministic uniform value in [0, 1) from a column's hash."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 30)) / F.lit(float(1 << 30))


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes and n + 1 offsets of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, values = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def ascii_lower(data: np.ndarray) -> np.ndarray:
    table_ = np.arange(256, dtype=np.uint8)
    table_[65:91] += 32
    return table_[data]


def space_mask(data: np.ndarray) -> np.ndarray:
    table_ = np.zeros(256, bool)
    table_[list(SPACE_BYTES)] = True
    return table_[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first-word indexes (n + 1) of the words of every text.

    A word never crosses the border between two texts.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space_mask(data)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def powers(n: int, base: np.uint64) -> np.ndarray:
    base = np.full(1, base)
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * (out[have - 1 : have] * base)
        have += take
    return out


class SpanHash:
    """64-bit content hashes of byte spans of one buffer, in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        terms = _CODES[data]
        if n:
            terms *= powers(n, _BASE)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.total[1:])
        del terms
        self.back = powers(n + 1, _INV)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.total[ends] - self.total[starts]) * self.back[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Content hashes of ascending spans, a piece of the data at a time: less memory."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + piece, side="right")), first + 1)
        a, b = starts[first], ends[last - 1]
        out[first:last] = SpanHash(data[a:b]).of(starts[first:last] - a, ends[first:last] - a)
        first = last
    return out


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str, most_rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many rows and text bytes each, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = utf8(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + most_bytes, side="right")) - 1
            last = min(max(last, first + 1), first + most_rows, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
