"""Token-id files with directly addressable codes (DAC).

An id is cut into chunks of CHUNK_BITS bits, the lowest first.  Level l of a
file holds the l-th chunk of every id that has one, and a bitmap that tells
which of those ids go on to level l + 1.  The rank directory of a bitmap holds
the number of set bits before every RANK_WORDS words, so the place of an id in
the next level is found in constant time: any token is read without decoding a
block.

File layout, little endian: magic b"DAC1", then uint32 levels, uint64 ids,
uint64 documents; int64 document ids; uint64 document ends (ids before each
end); then per level uint64 n, n chunk bytes padded to 8, and, for all levels
but the last, ceil(n / 64) bitmap words of 64 bits and uint64 rank entries.

Files are written in ascending order of doc_id: the ids are range-partitioned
by doc_id, each task streams its sorted partition to one or more files in the
shared folder under a name of its own and reports them in a manifest, so a task
that is run again only leaves a file that nobody reads.

Defined results: null text counts as empty and has the end id alone; a null
doc_id comes first; repeated rows are encoded one by one; an empty table gives
no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import io
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import ascii_lower, rows_of, shared_folder, shuffle_parts, table, utf8, word_hashes, word_spans, written

CHUNK_BITS = 8
RANK_WORDS = 8
END_ID = 2
#: Ids of a file, about; a partition with more is split over several files.
FILE_IDS = 1 << 22
#: Ids read back at once, or those of one document.
READ_IDS = 1 << 16
#: Text bytes encoded at once.
BLOCK = 1 << 20


class DacWriter:
    """Encodes ids with document borders to bytes."""

    @staticmethod
    def to_bytes(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> bytes:
        ids = np.ascontiguousarray(ids, np.uint32)
        levels = []
        rest = ids
        while True:
            more = rest >> CHUNK_BITS
            chunk = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8)
            on = more > 0
            levels.append((chunk, on))
            if not on.any():
                break
            rest = more[on]
        out = io.BytesIO()
        out.write(b"DAC1")
        out.write(np.uint32(len(levels)).tobytes())
        out.write(np.array([len(ids), len(doc_ids)], np.uint64).tobytes())
        out.write(np.asarray(doc_ids, np.int64).tobytes())
        out.write(np.asarray(ends, np.uint64).tobytes())
        for k, (chunk, on) in enumerate(levels):
            out.write(np.uint64(len(chunk)).tobytes())
            out.write(chunk.tobytes())
            out.write(b"\0" * (-len(chunk) % 8))
            if k < len(levels) - 1:
                words = -(-len(on) // 64)
                bits = np.zeros(words * 8, np.uint8)
                packed = np.packbits(on, bitorder="little")
                bits[: len(packed)] = packed
                bits = bits.view(np.uint64)
                out.write(bits.tobytes())
                ones = np.bitwise_count(bits).astype(np.uint64)
                before = np.r_[np.uint64(0), np.cumsum(ones)[:-1]] if words else np.zeros(0, np.uint64)
                out.write(np.ascontiguousarray(before[::RANK_WORDS], np.uint64).tobytes())
        return out.getvalue()


class DacReader:
    """Random access to the ids of a file's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a DAC file")
        n_levels = int(np.frombuffer(data, np.uint32, 1, 4)[0])
        self.n_ids, n_docs = (int(x) for x in np.frombuffer(data, np.uint64, 2, 8))
        at = 24
        self.doc_ids = np.frombuffer(data, np.int64, n_docs, at)
        at += 8 * n_docs
        self.ends = np.frombuffer(data, np.uint64, n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.levels = []
        for k in range(n_levels):
            n = int(np.frombuffer(data, np.uint64, 1, at)[0])
            at += 8
            chunk = np.frombuffer(data, np.uint8, n, at)
            at += n + (-n % 8)
            bits = ranks = None
            if k < n_levels - 1:
                words = -(-n // 64)
                bits = np.frombuffer(data, np.uint64, words, at)
                at += 8 * words
                ranks = np.frombuffer(data, np.uint64, -(-words // RANK_WORDS), at)
                at += 8 * len(ranks)
            self.levels.append((chunk, bits, ranks))

    def get(self, index: np.ndarray) -> np.ndarray:
        """The ids at any positions, each found through the rank directories."""
        where = np.asarray(index, np.int64)
        out = np.zeros(len(where), np.uint32)
        live = np.arange(len(where))
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            out[live] |= chunk[where].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            if bits is None:
                break
            word, bit = where >> 6, (where & 63).astype(np.uint64)
            on = ((bits[word] >> bit) & np.uint64(1)).astype(bool)
            live, word, bit = live[on], word[on], bit[on]
            start = word - word % RANK_WORDS
            rank = ranks[word // RANK_WORDS].astype(np.int64)
            for step in range(RANK_WORDS - 1):
                inside = start + step < word
                rank[inside] += np.bitwise_count(bits[(start + step)[inside]])
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            where = rank + np.bitwise_count(below)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.get(np.arange(self.ends[i - 1] if i else 0, self.ends[i]))

    def all_ids(self) -> np.ndarray:
        """Every id, level by level."""
        rest = None
        for k in range(len(self.levels) - 1, -1, -1):
            chunk, bits, _ = self.levels[k]
            value = chunk.astype(np.uint32)
            if bits is not None:
                on = np.unpackbits(bits.view(np.uint8), bitorder="little")[: len(chunk)].astype(bool)
                value[on] |= rest << np.uint32(CHUNK_BITS)
            rest = value
        return rest if rest is not None else np.zeros(0, np.uint32)


def without_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans with marks at a word's end as words of their own.

    Marks after an ASCII letter or digit are a piece of the tokenizer's, so the
    ids stay the same and there are fewer different words.
    """
    if not len(starts):
        return starts, ends
    place = np.arange(len(data))
    core = np.maximum.accumulate(np.where(_MARK[data], -1, place))[ends - 1] + 1
    split = (core > starts) & (core < ends)
    split[split] = _ALNUM[data[core[split] - 1]]
    at = np.flatnonzero(split)
    cut = ends.copy()
    cut[at] = core[at]
    return np.insert(starts, at + 1, core[at]), np.insert(cut, at + 1, ends[at])


def _bytes(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_MARK = _bytes(b".,!?;:%*&$#|-")
_ALNUM = _bytes(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class WordEncoder:
    """Ids of texts, each different word encoded once.

    The tokenizer's pieces never hold white space, so a text's ids are those of
    its words in turn.  The memory of words is emptied when it holds MOST_WORDS.
    """

    MOST_WORDS = 400_000

    #: Words that are encoded as one text.
    TOGETHER = 500
    #: Fixed value: the pieces that the tokenizer cuts words into.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        # tokens that end a piece, where the tokenizer marks them
        self.ends_piece = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(tokenizer.get_vocab_size())])
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and the number of each, from the ids of the joined text.

        A word of n pieces takes the ids up to its n-th end of a piece; where
        these don't add up, the words are encoded one by one.
        """
        ids = np.array(self.encode([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        pieces = np.array([len(self.PIECES.findall(unicodedata.normalize("NFC", w).lower())) for w in words])
        ends = np.flatnonzero(self.ends_piece[ids])
        if len(ends) == pieces.sum() and pieces.all() and (not len(ids) or ends[-1] == len(ids) - 1):
            return ids, np.diff(np.r_[0, ends[np.cumsum(pieces) - 1] + 1])
        alone = [e.ids for e in self.encode(words, add_special_tokens=False)]
        return np.array([i for x in alone for i in x], np.uint32), np.array([len(x) for x in alone])

    def _learn(self, words: list[bytes]) -> None:
        text = [w.decode() for w in words]
        found = [self._encoded(text[i : i + self.TOGETHER]) for i in range(0, len(text), self.TOGETHER)]
        values = np.concatenate([f[0] for f in found])
        ends = self.ends[-1] + np.cumsum(np.concatenate([f[1] for f in found]))
        while ends[-1] > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(len(self.flat), np.uint32)]
        self.flat[self.ends[-1] : ends[-1]] = values
        self.known.update(zip(words, range(len(self.ends) - 1, len(self.ends) - 1 + len(words)), strict=True))
        self.ends = np.r_[self.ends, ends]

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text, and the n + 1 offsets of the texts."""
        if len(self.known) > self.MOST_WORDS:
            self._clear()
        if b"<|" not in data.tobytes():
            data = ascii_lower(data)  # as the tokenizer does, but for its special tokens
        starts, ends, first = word_spans(data, offsets)
        starts, ends = without_marks(data, starts, ends)
        first = np.searchsorted(starts, offsets)
        _, at, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        place = np.array([self.known[w] for w in words], np.int64)[which] if words else np.zeros(0, np.int64)
        size = self.ends[place + 1] - self.ends[place]
        # an end id is a word of its own, after the words of its text
        n_text = len(offsets) - 1
        room = np.insert(size, first[1:], 1)
        is_end = np.zeros(len(room), bool)
        is_end[first[1:] + np.arange(n_text)] = True
        source = np.zeros(len(room), np.int64)
        source[~is_end] = self.ends[place]
        total = np.cumsum(room)
        inside = np.arange(total[-1] if len(total) else 0) - np.repeat(total - room, room)
        out = self.flat[np.repeat(source, room) + inside]
        out[total[is_end] - 1] = end_id
        return out, np.r_[0, total[is_end]]


_ENCODERS: dict[str, WordEncoder] = {}


def in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text and part: docs in ranges of doc_id, nulls first, each range in order.

    Rows of one doc_id are told apart by a hash of their texts, so a doc_id, or null,
    may have any share of the rows; of rows that are equal in both the order is open.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return rows.repartitionByRange(shuffle_parts(docs.sparkSession), *key).sortWithinPartitions(*key, "text").withColumn("part", F.spark_partition_id())


def write_files(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str) -> DataFrame:
    """Write the ids of docs in order of doc_id; the manifest has a row per file.

    The texts are dealt by range before they are encoded, so a task encodes and
    writes its range in one pass.
    """
    ordered = in_ranges(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        # a worker keeps its memory of words between tasks
        if tokenizer_file not in _ENCODERS:
            _ENCODERS[tokenizer_file] = WordEncoder(tokenizer_file)
        held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
        count = seq = part = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count, seq
            doc_ids = [d for h in held for d in h[0]]
            values = np.concatenate([h[1] for h in held])
            ends = np.cumsum(np.concatenate([h[2] for h in held]))
            data = DacWriter.to_bytes(values, np.array([d or 0 for d in doc_ids], np.int64), ends)
            path = f"{root}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(data)
            row = {"path": [path], "part": [part], "seq": [seq], "n_ids": [len(values)], "n_docs": [len(doc_ids)], "nulls": [sum(d is None for d in doc_ids)]}
            held, count, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("nulls", pa.int64())]))

        for batch in rows_of(batches, BLOCK, "text"):
            part = batch.column("part")[0].as_py()
            ids, at = _ENCODERS[tokenizer_file].ids(*utf8(batch.column("text")), end_id)
            held.append((batch.column("doc_id").to_pylist(), ids, np.diff(at)))
            count += len(ids)
            if count >= FILE_IDS:
                yield flush()
        if held:
            yield flush()

    return ordered.mapInArrow(work, "path string, part int, seq int, n_ids long, n_docs long, nulls long")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files."""
    spark = manifest.sparkSession
    # one row per file of some 4 million ids
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    placed = placed.repartition(shuffle_parts(spark), "path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base, nulls in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), batch.column("nulls").to_pylist(), strict=True):
                with fs.open_input_stream(path) as src:
                    reader = DacReader(src.read())
                ends = reader.ends
                starts = np.r_[0, ends[:-1]]
                crc = [0] * len(ends)
                first = 0
                while first < len(ends):  # a run of documents at a time, through the rank directories
                    last = max(int(np.searchsorted(ends, starts[first] + READ_IDS, side="right")), first + 1)
                    ids = reader.get(np.arange(starts[first], ends[last - 1])).astype("<u4").view(np.uint8)
                    for i in range(first, last):
                        crc[i] = zlib.crc32(ids[4 * (starts[i] - starts[first]) : 4 * (ends[i] - starts[first])])
                    first = last
                doc_ids = [None] * nulls + reader.doc_ids[nulls:].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> tuple[DataFrame, str]:
    """Write the files; the manifest and their folder."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens"
    return written(write_files(docs, tokenizer_file, end_id, folder), "manifest"), folder


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(*token_files(table(spark, sf_dir, "documents"), default_tokenizer()))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: token files of the documents that are left."""
    return read_files(*token_files(docs, default_tokenizer()))
