"""Language-model scores by deleted interpolation.

A text is its words, lower-cased in A-Z, and an end token.  A token's
probability mixes maximum-likelihood estimates of three orders:

    P(w | h) = l2[b] * c(h, w) / c(h) + l1[b] * c(w) / N + l0[b] / (V + 1)

h is the token before (or the start of the text), b the bucket of c(h), its
logarithm, N the training tokens and V their vocabulary.  The weights of each
bucket are learned by expectation-maximisation: the counts come from seven
eighths of the training documents and the weights maximise the likelihood of the
counts of the held-out eighth; the final counts are those of all training
documents.

Counts cover the whole corpus and are keyed by 64-bit hashes of words and word
pairs, so no table of them is ever broadcast.  Documents are written once as
blocks.  A block sends each of its different words and pairs once, with its count
in the block, to the hash range's partition, which adds up the counts of all
blocks and answers each block in the order of its keys; a word as common as may
be so has one entry per block.  c(h) is the count of the word before, which the
block knows too.

Defined results: null text is empty and has one token, the end; repeated rows
are scored (and count) each; without training documents every count is 0 and
tokens are uniform.  Only doc_id and text are read.  A block holds one text at
least, so a worker's memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, mix64, rows_of, shuffle_parts, table, utf8, word_hashes, word_spans, written
from .langid import remainder

#: Hashes of the end token and of the start of a text.
END_HASH = np.uint64(0x656E64206F662074)
START_HASH = np.uint64(0x7374617274206F66)
#: Text bytes of a block.
BLOCK = 4 << 20
HELD_PARTS = 8
#: Partitions of the counts and blocks, times the session's.
PARTS = 4
#: Steps of the held-out histogram in an octave.
STEPS = 2
BUCKETS = 64
_ONE = np.uint64(1)


def word_keys(words: np.ndarray) -> np.ndarray:
    """Keys of single tokens are even, those of pairs odd."""
    return mix64(words) & ~_ONE


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(mix64(before + np.uint64(0x2545F4914F6CDD1D)) ^ words * np.uint64(0x9E3779B97F4A7C15)) | _ONE


START_KEY = word_keys(np.array([START_HASH]))[0]


def tokens(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token and of the token before, and its text."""
    data = ascii_lower(text)
    starts, ends, first = word_spans(data, at)
    n_text = len(at) - 1
    words = np.insert(word_hashes(data, starts, ends), first[1:], END_HASH)
    owner = np.repeat(np.arange(n_text, dtype=np.int64), np.diff(first) + 1)
    before = np.r_[START_HASH, words[:-1]]
    before[first[:-1] + np.arange(n_text)] = START_HASH
    return words, before, owner


class Block:
    """A block's tokens, and its different keys in ascending order."""

    def __init__(self, text: bytes, lengths: np.ndarray):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        words, before, self.owner = tokens(raw, np.r_[0, np.cumsum(lengths)])
        n = len(words)
        # one start for each text, so that its count is a context's
        all_ = np.concatenate([word_keys(words), pair_keys(before, words), np.full(len(lengths), START_KEY)])
        self.keys, where = np.unique(all_, return_inverse=True)
        self.word, self.pair = where[:n], where[n : 2 * n]
        self.start = where[2 * n :]
        self.context = np.r_[0, self.word[:-1]]
        opens = np.flatnonzero(np.r_[True, self.owner[1:] != self.owner[:-1]])
        self.context[opens] = self.start[:1]

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Count of each key in the block's training texts."""
        mine = train[self.owner]
        out = np.bincount(self.word[mine], minlength=len(self.keys)) + np.bincount(self.pair[mine], minlength=len(self.keys))
        return out + np.bincount(self.start[train], minlength=len(self.keys))


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers byte plane by byte plane, compressed."""
    values = np.ascontiguousarray(values.astype("<u8"))
    wide = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :wide].T
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    wide = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(wide, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :wide] = planes.T
    return out.view("<u8").ravel()


def steps_of(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of docs (doc_id, text, train, held); held-out documents have blocks of their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def block(held: bool) -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(waiting[held])
            text, at = utf8(rows.column("text"))
            waiting[held], size[held] = [], 0
            number += 1
            lists = {"ids": pa.list_(pa.int64()), "train": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int64())}
            values = [rows.column("doc_id").to_pylist(), rows.column("train").to_pylist(), np.diff(at)]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([held]), *[pa.array([v], t) for v, t in zip(values, lists.values(), strict=True)], pa.array([zstandard.ZstdCompressor(level=3).compress(text.tobytes())], pa.binary())],
                names=["block", "held", *lists, "text"],
            )

        for batch in batches:
            is_held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for held in (False, True):
                part = batch.filter(pa.array(is_held == held))
                for piece in rows_of([part], BLOCK, "text"):
                    length = int(utf8(piece.column("text"))[1][-1])
                    if waiting[held] and size[held] + length > BLOCK:
                        yield block(held)
                    waiting[held].append(piece)
                    size[held] += length
        for held in (False, True):
            if waiting[held]:
                yield block(held)

    return docs.mapInArrow(work, "block long, held boolean, ids array<bigint>, train array<boolean>, lengths array<bigint>, text binary")


def _opened(rows: pa.RecordBatch | pa.Table, i: int) -> tuple[Block, np.ndarray, np.ndarray]:
    lengths = rows.column("lengths")[i].values.to_numpy()
    train = rows.column("train")[i].values.to_numpy(zero_copy_only=False).astype(bool)
    return Block(rows.column("text")[i].as_py(), lengths), train, lengths


def corpus_counts(texts: DataFrame, parts: int) -> DataFrame:
    """Answers to the blocks: block, p, and the counts of the block's keys in range p.

    A range's own row has no block and holds the vocabulary and the tokens (main and
    held-out) of the words in it.
    """
    edge = np.array([(p << 64) // parts for p in range(parts)] + [(1 << 64) - 1], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, train, _ = _opened(batch, i)
                n = block.counts(train)
                at = np.searchsorted(block.keys, edge[:-1])
                cuts = [(p, a, b) for p, (a, b) in enumerate(zip(at, [*at[1:], len(block.keys)], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _, _ in cuts], pa.int32()),
                        pa.array([batch.column("block")[i].as_py()] * len(cuts), pa.int64()),
                        pa.array([batch.column("held")[i].as_py()] * len(cuts), pa.bool_()),
                        pa.array([packed(steps_of(block.keys[a:b])) for _, a, b in cuts], pa.binary()),
                        pa.array([packed(n[a:b]) for _, a, b in cuts], pa.binary()),
                    ],
                    names=["p", "block", "held", "keys", "n"],
                )

    def count(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(k), dtype=np.uint64) for k in rows.column("keys").to_pylist()]
        n = np.concatenate([unpacked(k) for k in rows.column("n").to_pylist()]).astype(np.int64)
        held = rows.column("held").to_pylist()
        size = [len(k) for k in keys]
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        out = np.repeat(np.array(held, bool), size)
        main = np.bincount(at, np.where(out, 0, n), len(unique)).astype(np.int64)
        all_ = main + np.bincount(at, np.where(out, n, 0), len(unique)).astype(np.int64)
        words = ((unique & _ONE) == 0) & (unique != START_KEY)
        totals = np.array([(all_[words] > 0).sum(), main[words].sum(), (all_ - main)[words].sum()])
        answers, ends = [], np.cumsum(size)
        for is_held, a, b in zip(held, ends - size, ends, strict=True):
            answers.append((packed(all_[at[a:b]]), packed(main[at[a:b]]) if is_held else None))
        p = rows.column("p")[0].as_py()
        return pa.table(
            {
                "block": pa.array([*rows.column("block").to_pylist(), None], pa.int64()),
                "p": pa.array([p] * (len(size) + 1), pa.int32()),
                "n": pa.array([*[x for x, _ in answers], packed(totals)], pa.binary()),
                "main": pa.array([*[x for _, x in answers], None], pa.binary()),
                "held": pa.array([*held, None], pa.bool_()),
            }
        )

    # two ranges a partition, about, and partitions that Spark doesn't join: even shares
    sent = texts.mapInArrow(send, "p int, block long, held boolean, keys binary, n binary").repartition(-(-parts // 2), "p")
    return sent.groupBy("p").applyInArrow(count, "block long, p int, n binary, main binary, held boolean")


def answered(answers: pa.Table, column: str) -> np.ndarray:
    """Counts of a block's keys: its answers by range, in order."""
    order = np.argsort(answers.column("p").to_numpy())
    raw = answers.column(column).to_pylist()
    return np.concatenate([unpacked(raw[i]) for i in order]).astype(np.int64)


def by_block(rows: DataFrame):
    """rows dealt and grouped by block; many partitions, as a block has a few megabytes."""
    return rows.repartition(PARTS * shuffle_parts(rows.sparkSession), "block").groupBy("block")


def bucket_of(count: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(count + 1.0)).astype(np.int64)


def learn_weights(bucket: np.ndarray, r2: np.ndarray, r1: np.ndarray, r0: float, times: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (l0, l1, l2) of each bucket by EM; 0 in r2 or r1 is an unseen event."""
    weights = np.tile([0.2, 0.4, 0.4], (BUCKETS, 1))
    weights[0] = [0.5, 0.5, 0.0]
    if len(times):
        parts = np.c_[np.full(len(times), r0), r1, r2]
        for _ in range(rounds):
            share = weights[bucket] * parts
            share *= (times / share.sum(1))[:, None]
            total = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], 1)
            mass = total.sum(1, keepdims=True)
            # one count in a thousand keeps every order possible
            weights = np.where(mass > 0, (total + 1e-3) / (mass + 3e-3), weights)
        weights[0] = np.r_[weights[0, :2] / weights[0, :2].sum(), 0.0]
    return weights


def fit_weights(texts: DataFrame, answers: DataFrame, n_main: int, vocabulary: int) -> np.ndarray:
    """Weights of the buckets, from the held-out blocks and the main counts.

    A histogram of the held-out tokens by bucket and by logarithms of both
    ratios, in STEPS to the octave, reaches the driver: a table of bounded size.
    """

    def bins(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        codes = []
        for i in range(left.num_rows):
            block, _, _ = _opened(left, i)
            main = answered(right, "main")
            c1, c2, total = main[block.word], main[block.pair], main[block.context]
            step = lambda x: np.where(x > 0, np.floor(STEPS * np.log2(np.maximum(x, 1e-12))).astype(np.int64) + 512, 0)
            codes.append((bucket_of(total) << 20) | (step(c2 / np.maximum(total, 1)) << 10) | step(c1 / max(n_main, 1)))
        code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})

    got = by_block(texts.filter("held")).cogroup(by_block(answers.filter("held"))).applyInArrow(bins, "code long, n long")
    got = got.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = got.column("code").to_numpy(), got.column("n").to_numpy()
    ratio = lambda s: np.where(s > 0, np.exp2((s - 512 + 0.5) / STEPS), 0.0)
    return learn_weights(code >> 20, ratio(code >> 10 & 1023), ratio(code & 1023), 1 / (vocabulary + 1), n.astype(float))


def probabilities(c2: np.ndarray, c1: np.ndarray, total: np.ndarray, weights: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    w = weights[bucket_of(total)]
    return w[:, 2] * c2 / np.maximum(total, 1) + w[:, 1] * c1 / max(n, 1) + w[:, 0] / (vocabulary + 1)


def block_scores(texts: DataFrame, answers: DataFrame, weights: np.ndarray, n: int, vocabulary: int) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score and score of every document."""

    def work(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            block, train, lengths = _opened(left, i)
            all_ = answered(right, "n")
            c1 = all_[block.word]
            logp = np.log10(probabilities(all_[block.pair], c1, all_[block.context], weights, n, vocabulary))
            base = np.log10((c1 + 0.5) / (n + 0.5 * (vocabulary + 1)))
            sums = [np.bincount(block.owner, x, len(lengths)) for x in (np.ones(len(c1)), c1 > 0, base, logp)]
            ids = left.column("ids")[i].values
            out.append(pa.table({"doc_id": ids, "train": pa.array(train), "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64), "base_score": sums[2], "score": sums[3]}))
        names = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.concat_tables(out) if out else pa.schema(list(zip(names, kinds, strict=True))).empty_table()

    ours = answers.filter("block IS NOT NULL").select("block", "p", "n")
    return by_block(texts).cogroup(by_block(ours)).applyInArrow(work, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, train) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    train: a boolean expression of doc_id that marks the training documents.
    """
    # a range is what a worker holds
    parts = 2 * PARTS * shuffle_parts(docs.sparkSession)
    held = train & (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD_PARTS)) == 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = written(blocks(rows.select("doc_id", "text", train.alias("train"), held.alias("held"))), "blocks")
    answers = written(corpus_counts(texts, parts), "answers")
    totals = [unpacked(r["n"]) for r in answers.filter("block IS NULL").select("n").collect()]  # one row for each range
    vocabulary, main, out = (int(sum(int(t[k]) for t in totals)) for k in range(3))
    n = main + out
    weights = fit_weights(texts, answers, main, vocabulary)
    if not n:
        weights[:] = [1.0, 0.0, 0.0]
    each = block_scores(texts, answers, weights, n, vocabulary)
    return each.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)
