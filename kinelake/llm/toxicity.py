"""Toxicity: a subsequence string-kernel SVM with Nystroem landmarks.

A sentence is a string of letters: case, accents and common look-alikes (digits
and marks that stand for letters) are folded, and white space and marks are
skippable gaps, so they are left out ("i d i o t" and "id-iot" read as "idiot").
The kernel compares sliding windows of a sentence, WINDOWS letters wide, which
may start at any letter.  phi(x) has a coordinate for every three-letter
subsequence of the window x, worth the sum of DECAY ** span over its occurrences
with a span of up to SPAN letters; so insults with inserted or missing letters
keep most of their coordinates.  k(x, z) = <phi(x), phi(z)> / (g(x) g(z)), g
being the norm of phi for a window of that length without repeats.  Landmarks Z
are windows of the training sentences; the Nystroem features of x are
k(x, Z) K_ZZ^(-1/2) and a linear SVM (squared hinge) is trained on them.  Only
documents carry labels, so the training is multiple-instance: a toxic document's
most suspicious windows stand for its toxic sentences and are chosen again after
each fit; every window of a clean document is clean.

As k is an inner product of known coordinates, the trained decision value is
<phi(x), v> / g(x) + b with one number v per subsequence; that table is exact,
has a fixed size (64 ** 3) and is all that is sent to the executors.  A
document's score is a logistic function of its highest decision values and
of the logarithm of its number of letters.

Defined results: null and empty text has no window and gets the score of a
document without suspicious windows; repeated rows are scored one by one; with
no usable labels every score is 0; only text is read when scoring.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import rows_of, table, utf8
from .langid import remainder

DECAY = 0.7
SPAN = 6
#: Letters of a window; a shorter sentence is one window.
WINDOWS = (8, 14)
#: Symbols: 0 end of a sentence, 1-26 letters, 27-63 other letters by hash.
SYMBOL_BITS = 6
SYMBOLS = 1 << SYMBOL_BITS
#: Text bytes scored at once, and bytes that two pieces of a longer sentence share.
BLOCK = 1 << 20
OVERLAP = 512
#: Marks that stand for letters.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
SENTENCE_MARKS = ".!?…。！？"
_KNOWN = 0x3100
_SPANS = range(2, SPAN)


def _symbol_of(point: int) -> int:
    char = LOOK_ALIKE.get(chr(point), chr(point))
    base = unicodedata.normalize("NFKD", char)[0].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    return 27 + ord(base) * 0x9E3B % 65521 % (SYMBOLS - 27) if unicodedata.category(base)[0] == "L" else 0


_SYMBOL = np.array([_symbol_of(p) for p in range(_KNOWN)], np.uint8)
_MARK = np.isin(np.arange(_KNOWN), [ord(c) for c in SENTENCE_MARKS])
_BLANK = np.isin(np.arange(_KNOWN), [0x20, 9, 10, 11, 12, 13, 0xA0, 0x3000])


class Sentences:
    """The letters of some texts, sentence by sentence.

    symbols: letters, with SPAN zeros after each sentence; start, end and text of
    each sentence.  A sentence ends at a line's end, or at a mark that white space
    follows and a word of two letters precedes ("i. d. i. o. t." is one).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
        if at[-1] != len(points):  # bytes that are no UTF-8
            each = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            at = np.r_[0, np.cumsum([len(t) for t in each], dtype=np.int64)]
            points = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32)
        small = np.minimum(points, _KNOWN - 1)
        letter = np.where(points < _KNOWN, _SYMBOL[small], (27 + points.astype(np.int64) * 0x9E3B % 65521 % (SYMBOLS - 27)).astype(np.uint8))
        n = len(points)
        stop = np.zeros(n + 1, bool)
        stop[at] = True
        if n:
            inside = letter > 0
            blank_next = np.r_[_BLANK[small[1:]] & (points[1:] < _KNOWN), True]
            word = np.r_[False, False, inside[1:-1] & inside[:-2]] if n > 1 else np.zeros(n, bool)
            stop[1:] |= ((points < _KNOWN) & _MARK[small] & blank_next & word) | (points == 10)
        part = np.cumsum(stop[:n]) if n else np.zeros(0, np.int64)
        where = np.flatnonzero(letter > 0)
        _, first = np.unique(part[where], return_index=True)
        size = np.diff(np.r_[first, len(where)])
        self.start = first + SPAN * np.arange(len(first))
        self.end = self.start + size
        self.text = np.searchsorted(at, where[first], side="right") - 1
        self.symbols = np.zeros(len(where) + SPAN * len(first), np.int32)
        self.symbols[np.arange(len(where)) + SPAN * np.repeat(np.arange(len(first)), size)] = letter[where]
        self.letters = np.bincount(np.repeat(self.text, size), minlength=len(offsets) - 1)

    def rows(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Windows as rows of symbols, the longest width wide, with zeros behind."""
        at = np.arange(max(WINDOWS))
        ext = np.r_[self.symbols, np.zeros(max(WINDOWS), np.int32)]
        return np.where(at < size[:, None], ext[begin[:, None] + at], 0)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and text of every window of a width."""
        size = self.end - self.start
        count = np.maximum(size - width, 0) + 1
        begin = np.arange(int(count.sum())) + np.repeat(self.start - (np.cumsum(count) - count), count)
        return begin, np.repeat(np.minimum(size, width), count), np.repeat(self.text, count)


def norms(size: np.ndarray) -> np.ndarray:
    """g of windows with so many letters."""
    out = np.zeros(len(size))
    for j in _SPANS:
        out += (j - 1) * np.maximum(size - j, 0) * DECAY ** (2 * (j + 1))
    return np.sqrt(np.maximum(out, DECAY**6))


def by_span(symbols: np.ndarray, tables: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Running sums, by span, of the values of the subsequences that start before each position."""
    n = len(symbols)
    ext = np.r_[symbols, np.zeros(SPAN, np.int32)]
    high, out = symbols << 2 * SYMBOL_BITS, {}
    for j in _SPANS:
        last, total = high | ext[j : j + n], np.zeros(n, np.float32)
        for i in range(1, j):
            # subsequences that hold a sentence's end have the value 0
            total += tables[j][last | (ext[i : i + n] << SYMBOL_BITS)]
        out[j] = np.r_[0.0, np.cumsum(total, dtype=np.float64)]
    return out


def decisions(sums: dict[int, np.ndarray], begin: np.ndarray, size: np.ndarray, bias: float) -> np.ndarray:
    total = np.zeros(len(begin))
    for j in _SPANS:
        total += sums[j][begin + np.maximum(size - j, 0)] - sums[j][begin]
    return total / norms(np.arange(max(WINDOWS) + 1))[size] + bias


def weight_tables(v: np.ndarray) -> dict[int, np.ndarray]:
    code = np.arange(SYMBOLS**3)
    low = SYMBOLS - 1
    clean = np.where((code >> 2 * SYMBOL_BITS > 0) & (code >> SYMBOL_BITS & low > 0) & (code & low > 0), v, 0.0)
    return {j: (clean * DECAY ** (j + 1)).astype(np.float32) for j in _SPANS}


def coordinates(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and values (phi / g) of windows, given as rows of symbols with zeros behind."""
    width = windows.shape[1]
    size = (windows > 0).sum(1)
    codes, values = [], []
    for j in _SPANS:
        for i in range(1, j):
            a, b, c = windows[:, : width - j], windows[:, i : width - j + i], windows[:, j:]
            codes.append((a << 2 * SYMBOL_BITS) | (b << SYMBOL_BITS) | c)
            values.append(np.where(c > 0, DECAY ** (j + 1), 0.0))
    return np.hstack(codes), (np.hstack(values) / norms(size)[:, None]).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, reg: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by damped Newton steps; the last weight is the bias."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], reg)
    ridge[-1] = 1e-8
    for _ in range(steps):
        slack = 1 - y * (a @ w)
        on = slack > 0
        grad = ridge * w - (a[on] * (cost * slack * y)[on, None]).sum(0) / len(x)
        hess = np.diag(ridge) + (a[on].T * cost[on]) @ a[on] / len(x)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a.T * (p * (1 - p) + 1e-9)) @ a + 0.5 * np.eye(a.shape[1])
        step = np.linalg.solve(hess, a.T @ (p - y) + 0.5 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Nystroem:
    """Features of windows against landmarks, and the weights of subsequences they make."""

    def __init__(self, landmarks: np.ndarray):
        codes, values = coordinates(landmarks)
        self.codes = np.unique(codes[values > 0])
        z = np.zeros((len(self.codes) + 1, len(landmarks)), np.float32)
        at = np.searchsorted(self.codes, codes)
        at[values == 0] = len(self.codes)
        np.add.at(z, (at, np.arange(len(landmarks))[:, None]), values)
        own, vectors = np.linalg.eigh(z.T @ z)
        keep = own > 1e-4 * own.max()
        self.root = z @ (vectors[:, keep] / np.sqrt(own[keep])).astype(np.float32)
        self.root[-1] = 0

    def features(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(windows), 64):
            codes, values = coordinates(windows[a : a + 64])
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            at[self.codes[at] != codes] = len(self.codes)
            out.append(np.einsum("nck,nc->nk", self.root[at], values))
        return np.vstack(out)

    def weights(self, w: np.ndarray) -> np.ndarray:
        v = np.zeros(SYMBOLS**3)
        v[self.codes] = self.root[:-1] @ w.astype(np.float32)
        return v


class SentenceKernelModel:
    """Trained weights: v and bias of the SVM, and the logistic's."""

    def __init__(self, texts: list[str], toxic: list[int], landmarks: int = 320, rounds: int = 3, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.v = np.zeros(SYMBOLS**3)
        self.bias, self.link = 0.0, None
        y = np.asarray(toxic, int)
        if not len(y) or y.min() == y.max():
            return
        # texts are read in parts: the windows of all of them would not fit
        raw = [t.encode("utf-8", "replace") for t in texts]
        offsets = np.r_[0, np.cumsum([len(t) for t in raw])]
        cuts = np.flatnonzero(np.diff(offsets[:-1] // BLOCK, prepend=-1))
        parts = []
        for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True):
            parts.append((Sentences(np.frombuffer(b"".join(raw[a:b]), np.uint8), offsets[a : b + 1] - offsets[a]), y[a:b]))
        del raw
        clean_windows = np.array([int(np.maximum(r.end - r.start - max(WINDOWS), 0)[label[r.text] == 0].sum() + (label[r.text] == 0).sum()) for r, label in parts])
        positive = first_guess(parts)
        if not clean_windows.sum() or not len(positive):
            return
        hard = positive[:0]
        some = lambda x, n: x[rng.permutation(len(x))[:n]]
        for _ in range(rounds):
            # as many windows of clean documents as there are training documents
            counts = rng.multinomial(len(y), clean_windows / clean_windows.sum())
            negative = np.vstack([random_windows(r, label, n, rng) for (r, label), n in zip(parts, counts, strict=True)] + [hard])
            maps = Nystroem(np.vstack([some(np.unique(positive, axis=0), landmarks // 2), some(negative, landmarks // 2)]))
            x = np.vstack([maps.features(positive), maps.features(negative)])
            label = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
            w, self.bias = svm(x, label, np.where(label > 0, len(negative) / len(positive), 1.0))
            self.v = maps.weights(w)
            tables, picks, hard_picks = weight_tables(self.v), [], []
            for read, label in parts:
                begin, size, text = read.windows(max(WINDOWS))
                if not len(begin):
                    continue
                value = decisions(by_span(read.symbols, tables), begin, size, self.bias)
                best = highest(value, text)
                sure = best[(label[text[best]] == 0) & (value[best] > -0.5)]
                best = best[label[text[best]] == 1]
                picks.append(read.rows(begin[best], size[best]))
                hard_picks.append(read.rows(begin[sure], size[sure]))
            positive, hard = np.vstack(picks), np.vstack(hard_picks)
        self.link = logistic(np.vstack([self.features(read, len(label)) for read, label in parts]), y)

    def features(self, read: Sentences, n: int) -> np.ndarray:
        """Highest decision value of each width, clipped, and log letters of each text."""
        return np.c_[np.clip(self.tops(read, n), -2, 2), np.log1p(read.letters)]

    def tops(self, read: Sentences, n: int) -> np.ndarray:
        sums = by_span(read.symbols, self._tables())
        out = np.full((n, len(WINDOWS)), -2.0)
        for k, width in enumerate(WINDOWS):
            begin, size, text = read.windows(width)
            if len(begin):
                value = decisions(sums, begin, size, self.bias)
                best = highest(value, text)
                out[text[best], k] = value[best]
        return out

    def _tables(self) -> dict[int, np.ndarray]:
        if getattr(self, "_cached", None) is None:
            self._cached = weight_tables(self.v)
        return self._cached

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k != "_cached"}

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.link is None:
            return np.zeros(n)
        tops, letters = np.full((n, len(WINDOWS)), -2.0), np.zeros(n)
        for a, b, first, last in pieces(data, offsets):
            inner = np.clip(offsets[first : last + 1], a, b) - a
            read = Sentences(data[a:b], inner)
            tops[first:last] = np.maximum(tops[first:last], self.tops(read, last - first))
            letters[first:last] += read.letters
        x = np.c_[np.clip(tops, -2, 2), np.log1p(letters), np.ones(n)]
        return 1 / (1 + np.exp(-np.clip(x @ self.link, -30, 30)))


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First and last byte, and first and last text, of what is scored at once.

    Whole texts, BLOCK bytes together; a longer one is cut at line ends, or else
    so that two pieces share OVERLAP bytes.
    """
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1
        if last > first:
            yield int(offsets[first]), int(offsets[last]), first, last
            first = last
            continue
        a, end = int(offsets[first]), int(offsets[first + 1])
        while end - a > BLOCK:
            lines = np.flatnonzero(data[a + BLOCK // 2 : a + BLOCK] == 10)
            b = a + BLOCK // 2 + int(lines[-1]) + 1 if len(lines) else a + BLOCK
            while b > a + 1 and data[b] & 0xC0 == 0x80:
                b -= 1
            yield a, b, first, first + 1
            a = b if len(lines) else b - OVERLAP
            while data[a] & 0xC0 == 0x80 and a < b:
                a += 1
        yield a, end, first, first + 1
        first += 1


def highest(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Index of the first highest value of each text; windows of a text follow each other."""
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    top = np.repeat(np.maximum.reduceat(value, first), np.diff(np.r_[first, len(value)]))
    at = np.flatnonzero(value == top)
    return at[np.r_[True, text[at][1:] != text[at][:-1]]]


def random_windows(read: Sentences, label: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    begin, size, text = read.windows(max(WINDOWS))
    clean = np.flatnonzero(label[text] == 0)
    at = rng.choice(clean, min(n, len(clean)), replace=False)
    return read.rows(begin[at], size[at])


def first_guess(parts: list[tuple[Sentences, np.ndarray]], piece: int = 5, bits: int = 22) -> np.ndarray:
    """The window of each toxic text whose pieces of five letters tell most for toxicity."""

    def codes(symbols: np.ndarray) -> np.ndarray:
        ext = np.r_[symbols, np.zeros(piece, np.int32)].astype(np.uint64)
        code = np.zeros(len(symbols), np.uint64)
        for k in range(piece):
            code = code * np.uint64(SYMBOLS) + ext[k : k + len(symbols)]
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    seen = np.zeros((2, 1 << bits), np.int32)
    texts = np.zeros(2, np.int64)
    for read, label in parts:
        owner = np.repeat(read.text, np.diff(np.r_[read.start, len(read.symbols)]))
        pair = np.unique(owner << bits | codes(read.symbols)) if len(owner) else np.zeros(0, np.int64)
        of = label[pair >> bits]
        for y in (0, 1):
            seen[y] += np.bincount(pair[of == y] & ((1 << bits) - 1), minlength=1 << bits).astype(np.int32)
            texts[y] += (label == y).sum()
    odds = np.log((seen[1] + 0.5) / (texts[1] + 1)) - np.log((seen[0] + 0.5) / (texts[0] + 1))
    odds = np.where(seen[1] < 3, -1.0, np.maximum(odds, -1.0))
    picks = [np.zeros((0, max(WINDOWS)), np.int32)]
    for read, label in parts:
        begin, size, text = read.windows(max(WINDOWS))
        if len(begin):
            total = np.r_[0.0, np.cumsum(odds[codes(read.symbols)])]
            best = highest(total[begin + np.maximum(size - piece + 1, 1)] - total[begin], text)
            best = best[label[text[best]] == 1]
            picks.append(read.rows(begin[best], size[best]))
    return np.vstack(picks)


def fit(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int] = (3000, 1200)) -> SentenceKernelModel:
    """Fit on a bounded sample: at most per_label clean and toxic documents.

    The sample is chosen by hash of doc_id among the labelled ones; whole texts of any
    length are taken.  Contradictory repeated labels go.
    """
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).filter("toxic = _most").drop("_most")
    turn = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    picked = marks.filter("toxic = 0").orderBy(turn, "doc_id").limit(per_label[0]).unionAll(marks.filter("toxic = 1").orderBy(turn, "doc_id").limit(per_label[1]))
    # bounded by per_label, so it can be broadcast: texts are chosen in the scan
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    rows = sorted(((r["text"], int(r["toxic"])) for r in rows.select("text", "toxic").toLocalIterator()))
    return SentenceKernelModel([r[0] for r in rows], [r[1] for r in rows])


def score(docs: DataFrame, model: SentenceKernelModel) -> DataFrame:
    """doc_id and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BLOCK, "text"):
            data, at = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(data, at), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2)
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
