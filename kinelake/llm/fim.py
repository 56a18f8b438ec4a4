"""Fill-in-middle transformation by an Aho-Corasick event scan.

A text is cut in three at two places that count units, and its parts are written
prefix-suffix-middle or suffix-prefix-middle with sentinels between them.  One
automaton holds the sentinels and the ASCII characters that change the class of
what follows (CHANGERS of a unit rule).  A scan reports only these events: a gap
between two of them holds one class of characters, so its number of units is
arithmetic, ceil(length / step), and a changer is one unit.  The running sums of
units at the events are all that is kept of a text: unit number r is found by a
binary search over them and a product within its gap.

Defined results: null and empty text has no unit and is written plainly, as is a
text that contains a sentinel; a null doc_id hashes as no digits; bytes that are no
UTF-8 are a unit each and come back unchanged; repeated rows are transformed one by
one, to equal outputs; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import rows_of, table, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those from the first number on stay plain; of 100 others, those below the second are suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Text bytes that a worker takes at once, one text at least.
BLOCK = 1 << 22


@dataclass(frozen=True)
class UnitRule:
    """changers: ASCII characters that are events and a unit each; step: code points of a unit in a gap (None: the gap is one)."""

    changers: str
    step: int | None


#: Code points (a line of n of them has n units, its end is one more), words with blanks, and pieces of lines.
UNITS = {"points": UnitRule("\n", 1), "words": UnitRule(" \t\n\x0b\x0c\r", None), "pieces": UnitRule("\n", 80)}


class EventScan:
    """The automaton of a unit rule and some sentinels, or none."""

    def __init__(self, rule: UnitRule, sentinels: tuple[str, ...]):
        if not all(sentinels) or any(not c.isascii() for c in rule.changers):
            raise ValueError("sentinels must not be empty and class changers must be ASCII")
        self.rule = rule
        self.automaton = ahocorasick.Automaton()
        for word in set(rule.changers) | set(sentinels):
            self.automaton.add_word(word, word in sentinels)
        self.automaton.make_automaton()

    def read(self, text: str) -> Ranks | None:
        """The ranks of a text, or None as soon as it shows a sentinel."""
        at = []
        for end, sentinel in self.automaton.iter(text):
            if sentinel:
                return None
            at.append(end)
        return Ranks(self.rule.step, np.array(at, np.int64), len(text))


class Ranks:
    """Units before each gap of a text, and the place of any unit."""

    def __init__(self, step: int | None, events: np.ndarray, length: int):
        self.step = step or max(length, 1)
        self.start = np.concatenate(([0], events + 1))
        self.gap = np.concatenate((events, [length])) - self.start
        units = -(-self.gap // self.step)
        self.before = np.concatenate(([0], np.cumsum(units[:-1] + 1)))
        self.n = int(self.before[-1] + units[-1])
        self.length = length

    def place(self, rank: int) -> int:
        """Code points before unit number `rank`; the length for the number of units."""
        if rank >= self.n:
            return self.length
        k = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.start[k] + min((rank - self.before[k]) * self.step, self.gap[k]))


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four integers of 32 bits from the hash of seed and doc_id."""
    digits = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "points", seed: str = "1:", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row of docs."""
    before, after, inside = sentinels
    rule = UNITS[unit]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = EventScan(rule, sentinels)
        plain_scan = EventScan(rule, ())  # counts the units of a text with sentinels in it
        for batch in rows_of(batches, BLOCK, "text"):
            data, at = utf8(batch.column("text"))
            h = [batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)]
            n, form, first, middle, out = [], [], [], [], []
            for i in range(batch.num_rows):
                raw = data[at[i] : at[i + 1]].tobytes()
                text = raw.decode("utf-8", "surrogateescape")
                ranks = scan.read(text)
                n.append((ranks or plain_scan.read(text)).n)
                if ranks is None or not text or h[2][i] % 100 >= PLAIN_FROM:
                    form.append("plain")
                    first.append(None)
                    middle.append(None)
                    out.append(raw)
                    continue
                a, b = (ranks.place(r) for r in sorted((h[0][i] % (ranks.n + 1), h[1][i] % (ranks.n + 1))))
                form.append("spm" if h[3][i] % 100 < SPM_BELOW else "psm")
                first.append(a)
                middle.append(b - a)
                head, tail = before + text[:a], after + text[b:]
                whole = (tail + head if form[-1] == "spm" else head + tail) + inside + text[a:b]
                out.append(whole.encode("utf-8", "surrogateescape"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    made = docs.select("doc_id", "text", *draws(F.col("doc_id"), seed)).mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made from."""
    # a character for each byte: bytes that are no UTF-8 stay as they are
    pattern = "|".join(re.escape(x.encode().decode("latin-1")) for x in sentinels)
    parts = F.split(F.decode(output.cast("binary"), "ISO-8859-1"), pattern, -1)
    p, s, m = (F.when(form == "spm", F.get(parts, F.lit(b))).otherwise(F.get(parts, F.lit(a))) for a, b in ((1, 2), (2, 1), (3, 3)))
    return F.when(form == "plain", output).otherwise(F.encode(F.concat(p, m, s), "ISO-8859-1").cast("string"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
