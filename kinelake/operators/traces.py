"""Traces of runs as rows of entries: counts, rendering and comparison of two runs.

An entry has trace, seq, stage, kind, at_ms, message and data (a map of strings, or
null).  Entries of one trace are ordered by seq; equal ones by stage, kind and message.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of entries and the mark before each one's message.
MARKS = {"step": "  ", "decision": "->", "reject": " x", "note": "  ", "error": " !"}
KINDS = ["step", "decision", "reject", "note", "error", "sentinel"]
#: Kinds that a rendering keeps; None keeps all.
SHOWN = {"all": None, "decisions": ["decision", "reject", "error"], "problems": ["reject", "error"]}
#: Data of an entry that its message already tells.
TOLD = ["outcome", "what"]

_ORDER = ["seq", "stage", "kind", "message"]


def trace_counts(entries: DataFrame) -> DataFrame:
    """trace, a count for each kind and duration_ms, the time of the last entry."""
    last = F.max_by("at_ms", F.struct(*_ORDER)).cast("long").alias("duration_ms")
    return entries.groupBy("trace").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS], last)


def rendered(entries: DataFrame, traces: DataFrame, show: str = "all", width: int = 96) -> DataFrame:
    """trace, line_no and line: the text of each trace, line by line.

    traces has trace, subject and context (a map of strings, or null) and one row for
    each trace; a trace without entries has its head alone.  A stage that differs from
    that of the entry shown before gets a heading after an empty line.  Only entries'
    lines are cut to the width.  Data and context stand in order of their keys.
    """
    kept = entries if SHOWN[show] is None else entries.filter(F.col("kind").isin(SHOWN[show]))
    w = Window.partitionBy("trace").orderBy(*_ORDER)
    kept = kept.withColumn("_place", F.row_number().over(w)).withColumn("_before", F.lag("stage").over(w))
    fresh = (F.col("_place") == 1) | ~F.col("stage").eqNullSafe(F.col("_before"))
    heading = F.when(fresh, F.array(F.lit(""), F.concat(F.lit("["), F.coalesce("stage", F.lit("")), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    mark = F.element_at(F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair]), F.col("kind"))
    said = F.substring(F.format_string(" %5dms %s %s", "at_ms", F.coalesce(mark, F.lit("  ")), F.coalesce("message", F.lit(""))), 1, width)
    more = F.transform(F.filter(F.array_sort(F.map_entries("data")), lambda e: ~e["key"].isin(TOLD)), lambda e: F.substring(F.format_string("            %s = %s", e["key"], F.coalesce(e["value"], F.lit("null"))), 1, width))
    lines = F.concat(heading, F.array(said), F.coalesce(more, F.array().cast("array<string>")))
    told = kept.select("trace", "_place", F.posexplode(lines).alias("_line", "line"))
    context = F.transform(F.array_sort(F.map_entries("context")), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null"))))
    head = F.array_compact(F.array(F.concat(F.lit("trace "), "trace", F.lit("  ·  "), F.coalesce("subject", F.lit(""))), F.when(F.size(context) > 0, F.concat(F.lit("  "), F.array_join(context, "  ")))))
    heads = traces.select("trace", F.lit(0).alias("_place"), F.posexplode(head).alias("_line", "line"))
    number = F.row_number().over(Window.partitionBy("trace").orderBy("_place", "_line"))
    return heads.unionByName(told).select("trace", number.alias("line_no"), "line")


def line_differences(before: DataFrame, after: DataFrame, key: str, context: int = 2) -> DataFrame:
    """key, seq and line: what changed between two ordered texts, as unified hunks.

    Both sides have key, name, line_no and line.  Sides are paired by key; a key of one
    side only is compared with no lines.  Keys whose lines are all equal give no rows.
    Only keys with a line that differs at its number reach Python, one text pair at a
    time; memory follows the longest pair.
    """
    a, b = (side.select(F.col(key).cast("string").alias("_key"), "name", "line_no", "line", F.lit(s).alias("_side")) for s, side in enumerate((before, after)))
    both = a.unionByName(b)
    # a line that stands on both sides at one number counts twice, and no other does
    odd = both.groupBy("_key", "line_no").agg((F.count(F.lit(1)) != 2).alias("_n"), (F.count_distinct(F.coalesce("line", F.lit(""))) > 1).alias("_d"), (F.min("_side") == F.max("_side")).alias("_s"))
    changed = odd.filter("_n OR _d OR _s").select("_key").distinct()

    def hunks(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_side", "line_no"], kind="stable")
        sides = [group[group["_side"] == s] for s in (0, 1)]
        texts = [["" if x is None else x for x in s["line"].tolist()] for s in sides]
        names = [s["name"].iloc[0] if len(s) and s["name"].iloc[0] is not None else "" for s in sides]
        lines = list(difflib.unified_diff(*texts, *names, lineterm="", n=context))
        return pd.DataFrame({key: [group["_key"].iloc[0]] * len(lines), "seq": range(len(lines)), "line": lines})

    return both.join(changed, "_key", "left_semi").groupBy("_key").applyInPandas(hunks, f"`{key}` string, seq int, line string")
