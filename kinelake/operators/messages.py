"""Messages translated through a catalogue of templates.

A template has a code, a source and a target text with holes: {name} is a number,
{name*} a text that is translated itself.  Templates are found through an index: each
has one word of its literal parts, the rarest over the catalogue, and a text meets
only the templates of its own words.  Each different text is translated once.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.lineage import cut
from kinelake.functions.text import label
from kinelake.operators.relational import small

#: A hole, a number, and the letters of an index word.
HOLE = re.compile(r"\{(\w+)(\*?)\}")
NUMBER = r"-?\d+(?:\.\d+)?%?"
WORD = r"[A-Za-z]+"

TEMPLATE_COLUMNS = "place int, code string, pattern string, is_text array<boolean>, parts array<struct<literal:string,hole:int>>, anchor string, low boolean"
FOUND_COLUMNS = "text string, code string, out string, missing array<string>, params array<string>"


def literal_words(source: str) -> list[str]:
    """Words of the literal parts that no hole can lengthen."""
    out, at = [], 0
    holes = [m.span() for m in HOLE.finditer(source)]
    for start, end in [*holes, (len(source), len(source))]:
        chunk = source[at:start]
        for m in re.finditer(WORD, chunk):
            grows = (m.start() == 0 and at > 0) or (m.end() == len(chunk) and start < len(source))
            if not grows:
                out.append(m.group())
        at = end
    return out


def compiled(spark: SparkSession, templates: list[tuple[str, str, str]]) -> DataFrame:
    """The catalogue as a table: pattern, kinds of the holes, parts of the target and index word.

    Templates keep their order, as the first that matches counts.  A source without a
    literal character, or a target with a hole that the source lacks, is an error.
    """
    words = [set(literal_words(source)) for _, source, _ in templates]
    held = Counter(w for ws in words for w in ws)
    rows = []
    for place, ((code, source, target), own) in enumerate(zip(templates, words, strict=True)):
        holes = [(m.group(1), m.group(2) == "*") for m in HOLE.finditer(source)]
        if not HOLE.sub("", source).strip():
            raise ValueError(f"{code}: the source is all holes")
        pieces = HOLE.split(source)
        pattern = "".join(re.escape(p) if i % 3 == 0 else "" if i % 3 == 2 else "(.+?)" if pieces[i + 1] else f"({NUMBER})" for i, p in enumerate(pieces))
        number = {name: i for i, (name, _) in enumerate(holes)}
        if len(number) < len(holes):
            raise ValueError(f"{code}: a hole is named twice")
        parts = []
        at = 0
        for m in HOLE.finditer(target):
            if m.group(1) not in number:
                raise ValueError(f"{code}: {{{m.group(1)}}} is not in the source")
            parts.append((target[at : m.start()], number[m.group(1)]))
            at = m.end()
        parts.append((target[at:], -1))
        anchor = min(own, key=lambda w: (held[w], -len(w), w), default="")
        rows.append((place, code, rf"(?s)\A{pattern}\z", [t for _, t in holes], parts, anchor, target[:1].islower()))
    return spark.createDataFrame(rows, TEMPLATE_COLUMNS)


def number_text(x: Column) -> Column:
    """A number with a decimal comma, and a space before its percent sign."""
    return F.replace(F.replace(x, F.lit("."), F.lit(",")), F.lit("%"), F.lit(" %"))


def matched(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """text with the first template that matches it whole, without a last full stop if need be, and its params.

    Texts that no template matches have no row.
    """
    body = F.trim("text")
    without = F.when(F.endswith(body, F.lit(".")), F.left(body, F.length(body) - 1))
    tries = texts.select("text", F.posexplode(F.filter(F.array(body, without), lambda x: x.isNotNull())).alias("_try", "_body"))
    words = F.array_append(F.array_distinct(F.regexp_extract_all("_body", F.lit(f"({WORD})"), F.lit(1))), F.lit(""))
    met = tries.select("*", F.explode(words).alias("anchor")).join(small(templates), "anchor")
    met = met.filter(F.rlike("_body", F.col("pattern")))
    best = F.min_by(F.struct("_body", "_try", "code", "pattern", "is_text", "parts", "low"), F.struct("_try", "place"))
    rows = met.groupBy("text").agg(best.alias("_m")).select("text", "_m.*")
    holes = F.size("is_text")
    group = lambda i: F.call_function("regexp_extract", F.col("_body"), F.col("pattern"), i)
    params = F.when(holes > 0, F.transform(F.sequence(F.lit(1), F.greatest(holes, F.lit(1))), group)).otherwise(F.array().cast("array<string>"))
    return rows.select("text", "code", "is_text", "parts", "low", (F.col("_try") == 1).alias("_stop"), params.alias("params"))


def _case(out: Column) -> Column:
    """out with the case of the text's first letter, as far as a template may change it."""
    first = lambda x: F.left(x, F.lit(1))
    upper = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    lower = lambda x: (F.lower(x) == x) & (F.upper(x) != x)
    a, b, rest = first(F.trim("text")), first(out), F.substring(out, 2, 1 << 30)
    return F.when(upper(a) & lower(b), F.concat(F.upper(b), rest)).when(lower(a) & upper(b) & F.col("low"), F.concat(F.lower(b), rest)).otherwise(out)


def _filled(found: DataFrame, told: DataFrame | None) -> DataFrame:
    """found with the holes of its targets filled; told has _piece, out and missing of text holes."""
    holes = found.select("text", "is_text", F.posexplode("params").alias("_i", "_raw")).withColumn("_piece", F.when(F.get("is_text", F.col("_i")), F.trim("_raw")))
    if told is None:
        holes = holes.select("text", "_i", number_text(F.col("_raw")).alias("_out"), F.array().cast("array<string>").alias("_missing"))
    else:
        holes = holes.join(told, "_piece", "left").select("text", "_i", F.when(F.col("_piece").isNull(), number_text(F.col("_raw"))).otherwise(F.col("out")).alias("_out"), F.coalesce("missing", F.array().cast("array<string>")).alias("_missing"))
    filled = holes.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("_i", "_out", "_missing"))).alias("_holes"))
    rows = found.join(filled, "text", "left")
    out = F.array_join(F.transform("parts", lambda p: F.concat(p["literal"], F.coalesce(F.get("_holes", p["hole"])["_out"], F.lit("")))), "")
    missing = F.coalesce(F.flatten(F.transform("parts", lambda p: F.coalesce(F.get("_holes", p["hole"])["_missing"], F.array().cast("array<string>")))), F.array().cast("array<string>"))
    rows = rows.withColumn("out", F.when(F.col("_stop"), F.concat(out, F.lit("."))).otherwise(out)).withColumn("missing", missing)
    return rows.select("text", "code", _case(F.col("out")).alias("out"), "missing", "params")


def translated(texts: DataFrame, templates: list[tuple[str, str, str]], fragments: list[tuple[str, str]] = ()) -> DataFrame:
    """text, code, out, missing and params of each different text that a template matches.

    fragments: names that stand for a whole text hole.  Other holes are texts for the
    catalogue in their turn; what it doesn't know stays and is listed in missing, in the
    order of the target.  A hole is shorter than its text, so the levels end.  Null and
    blank texts have no row.
    """
    spark = texts.sparkSession
    catalogue = compiled(spark, templates)
    names = spark.createDataFrame(list(fragments), "_piece string, _name string")
    level = texts.select("text").filter(F.trim("text") != "").distinct()
    levels: list[DataFrame] = []
    while True:
        found = cut(matched(level, catalogue))
        levels.append(found)
        pieces = found.select("is_text", F.posexplode("params").alias("_i", "_raw")).filter(F.get("is_text", F.col("_i"))).select(F.trim("_raw").alias("_piece")).distinct()
        level = pieces.join(small(names), "_piece", "left_anti").select(F.col("_piece").alias("text"))
        if level.isEmpty():
            break
    told = None
    for i in range(len(levels) - 1, -1, -1):
        whole = _filled(levels[i], told) if told is not None or i < len(levels) - 1 else _filled(levels[i], _pieces(levels[i], names, None))
        if i == 0:
            return whole
        told = _pieces(levels[i - 1], names, whole)
    raise AssertionError("no level")


def _pieces(found: DataFrame, names: DataFrame, whole: DataFrame | None) -> DataFrame:
    """_piece, out and missing of the text holes of found: a name, a translation, or the piece itself."""
    pieces = found.select("is_text", F.posexplode("params").alias("_i", "_raw")).filter(F.get("is_text", F.col("_i"))).select(F.trim("_raw").alias("_piece")).distinct()
    rows = pieces.join(small(names), "_piece", "left")
    if whole is None:
        rows = rows.withColumns({"_t": F.lit(None).cast("string"), "_m": F.array().cast("array<string>")})
    else:
        rows = rows.join(whole.select(F.col("text").alias("_piece"), F.col("out").alias("_t"), F.col("missing").alias("_m")), "_piece", "left")
    none = F.array().cast("array<string>")
    return rows.select("_piece", F.coalesce("_name", "_t", "_piece").alias("out"), F.when(F.col("_name").isNotNull(), none).when(F.col("_t").isNotNull(), F.col("_m")).otherwise(F.array("_piece")).alias("missing"))


def localised_texts(texts: DataFrame, templates: list[tuple[str, str, str]], names: list[tuple[str, str]] = (), fragments: list[tuple[str, str]] = (), settled: Column | None = None) -> DataFrame:
    """text, code, out and missing of each different text: a known name, a name as its
    label, a template, or the text itself.

    A text that is none of these is missing, unless `settled` (a condition on text, say
    that it is in the target language) holds.  Blank texts stay and are not missing; a
    null text has no row.
    """
    spark = texts.sparkSession
    each = texts.select("text").filter("text IS NOT NULL").distinct()
    known = small(spark.createDataFrame(list(names), "_name string, _known string"))
    found = translated(each, templates, fragments).select("text", "code", "out", "missing")
    rows = each.withColumn("_label", label(F.regexp_replace("text", r"^\.+|\.+$", "")))
    rows = rows.join(known.withColumnRenamed("_name", "text"), "text", "left").join(known.select(F.col("_name").alias("_label"), F.col("_known").alias("_by_label")), "_label", "left").join(found, "text", "left")
    none = F.array().cast("array<string>")
    name = F.coalesce("_known", "_by_label")
    quiet = (F.trim("text") == "") | (F.coalesce(settled, F.lit(False)) if settled is not None else F.lit(False))
    missing = F.when(name.isNotNull() | quiet & F.col("out").isNull(), none).when(F.col("out").isNotNull(), F.col("missing")).otherwise(F.array("text"))
    return rows.select("text", F.when(name.isNull(), F.col("code")).alias("code"), F.coalesce(name, "out", "text").alias("out"), missing.alias("missing"))
