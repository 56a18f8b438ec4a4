"""Nested documents: rewritten along paths, cleaned, summarised and made safe for JSON.

A document is JSON text, read as a variant and rebuilt by one expression of built-in
functions: no shuffle, no Python.  Text that is not one JSON value, or an object that
repeats a key, gives null.  Written objects have their keys in the variant's order (by
name), numbers their shortest form.  A path is dotted, with * for each item of a list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from kinelake.functions.lineage import cut
from kinelake.functions.num import finite
from kinelake.operators.relational import small

#: Fixed values of a summary: longest list and text shown whole, items of a longer list, depth of whole objects.
MOST_ITEMS, MOST_CHARS, HEAD, DEPTH = 12, 200, 3, 3
#: Levels of a document that are looked into; what lies deeper is kept as it is.
LEVELS = 8
#: The fields of a payload that hold prose, and those that hold a measured value.
PROSE = ["headline", "narrative", "nextSession", "blockers.*", "detected.label", "detected.reason", "sessions.*.note", "reps.*.problems.*", "reps.*.scoreNote", "reps.*.metrics.*.name", "reps.*.components.*.why", "reps.*.aside.*.why", "reps.*.penalties.*.why"]
VALUES = ["reps.*.transition_s", "reps.*.total_s", "reps.*.metrics.*.value"]
UNITS = {"torso": "torsos", "s": "s", "x": "x", "deg": "°", "%": "%"}


def parsed(doc: Column) -> Column:
    return F.try_parse_json(doc)


def quoted(x: Column) -> Column:
    """A text as a JSON string; null stays null."""
    inner = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substring(inner, F.lit(2), F.length(inner) - 2))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def json_text(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null"))


def is_object(v: Column) -> Column:
    return v.try_cast("map<string,variant>").isNotNull()


def entries(v: Column) -> Column:
    """key and value of each member of an object, or of each item (without a key) of a list; null for scalars."""
    items = F.transform(v.try_cast("array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(F.map_entries(v.try_cast("map<string,variant>")), items)


def text_of(v: Column) -> Column:
    """The text of a JSON string, null for any other value."""
    return F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string"))


def _member(e: Column, value: Column) -> Column:
    return F.concat(F.when(e["key"].isNull(), F.lit("")).otherwise(F.concat(quoted(e["key"]), F.lit(":"))), value)


def _tree(paths: dict[str, Callable]) -> dict:
    tree: dict = {}
    for path, leaf in paths.items():
        *inner, last = path.split(".")
        node = tree
        for name in inner:
            node = node.setdefault(name, {})
            if not isinstance(node, dict):
                raise ValueError(f"{path} goes through the end of another path")
        if last in node:
            raise ValueError(f"{path} is the start of another path")
        node[last] = leaf
    return tree


def _at(e: Column, name: str) -> Column:
    return e["key"].isNull() if name == "*" else e["key"] == name


def _rewritten(v: Column, node, added: dict, path: str) -> Column:
    if not isinstance(node, dict):
        t = text_of(v)
        return F.coalesce(quoted(node(t)), json_text(v))
    more = added.get(path, {})

    def one(e: Column) -> Column:
        value = json_text(e["value"])
        for name, sub in node.items():
            value = F.when(_at(e, name), _rewritten(e["value"], sub, added, f"{path}.{name}" if path else name)).otherwise(value)
        return _member(e, value)

    extra = {k: f(v) for k, f in more.items()}

    def stays(e: Column) -> Column:
        out = F.lit(True)
        for k, x in extra.items():
            out = out & (x.isNull() | e["key"].isNull() | (e["key"] != k))
        return out

    kept = F.filter(entries(v), stays) if extra else entries(v)
    parts = F.transform(kept, one)
    if extra:
        new = F.array(*[F.concat(quoted(F.lit(k)), F.lit(":"), x) for k, x in extra.items()])
        parts = F.when(is_object(v), F.concat(parts, F.filter(new, lambda x: x.isNotNull()))).otherwise(parts)
    opened, closed = F.when(is_object(v), "{").otherwise("["), F.when(is_object(v), "}").otherwise("]")
    return F.coalesce(F.concat(opened, F.array_join(parts, ","), closed), json_text(v))


def rewritten(doc: Column, paths: dict[str, Callable[[Column], Column]], added: dict[str, dict[str, Callable[[Column], Column]]] | None = None) -> Column:
    """A document whose texts at the paths went through the paths' functions.

    A function gets the text, or null where the value is no text, and is kept out by a
    null.  added: for the path of an object ("" is the document), names of members and
    functions from the object to their JSON text; null adds nothing, and a member of the
    name is replaced.  All else stays.
    """
    tree = _tree(paths)
    for path in added or {}:
        node = tree
        for name in filter(None, path.split(".")):
            node = node.setdefault(name, {})
    return _let(parsed(doc), lambda v: F.when(v.isNotNull(), _rewritten(v, tree, added or {}, "")))


def _texts(v: Column, names: list[str]) -> Column:
    none = F.array().cast("array<string>")
    if not names:
        return F.filter(F.array(text_of(v)), lambda t: t.isNotNull())
    inner = F.transform(F.filter(entries(v), lambda e: _at(e, names[0])), lambda e: _texts(e["value"], names[1:]))
    return F.coalesce(F.flatten(inner), none)


def texts_at(doc: Column, paths: list[str]) -> Column:
    """The texts at the paths, path by path, in the order of the document."""
    return _let(parsed(doc), lambda v: F.flatten(F.array(*[_texts(v, p.split(".")) for p in paths])))


def localized_value(x: Column) -> Column:
    """A measured value with a decimal comma and its unit: "1.2 torso" is "1,2 torsos"; other texts stay."""
    form = r"^(-?\d+(?:\.\d+)?)\s*(s|x|torso|deg|%)?$"
    unit = F.regexp_extract(F.trim(x), form, 2)
    units = F.create_map(*[F.lit(y) for kv in UNITS.items() for y in kv])
    number = F.replace(F.regexp_extract(F.trim(x), form, 1), F.lit("."), F.lit(","))
    return F.when(F.rlike(F.trim(x), F.lit(form)), F.when(unit == "", number).otherwise(F.concat(number, F.lit(" "), F.try_element_at(units, unit)))).otherwise(x)


def localised(docs: DataFrame, key: str, doc: str, translations: DataFrame, locale: str = "es", prose: list[str] = PROSE, values: list[str] = VALUES, labels: dict[str, str] | None = None) -> DataFrame:
    """key and doc: payloads with their prose translated and a member i18n that lists what was not.

    translations has text, out and missing (an array) for different texts; a text
    without a row stays and counts as untranslated.  Each different text of all documents
    is joined once with its document; a document's own texts alone are gathered.
    labels: names of components and the label they get.  A null key is a key like any
    other; rows of one key are one document.  Translating twice changes nothing, if the
    translations keep translated texts.
    """
    translations = cut(translations.select("text", "out", "missing"))  # counted, then joined
    distinct = F.array_distinct(texts_at(F.col(doc), prose))
    asked = docs.select(F.struct(key, doc).alias("_doc"), F.explode(distinct).alias("text"))
    told = asked.join(small(translations), "text", "left")
    told = told.withColumn("missing", F.when(F.col("out").isNull(), F.array("text")).otherwise(F.coalesce("missing", F.array().cast("array<string>"))))
    own = told.groupBy("_doc").agg(F.map_from_entries(F.collect_list(F.struct("text", F.coalesce("out", "text").alias("out")))).alias("_out"), F.map_from_entries(F.collect_list(F.struct("text", "missing"))).alias("_missing"))
    rows = docs.select(key, doc, F.struct(key, doc).alias("_doc")).join(own, "_doc", "left")
    out = lambda t: F.coalesce(F.try_element_at("_out", t), t)
    capital = lambda t: F.when(out(t) != t, F.concat(F.upper(F.left(out(t), F.lit(1))), F.substring(out(t), 2, 1 << 30))).otherwise(t)
    missing = F.array_distinct(F.flatten(F.transform(texts_at(F.col(doc), prose), lambda t: F.coalesce(F.try_element_at("_missing", t), F.array().cast("array<string>")))))
    note = F.concat(F.lit(f'{{"locale":"{locale}","untranslated":'), F.to_json(missing), F.lit("}"))
    paths = {p: capital if p == "blockers.*" else out for p in prose} | {p: localized_value for p in values}
    added = {"": {"i18n": lambda _: note}}
    if labels:
        names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        label = lambda v: quoted(F.try_element_at(names, text_of(F.try_variant_get(v, "$.name", "variant"))))
        added |= {f"reps.*.{g}.*": {"label": label} for g in ("components", "aside", "penalties")}
    return rows.select(key, rewritten(F.col(doc), paths, added).alias(doc))


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _stripped(v: Column, levels: int) -> Column:
    if levels == 0:
        return json_text(v)
    own = F.transform(entries(v), lambda e: F.struct(_trimmed(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(own, lambda e: e["key"])
    later = lambda e, i: F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"])
    last = F.filter(own, lambda e, i: ~F.coalesce(later(e, i), F.lit(False)))
    kept = F.when(is_object(v) & (F.size(F.array_distinct(names)) < F.size(names)), last).otherwise(own)
    parts = F.transform(kept, lambda e: _member(e, _stripped(e["value"], levels - 1)))
    opened, closed = F.when(is_object(v), "{").otherwise("["), F.when(is_object(v), "}").otherwise("]")
    return F.coalesce(F.concat(opened, F.array_join(parts, ","), closed), json_text(v))


def stripped_keys(doc: Column, levels: int = LEVELS) -> Column:
    """A document without white space around its keys; of keys that become one, the last by name stays."""
    return _let(parsed(doc), lambda v: F.when(v.isNotNull(), _stripped(v, levels)))


def _summary(v: Column, depth: int, levels: int) -> Column:
    t = text_of(v)
    leaf = F.when(F.length(t) > MOST_CHARS, quoted(F.concat(F.left(t, F.lit(MOST_CHARS)), F.lit("…")))).otherwise(json_text(v))
    own, thing = entries(v), is_object(v)
    n = F.size(own).cast("string")
    none = F.slice(own, 1, 0)
    deep = depth >= DEPTH
    shown = F.when(thing, none if deep else own).when(F.lit(deep) | (F.size(own) > MOST_ITEMS), none if depth >= levels else F.slice(own, 1, HEAD)).otherwise(own)
    long = F.lit(deep) | (F.size(own) > MOST_ITEMS)
    opened = F.when(thing, F.concat(F.lit('{"type":"dict","keys":'), n) if deep else F.lit("{")).when(long, F.concat(F.lit('{"type":"list","len":'), n, F.lit(',"head":['))).otherwise("[")
    closed = F.when(thing, "}").when(long, "]}").otherwise("]")
    if depth >= levels:
        return F.coalesce(F.concat(opened, closed), leaf)
    parts = F.transform(shown, lambda e: _member(e, _summary(e["value"], depth + 1, levels)))
    return F.coalesce(F.concat(opened, F.array_join(parts, ","), closed), leaf)


def summarised(doc: Column, levels: int = LEVELS) -> Column:
    """A small picture of a document: long lists as length and head, long texts as prefix, deep objects as size.

    The heads of lists are followed for `levels` levels; deeper ones are empty.
    """
    return _let(parsed(doc), lambda v: F.when(v.isNotNull(), _summary(v, 0, levels)))


def json_safe(x: Column, kind: DataType) -> Column:
    """A value whose NaN and infinite numbers, at any depth, are null; keys of maps become texts."""
    if isinstance(kind, (DoubleType, FloatType)):
        return finite(x)
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda y: json_safe(y, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].cast("string").alias("key"), json_safe(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*[json_safe(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return x


def as_json(rows: DataFrame, *columns: str) -> Column:
    """The columns of rows as one JSON object, nulls kept."""
    return F.to_json(F.struct(*[json_safe(F.col(c), rows.schema[c].dataType).alias(c) for c in columns]), {"ignoreNullFields": "false"})
