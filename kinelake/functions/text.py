"""String, label and message functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain forms.
ACCENTS, PLAIN = "áéíóúüñ", "aeiouun"


def slug(x: Column, most: int = 60) -> Column:
    """Lower case, runs of other characters as one underscore, at most `most` long."""
    return F.left(F.btrim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), F.lit("_")), F.lit(most))


def file_slug(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "-")


def plain(x: Column) -> Column:
    """Trimmed, in lower case and without accents: the key of name lookups."""
    return F.translate(F.lower(F.trim(x)), ACCENTS, PLAIN)


def label(x: Column) -> Column:
    """Separators collapsed to one space, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(x, r"[\s_-]+", " ")))


def code(x: Column) -> Column:
    """Letters and digits only, in upper case."""
    return F.upper(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def numbers_in(x: Column) -> Column:
    """Every number of a text as double; decimal commas are read as points."""
    found = F.regexp_extract_all(x, F.lit(r"(-?\d+(?:[.,]\d+)?)"), F.lit(1))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))


def words_in(x: Column, words: list[str]) -> Column:
    """The distinct listed words that a text holds, in the list's order."""
    return F.array_intersect(F.array(*[F.lit(w) for w in words]), F.regexp_extract_all(F.lower(x), F.lit(r"([a-z]+)"), F.lit(1)))


def is_clean(x: Column, blocked: list[str]) -> Column:
    """No blocked word in the text; null text is clean."""
    low = F.lower(F.coalesce(x, F.lit("")))
    out = F.lit(True)
    for w in blocked:
        out = out & ~F.contains(low, F.lit(w))
    return out


def relevant(x: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.contains(F.lower(x), k))


def localized_number(x: Column) -> Column:
    """A decimal comma for a decimal point between digits."""
    return F.regexp_replace(x, r"(\d)\.(\d)", "$1,$2")


def verdict(x: Column, words: list[str]) -> Column:
    """The JSON field `verdict`, or the only listed word that a text holds."""
    field = F.lower(F.get_json_object(x, "$.verdict"))
    found = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(rf"\b({'|'.join(words)})\b"), F.lit(1)))
    return F.when(field.isin(*words), field).when(F.size(found) == 1, F.get(found, F.lit(0)))


def first_match(x: Column, table: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first keyword of an ordered table that a text holds."""
    out = None
    for word, value in table:
        hit = F.contains(F.lower(x), F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def starts_with(x: Column, table: list[tuple[str, str]], default: str) -> Column:
    out = None
    for word, value in table:
        hit = F.startswith(x, F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def template(x: Column, templates: list[tuple[str, str]]) -> Column:
    """The code of the first pattern that matches a whole text, and its holes.

    A {num} hole is a number, any other hole a shortest text.
    """
    import re

    out = None
    for name, pattern in templates:
        parts = re.split(r"(\{[^}]*\})", pattern)
        body = "".join(r"(-?[\d.,]+)" if p == "{num}" else "(.+?)" if p.startswith("{") else re.escape(p) for p in parts)
        holes = sum(p.startswith("{") for p in parts)
        full = rf"^{body}\.?$"
        hit = F.rlike(x, F.lit(full))
        params = F.array(*[F.regexp_extract(x, full, i + 1) for i in range(holes)]) if holes else F.array().cast("array<string>")
        value = F.struct(F.lit(name).alias("code"), params.alias("params"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def json_object(x: Column) -> Column:
    """The text from the first { to the last }, if it is one JSON object."""
    body = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.when(F.json_object_keys(body).isNotNull(), body)


def small_count(x: Column, field: str = "count", most: int = 200) -> Column:
    """An integer JSON field from 0 to most; fractions and booleans are refused."""
    raw = F.get_json_object(x, f"$.{field}")
    value = F.when(F.rlike(raw, F.lit(r"^\d+$")), raw.try_cast("int"))
    return F.when(value.between(0, most), value)
