"""Registered queries of messages, nested documents and subject choice, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import documents, messages, subjects
from kinelake.plans.catalogue import _FRAMES, frames, query
from kinelake.sources.tables import table

#: A catalogue over the events: the first template that matches a text counts.
TEMPLATES = [
    ("seen", "user {u} did {what*}", "usuario {u} hizo {what*}"),
    ("left", "User {u} left {what*}", "usuario {u} dejó {what*}"),
    ("share", "{p} of the {what*} events failed", "falló el {p} de los eventos de {what*}"),
    ("because", "no score because {why*}", "sin nota porque {why*}"),
    ("pair", "{a*}, and {b*}", "{b*} y {a*}"),
    ("few", "Only {n} of {m} frames", "Solo {n} de {m} fotogramas"),
]
NAMES = [("purchase", "compra"), ("error", "fallo")]

_SAID = """s AS (SELECT event_id, CAST(user_id AS VARCHAR) AS u, event_type AS t, json_extract_string(props, '$.k') AS k FROM events),
    e AS (SELECT *, CASE t WHEN 'purchase' THEN 'compra' WHEN 'error' THEN 'fallo' ELSE t END AS es, t IN ('purchase', 'error') AS known FROM s)"""


def said(spark, sf_dir):
    """events as parts of texts: event_id, u, t and k."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("u"), F.col("event_type").alias("t"), F.get_json_object("props", "$.k").alias("k"))


def joined(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.col(p) if len(p) == 1 else F.lit(p) for p in parts])


@query(f"""WITH {_SAID} SELECT event_id,
    CASE event_id % 6 WHEN 0 THEN 'seen' WHEN 1 THEN 'share' WHEN 2 THEN 'left' WHEN 3 THEN 'because' END AS code,
    CASE event_id % 6 WHEN 0 THEN 'usuario ' || u || ' hizo ' || es WHEN 1 THEN 'falló el ' || k || ',5 % de los eventos de ' || es || '.' WHEN 2 THEN 'Usuario ' || u || ' dejó ' || es
        WHEN 3 THEN 'sin nota porque usuario ' || u || ' hizo Solo ' || k || ' de 100 fotogramas y ' || es WHEN 4 THEN es ELSE 'zzz ' || t END AS out,
    CASE WHEN event_id % 6 = 5 THEN 'zzz ' || t WHEN known THEN '' ELSE t END AS missing FROM e""")
def translated_messages(spark, sf_dir):
    kind = F.col("event_id") % 6
    forms = [joined("user ", "u", " did ", "t"), joined("k", ".5% of the ", "t", " events failed."), joined("User ", "u", " left ", "t"), joined("no score because user ", "u", " did ", "t", ", and Only ", "k", " of 100 frames"), F.col("t"), joined("zzz ", "t")]
    rows = said(spark, sf_dir).select("event_id", F.element_at(F.array(*forms), kind.cast("int") + 1).alias("text"))
    told = messages.localised_texts(rows, TEMPLATES, NAMES, NAMES)
    return rows.join(told, "text", "left").select("event_id", "code", "out", F.array_join("missing", "|").alias("missing"))


@query(f"""WITH {_SAID} SELECT event_id, '{{"blockers":["Falló el ' || k || ',5 % de los eventos de ' || es || '"],"headline":"usuario ' || u || ' hizo ' || es || '","k":' || k || ',"reps":[{{"problems":["zzz ' || t || '","' || es || '"],"total_s":"' || k || ',25 s"}}],"i18n":{{"locale":"es","untranslated":['
    || CASE WHEN known THEN '' ELSE '"' || t || '",' END || '"zzz ' || t || '"]}}}}' AS doc FROM e""")
def localised_payloads(spark, sf_dir):
    doc = joined('{"k":', "k", ',"headline":"user ', "u", " did ", "t", '","reps":[{"problems":["zzz ', "t", '","', "t", '"],"total_s":"', "k", '.25 s"}],"blockers":["', "k", ".5% of the ", "t", ' events failed"]}')
    docs = said(spark, sf_dir).select("event_id", doc.alias("doc"))
    texts = docs.select(F.explode(documents.texts_at(F.col("doc"), documents.PROSE)).alias("text"))
    return documents.localised(docs, "event_id", "doc", messages.localised_texts(texts, TEMPLATES, NAMES, NAMES))


@query("""WITH o AS (SELECT o_custkey AS c, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)
    SELECT c, '{"deep":{"a":{"b":{"type":"dict","keys":1}}},"id":' || CAST(c AS VARCHAR) || ',"orders":' || CASE WHEN len(l) > 12 THEN '{"type":"list","len":' || CAST(len(l) AS VARCHAR) || ',"head":[' || array_to_string(l[1:3], ',') || ']}' ELSE '[' || array_to_string(l, ',') || ']' END || '}' AS picture FROM o""")
def document_pictures(spark, sf_dir):
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(keys.alias("l"))
    doc = F.concat(F.lit('{" id ":'), F.col("c").cast("string"), F.lit(',"deep":{"a":{"b":{"c":1}}},"orders":['), F.col("l"), F.lit("]}"))
    return docs.select("c", documents.summarised(documents.stripped_keys(doc)).alias("picture"))


@query("""SELECT event_id, '{"value":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE CAST(value AS VARCHAR) END || ',"parts":[' || CAST(value AS VARCHAR) || ',null],"by":{"' || CAST(user_id AS VARCHAR) || '":null}}' AS doc FROM events""")
def safe_documents(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = e.select("event_id", value.alias("value"), F.array("value", F.lit(float("inf"))).alias("parts"), F.create_map("user_id", F.lit(float("-inf"))).alias("by"))
    return rows.select("event_id", documents.as_json(rows, "value", "parts", "by").alias("doc"))


@query(f"""WITH RECURSIVE b AS (SELECT user_id AS clip, (frame - 1) // 2 AS frame, event_type AS track, value AS area FROM {_FRAMES}),
    g AS (SELECT clip, frame, list(DISTINCT track) AS tracks, arg_min(track, struct_pack(a := -area, b := track)) AS largest FROM b GROUP BY 1, 2),
    w AS (SELECT clip, frame, largest AS shown, largest AS followed, 0 AS away FROM g WHERE frame = 0
        UNION ALL SELECT g.clip, g.frame, CASE WHEN list_contains(tracks, followed) THEN followed ELSE largest END,
            CASE WHEN list_contains(tracks, followed) OR away < 2 THEN followed ELSE largest END, CASE WHEN NOT list_contains(tracks, followed) AND away < 2 THEN away + 1 ELSE 0 END
        FROM w JOIN g ON g.clip = w.clip AND g.frame = w.frame + 1)
    SELECT * FROM w""")
def followed_subjects(spark, sf_dir):
    boxes = frames(spark, sf_dir).select(F.col("user_id").alias("clip"), F.floor((F.col("frame") - 1) / 2).cast("long").alias("frame"), F.col("event_type").alias("track"), F.col("value").alias("area"))
    return subjects.subjects(boxes, "clip", gap=2)
