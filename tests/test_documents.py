"""Messages, nested documents and subject choice against brute force and stated cases."""

import json
import random

from pyspark.sql import functions as F

from kinelake.operators import documents, messages, subjects

TEMPLATES = [
    ("seen", "user {u} did {what*}", "usuario {u} hizo {what*}"),
    ("left", "User {u} left {what*}", "usuario {u} dejó {what*}"),
    ("pair", "{a*}, and {b*}", "{b*} y {a*}"),
    ("all", "{n} of {m}", "{n} de {m}"),
]


def told(spark, *texts, **more):
    rows = messages.localised_texts(spark.createDataFrame([(t,) for t in texts], "text string"), TEMPLATES, **more).collect()
    return {r["text"]: (r["code"], r["out"], r["missing"]) for r in rows}


def test_messages_with_holes_stops_and_cases(spark):
    got = told(spark, "user 2.5 did it", "User 3 left x, and y.", "zzz", "50% of 7.", "", None, "zzz", fragments=[("it", "eso")])
    assert got == {
        "user 2.5 did it": ("seen", "usuario 2,5 hizo eso", []),
        "User 3 left x, and y.": ("left", "Usuario 3 dejó y. y x", ["y.", "x"]),
        "zzz": (None, "zzz", ["zzz"]),
        "50% of 7.": ("all", "50 % de 7.", []),
        "": (None, "", []),
    }


def test_names_labels_and_settled_texts(spark):
    got = told(spark, "FRONT-lever.", "front lever", "hola", names=[("front lever", "Front")], settled=F.col("text") == "hola")
    assert got == {"FRONT-lever.": (None, "Front", []), "front lever": (None, "Front", []), "hola": (None, "hola", [])}


def test_every_template_round_trips(spark):
    texts = [messages.HOLE.sub(lambda m: "word" if m.group(2) else "4", source) for _, source, _ in TEMPLATES]
    want = {t: code for t, (code, _, _) in zip(texts, TEMPLATES, strict=True)}
    assert {t: v[0] for t, v in told(spark, *texts).items()} == want


def test_index_words_are_not_at_holes():
    assert messages.literal_words("a {x}kg of {y*}ing end") == ["a", "of", "end"]


def one(spark, doc, f):
    return spark.createDataFrame([(doc,)], "doc string").select(f(F.col("doc")).alias("x")).first()["x"]


def test_keys_are_stripped_at_every_level(spark):
    doc = '{" a ":1,"a":2,"b":[{"\\tc":null}, [], {}]}'
    assert json.loads(one(spark, doc, documents.stripped_keys)) == {"a": 2, "b": [{"c": None}, [], {}]}
    for bad in ("bad", None, '{"a":1,"a":2}'):
        assert one(spark, bad, documents.stripped_keys) is None


def picture(v, depth=0):
    """Brute force of a summary."""
    if isinstance(v, dict):
        return {"type": "dict", "keys": len(v)} if depth >= 3 else {k: picture(x, depth + 1) for k, x in v.items()}
    if isinstance(v, list):
        return {"type": "list", "len": len(v), "head": [picture(x, depth + 1) for x in v[:3]]} if len(v) > 12 or depth >= 3 else [picture(x, depth + 1) for x in v]
    return v[:200] + "…" if isinstance(v, str) and len(v) > 200 else v


def test_pictures_of_random_documents(spark):
    r = random.Random(4)

    def value(depth):
        kind = r.random()
        if depth and kind < 0.4:
            return {f"k{i}": value(depth - 1) for i in range(r.randint(0, 4))}
        if depth and kind < 0.8:
            return [value(depth - 1) for _ in range(r.choice([0, 2, 14]))]
        return r.choice([None, True, 5, 1.25, "q\"é\n", "x" * 201])

    docs = [value(5) for _ in range(60)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, doc string")
    got = rows.select("i", documents.summarised(F.col("doc")).alias("p")).collect()
    assert {r["i"]: json.loads(r["p"]) for r in got} == {i: picture(d) for i, d in enumerate(docs)}


def test_payloads_are_translated_once_and_keep_the_rest(spark):
    doc = {"headline": "user 1 did it", "k": [1, None], "blockers": ["user 2 did it", "zzz", 3], "reps": [{"total_s": "0.33 s", "metrics": [{"name": "zzz", "value": "1.2 torso"}], "components": [{"name": "c", "why": "w"}]}, 5]}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "bad"), (3, None), (4, "{}"), (None, '{"headline":5}')], "id int, doc string")
    texts = docs.select(F.explode(documents.texts_at(F.col("doc"), documents.PROSE)).alias("text"))
    out = messages.localised_texts(texts, TEMPLATES, fragments=[("it", "eso")])
    again = messages.localised_texts(texts.unionAll(spark.createDataFrame([("Usuario 2 hizo eso",), ("usuario 1 hizo eso",)], "text string")), TEMPLATES, fragments=[("it", "eso")], settled=F.contains("text", F.lit("usuario")) | F.contains("text", F.lit("Usuario")))
    first = documents.localised(docs, "id", "doc", out, labels={"c": "Uno"})
    got = {r["id"]: r["doc"] for r in first.collect()}
    want = {"headline": "usuario 1 hizo eso", "k": [1, None], "blockers": ["Usuario 2 hizo eso", "zzz", 3], "reps": [{"total_s": "0,33 s", "metrics": [{"name": "zzz", "value": "1,2 torsos"}], "components": [{"name": "c", "label": "Uno", "why": "w"}]}, 5], "i18n": {"locale": "es", "untranslated": ["zzz", "w"]}}
    assert json.loads(got[1]) == want
    assert got[2] is None and got[3] is None
    assert json.loads(got[4]) == {"i18n": {"locale": "es", "untranslated": []}}
    assert json.loads(got[None])["headline"] == 5
    second = documents.localised(first, "id", "doc", again, labels={"c": "Uno"})
    assert {r["id"]: r["doc"] for r in second.collect()} == got


def test_json_without_numbers_that_are_none(spark):
    rows = spark.createDataFrame([(float("nan"), [1.5, float("inf")], {3: (float("-inf"), "x")}), (None, None, None)], "a double, b array<double>, c map<int,struct<y:double,z:string>>")
    got = [json.loads(r[0]) for r in rows.select(documents.as_json(rows, "a", "b", "c")).collect()]
    assert got == [{"a": None, "b": [1.5, None], "c": {"3": {"y": None, "z": "x"}}}, {"a": None, "b": None, "c": None}]


def test_subject_is_kept_over_short_gaps(spark):
    r = random.Random(7)
    boxes = [(c, f, t, float(r.randint(0, 5))) for c in (1, 2, 3) for f in range(60) for t in range(4) if r.random() < 0.2]
    want = {}
    for c in (1, 2, 3):
        chosen, away = None, 0
        for f in range(60):
            here = sorted((-a, t) for k, g, t, a in boxes if (k, g) == (c, f))
            if not here:
                continue
            ids = [t for _, t in here]
            if chosen in ids:
                shown, away = chosen, 0
            elif chosen is not None and away < 6:
                shown, away = ids[0], away + 1
            else:
                shown = chosen = ids[0]
                away = 0
            want[c, f] = (shown, chosen, away)
    rows = spark.createDataFrame([*boxes, (1, 3, None, 9.0), (1, None, 2, 9.0)], "clip int, frame int, track int, area double")
    got = {(x["clip"], x["frame"]): (x["shown"], x["followed"], x["away"]) for x in subjects.subjects(rows, "clip").collect()}
    assert got == want
    assert subjects.subjects(rows.limit(0), "clip").count() == 0
