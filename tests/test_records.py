"""Traces, their store, payload contracts and keyed changes against plain Python and stated cases."""

import difflib
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kinelake.functions.lineage import shared_folder
from kinelake.operators import contracts, keyed, traces
from kinelake.sources import traces as store

ENTRY = "trace string, seq int, stage string, kind string, at_ms int, message string, data map<string,string>"
NOW = "2024-02-01 00:00:00"


def test_rendering_with_headings_marks_and_data(spark):
    rows = [("t", 1, "a", "step", 5, "begin", None), ("t", 2, "a", "decision", 10, "x" * 200, {"what": "no", "k": "1", "z": None}), ("t", 3, "b", "error", 123456, None, None), ("t", 4, None, "sentinel", 7, "s", {})]
    heads = spark.createDataFrame([("t", "clip", {"a": "1", "b": None}), ("u", None, None)], "trace string, subject string, context map<string,string>")
    got = {}
    for r in traces.rendered(spark.createDataFrame(rows, ENTRY), heads).orderBy("trace", "line_no").collect():
        got.setdefault(r["trace"], []).append(r["line"])
    assert got["u"] == ["trace u  ·  "]
    assert got["t"] == ["trace t  ·  clip", "  a=1  b=null", "", "[a]", "     5ms    begin", (f"    10ms -> {'x' * 200}")[:96], "            k = 1", "            z = null", "", "[b]", " 123456ms  ! ", "", "[]", "     7ms    s"]
    problems = traces.rendered(spark.createDataFrame(rows, ENTRY), heads, show="problems").filter("trace = 't'").orderBy("line_no")
    assert [r["line"] for r in problems.collect()][2:] == ["", "[b]", " 123456ms  ! "]


def test_counts_of_empty_and_unknown_kinds(spark):
    rows = [("t", 1, "a", "step", 5, "m", None), ("t", 2, "a", "other", None, "m", None), (None, 1, None, None, 9, None, None)]
    got = {r["trace"]: (r["step"], r["error"], r["duration_ms"]) for r in traces.trace_counts(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == {"t": (1, 0, None), None: (0, 0, 9)}
    assert traces.trace_counts(spark.createDataFrame([], ENTRY)).count() == 0


def test_differences_equal_a_plain_comparison(spark):
    draw = random.Random(3)
    pairs = {"same": (["a", "b"], ["a", "b"]), "gone": (["a"], []), "new": ([], ["b", ""]), "tail": (["a"] * 9, ["a"] * 9 + ["b"])}
    for i in range(30):
        a = [draw.choice("abcd") for _ in range(draw.randint(0, 40))]
        b = [x if draw.random() < 0.9 else draw.choice("abcde") for x in a if draw.random() < 0.95]
        pairs[f"p{i}"] = (a, b)
    side = lambda s: spark.createDataFrame([(k, f"n{s}", n, x) for k, v in pairs.items() for n, x in enumerate(v[s])], "k string, name string, line_no int, line string")
    got = {}
    for r in traces.line_differences(side(0), side(1), "k").orderBy("k", "seq").collect():
        got.setdefault(r["k"], []).append(r["line"])
    want = {k: list(difflib.unified_diff(a, b, "n0" if a else "", "n1" if b else "", lineterm="", n=2)) for k, (a, b) in pairs.items()}
    assert got == {k: v for k, v in want.items() if v}


def test_store_appends_expires_and_prunes(spark):
    path = shared_folder(spark, "traces")
    at = datetime(2024, 1, 10)
    columns = "trace_id string, job_id string, kind string, status string, created_at timestamp, payload string"
    rows = [("a", "", "run", "ok", at, "x" * 400_000), ("b", "j", "run", "bad", at, "p"), ("old", "j", "run", "ok", datetime(2023, 10, 1), "p"), (None, "j", "run", "ok", at, "p"), ("c", "j", "run", "ok", None, None)]
    store.put(spark.createDataFrame(rows, columns), path)
    store.put(spark.createDataFrame([("b", "j", "run", "ok", datetime(2024, 1, 11), "q")], columns), path)
    store.put_failures(spark.createDataFrame([("j9", "pose", "e", at), (None, "pose", "e", at)], "job_id string, stage string, error string, at timestamp"), path)
    kept = store.kept(spark, path, F.lit(NOW).cast("timestamp"))
    assert sorted((r["trace_id"], r["job_id"], len(r["payload"])) for r in kept.collect())[0] == ("a", "a", 350_000)
    assert sorted(r["trace_id"] for r in kept.collect()) == ["a", "b", "b", "failure:j9"]
    assert sorted((r["trace_id"] or "", r["error"]) for r in store.dead_letters(spark, path).collect()) == [("", "no trace_id"), ("", "no trace_id"), ("c", "no created_at, no payload")]
    one = store.by_id(spark, path, "b", F.lit(NOW).cast("timestamp"))
    assert [r["payload"] for r in one.collect()] == ["q"]
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(trace_id,b)" in plan and "PartitionFilters: [isnotnull(state" in plan and "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert store.by_id(spark, path, "zzz", F.lit(NOW).cast("timestamp")).count() == 0
    assert [r["payload"] for r in store.found(kept, status="bad", kind=None).collect()] == ["p"]
    assert [r["trace_id"] for r in store.listing(kept, 2).collect()] == ["b", "a"]


def test_payload_rules(spark):
    whole = {k: None for k in contracts.REQUIRED} | {"measurementVersion": 2, "sessionBand": "unmeasured", "n_reps": 1, "n_candidates": 0, "reps": [], "blockers": []}
    rep = {k: None for k in contracts.REP_REQUIRED}
    docs = {
        "fine": whole,
        "empty": {},
        "version": whole | {"measurementVersion": 1},
        "score": whole | {"sessionScore": 101, "sessionBand": "strong"},
        "word": whole | {"sessionScore": "x"},
        "negative": whole | {"n_reps": -1},
        "zero": whole | {"n_reps": 0},
        "told": whole | {"n_reps": 0, "blockers": ["Error: none", "why"]},
        "left": whole | {"i18n": {"untranslated": ["x"]}},
        "reps": whole | {"duration_s": 2, "reps": [rep, rep | {"score": -1}, {}, rep | {"startS": -1, "turnS": 3, "endS": 2.6}]},
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("null", None), ("list", "[1]")]
    got = {}
    for r in contracts.payload(spark.createDataFrame(rows, "k string, doc string"), "k", "doc", 2).collect():
        got.setdefault(r["key"], []).append(r["rule"])
    assert {k: sorted(v) for k, v in got.items()} == {
        "empty": ["required_keys"],
        "null": ["required_keys"],
        "list": ["required_keys"],
        "version": ["measurement_version"],
        "score": ["session_score_in_range"],
        "word": ["session_score_in_range"],
        "negative": ["n_reps_non_negative"],
        "zero": ["zero_reps_has_blocker"],
        "told": ["no_developer_text"],
        "left": ["untranslated_text"],
        "reps": ["rep_required_keys", "rep_score_in_range", "rep_times_inside_clip", "rep_times_ordered"],
    }


def test_updates_of_unknown_columns_are_errors(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "id int, name string, n int")
    changes = spark.createDataFrame([(1, None), (3, "z"), (None, "y")], "id int, name string")
    assert sorted(keyed.updated(rows, "id", changes, ["name"]).collect(), key=lambda r: r["n"]) == [(1, None, 5), (2, "b", 6), (None, "c", 7)]
    with pytest.raises(ValueError, match="name"):
        keyed.updated(rows, "id", changes, ["n"])
    kept = keyed.forgotten([rows, rows.select("n", "id")], "id", spark.createDataFrame([(2,), (2,), (None,)], "id int"))
    assert [sorted(r["n"] for r in t.collect()) for t in kept] == [[5, 7], [5, 7]]


def test_locks_keep_their_first_values(spark):
    fields = ["f", "p"]
    shape = "k string, f string, p double"
    none = spark.createDataFrame([], shape)
    first = spark.createDataFrame([("a", "x", 1.0), ("b", None, 2.0)], shape)
    assert {(r["k"], r["first_run"], r["changed_since_lock"]) for r in keyed.against_locks(first, none, "k", fields).collect()} == {("a", True, False), ("b", True, False)}
    locks = keyed.locked(first, none, "k", fields)
    later = spark.createDataFrame([("a", "x", 3.0), ("b", None, 2.0), ("c", "n", 0.0)], shape)
    assert {(r["k"], r["first_run"], r["changed_since_lock"]) for r in keyed.against_locks(later, locks, "k", fields).collect()} == {("a", False, True), ("b", False, False), ("c", True, False)}
    assert sorted(r["k"] + str(r["p"]) for r in keyed.locked(later, locks, "k", fields).collect()) == ["a1.0", "b2.0", "c0.0"]
