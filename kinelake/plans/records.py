"""Registered queries of traces, their store, payload contracts and keyed changes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions.lineage import shared_folder
from kinelake.operators import contracts, keyed, traces
from kinelake.plans.catalogue import _FRAMES, frames, query
from kinelake.sources import traces as store
from kinelake.sources.tables import table

_KIND = "CASE frame % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'step' WHEN 2 THEN 'reject' WHEN 3 THEN 'note' ELSE 'error' END"
_MARK = "CASE frame % 5 WHEN 0 THEN '->' WHEN 2 THEN ' x' WHEN 4 THEN ' !' ELSE '  ' END"


def entries(spark, sf_dir, changed=False):
    """The events of a user as the entries of a trace; changed: a run with other messages here and there."""
    f = F.col("frame")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("decision", "step", "reject", "note", "error")]), (f % 5 + 1).cast("int"))
    said = F.when((f % 17 == 0) & (F.col("user_id") % 2 == 0), F.lit("other")).otherwise(F.col("event_type")) if changed else F.col("event_type")
    data = F.when(f % 4 == 0, F.create_map(F.lit("what"), F.lit("told"), F.lit("frame"), f.cast("string")))
    return frames(spark, sf_dir).select(F.col("user_id").cast("string").alias("trace"), f.alias("seq"), F.floor(f / 10).cast("string").alias("stage"), kind.alias("kind"), (f * 7).alias("at_ms"), said.alias("message"), data.alias("data"))


def heads(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("trace")).distinct()
    return users.select("trace", F.concat(F.lit("user "), "trace").alias("subject"), F.create_map(F.lit("k"), F.col("trace")).alias("context"))


@query(f"""SELECT CAST(user_id AS VARCHAR) AS trace, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("step", "decision", "reject", "note", "error", "sentinel"))}, max(frame) * 7 AS duration_ms
    FROM (SELECT *, {_KIND} AS kind FROM {_FRAMES}) GROUP BY 1""")
def trace_counts(spark, sf_dir):
    return traces.trace_counts(entries(spark, sf_dir))


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS trace, frame, frame // 10 AS stage, {_MARK} AS mark, event_type AS m FROM {_FRAMES} WHERE frame % 5 IN (0, 2, 4)),
    s AS (SELECT *, coalesce(stage <> lag(stage) OVER (PARTITION BY trace ORDER BY frame), true) AS fresh FROM e),
    l AS (SELECT trace, frame, unnest([CASE WHEN fresh THEN '' END, CASE WHEN fresh THEN '[' || stage || ']' END, ' ' || format('{{:>5}}', frame * 7) || 'ms ' || mark || ' ' || m, CASE WHEN frame % 4 = 0 THEN '            frame = ' || frame END]) AS line, generate_subscripts([1, 2, 3, 4], 1) AS i FROM s
        UNION ALL SELECT DISTINCT trace, 0, unnest(['trace ' || trace || '  ·  user ' || trace, '  k=' || trace]), unnest([1, 2]) FROM (SELECT CAST(user_id AS VARCHAR) AS trace FROM events))
    SELECT trace, CAST(row_number() OVER (PARTITION BY trace ORDER BY frame, i) AS INTEGER) AS line_no, line FROM l WHERE line IS NOT NULL""")
def rendered_traces(spark, sf_dir):
    return traces.rendered(entries(spark, sf_dir), heads(spark, sf_dir), show="decisions")


@query()
def trace_differences(spark, sf_dir):
    """What a changed run says otherwise, as unified hunks: no SQL, tested against a plain comparison."""
    runs = [traces.rendered(entries(spark, sf_dir, changed), heads(spark, sf_dir)).withColumn("name", F.lit(name)) for changed, name in ((False, "before"), (True, "after"))]
    return traces.line_differences(*runs, key="trace")


def stored(spark, sf_dir):
    """The path of a store with a trace a day of each user, and a failure for each user's errors of a week."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    user = F.col("user_id").cast("string")
    days = e.groupBy(user.alias("u"), F.date_trunc("day", "ts").alias("day")).agg(F.max("ts").alias("created_at"), F.count(F.lit(1)).alias("n"))
    payload = F.when(F.col("n") > 1, F.concat(F.lit('{"events":'), F.col("n").cast("string"), F.lit("}")))
    rows = days.select(F.concat_ws("-", "u", F.date_format("day", "yyyyMMdd")).alias("trace_id"), F.col("u").alias("job_id"), F.lit("run").alias("kind"), F.when(F.col("n") > 2, "busy").otherwise("quiet").alias("status"), "created_at", payload.alias("payload"))
    path = shared_folder(spark, "traces")
    store.put(rows, path)
    failures = e.filter("event_type = 'error'").groupBy(user.alias("job_id")).agg(F.max("ts").alias("at")).select("job_id", F.lit("pose").alias("stage"), F.lit("no frames").alias("error"), "at")
    store.put_failures(failures, path)
    return path


_STORED = """d AS (SELECT CAST(user_id AS VARCHAR) AS u, strftime(ts, '%Y%m%d') AS day, max(ts) AS created_at, count(*) AS n FROM events GROUP BY 1, 2),
    r AS (SELECT u || '-' || day AS trace_id, u AS job_id, 'run' AS kind, CASE WHEN n > 2 THEN 'busy' ELSE 'quiet' END AS status, created_at, CASE WHEN n > 1 THEN '{"events":' || n || '}' END AS payload FROM d
        UNION ALL SELECT 'failure:' || user_id, CAST(user_id AS VARCHAR), 'worker-failure', 'failed', max(ts), '{"job_id":"' || user_id || '","stage":"pose","error":"no frames","kind":"worker-failure"}' FROM events WHERE event_type = 'error' GROUP BY user_id)"""
_NOW = "2024-04-10 00:00:00"


@query(f"""WITH {_STORED} SELECT trace_id, job_id, kind, status, created_at, created_at + INTERVAL 90 DAY AS expires_at, payload FROM r WHERE payload IS NOT NULL AND created_at + INTERVAL 90 DAY > TIMESTAMP '{_NOW}'""")
def stored_traces(spark, sf_dir):
    return store.kept(spark, stored(spark, sf_dir), F.lit(_NOW).cast("timestamp")).drop("bucket")


@query(f"""WITH {_STORED} SELECT trace_id, job_id, kind, status, created_at, length(payload) AS chars FROM r WHERE payload IS NOT NULL AND created_at + INTERVAL 90 DAY > TIMESTAMP '{_NOW}' ORDER BY created_at DESC, trace_id LIMIT 60""")
def trace_listing(spark, sf_dir):
    return store.listing(store.kept(spark, stored(spark, sf_dir), F.lit(_NOW).cast("timestamp")))


@query(f"WITH {_STORED} SELECT trace_id, job_id, created_at, 'no payload' AS error FROM r WHERE payload IS NULL")
def trace_dead_letters(spark, sf_dir):
    return store.dead_letters(spark, stored(spark, sf_dir)).select("trace_id", "job_id", "created_at", "error")


def payloads(spark, sf_dir):
    """orders as payloads with one or two repetitions, some of them faulty."""
    k = F.col("o_orderkey")
    score = (k % 110).cast("string")
    band = F.when(k % 110 >= 73, "strong").when(k % 110 >= 47, "solid").when(k % 110 >= 20, "shaky").otherwise("broken down")
    rep = {name: "null" for name in contracts.REP_REQUIRED} | {"startS": "1.0", "turnS": "2.0", "endS": "3.0", "problems": '["Traceback here"]'}
    whole = "{" + ",".join(f'"{name}":{value}' for name, value in rep.items()) + "}"
    late, unordered, short = whole.replace('"endS":3.0', '"endS":9.0'), whole.replace('"turnS":2.0', '"turnS":4.0').replace("Traceback here", "deep"), '{"session":1}'
    reps = F.when(k % 4 == 0, f"[{whole}]").when(k % 4 == 1, f"[{late},{short}]").when(k % 4 == 2, f"[{unordered}]").otherwise("[]")
    fixed = "".join(f',"{name}":null' for name in ("narrative", "nextSession", "exercise", "detected", "trim", "session", "fps", "sessions", "topFixes"))
    doc = F.concat(F.lit('{"headline":"h","duration_s":5,"measurementVersion":2,"n_candidates":3,"n_reps":'), (k % 5).cast("string"), F.lit(',"sessionScore":'), score, F.lit(',"sessionBand":"'), band, F.lit('","reps":'), reps, F.lit(fixed), F.when(k % 3 == 0, "").otherwise(',"blockers":[]'), F.lit("}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT CAST(k AS VARCHAR) AS key, rule, count(*) AS n FROM (SELECT k, unnest(list_concat(
    [CASE WHEN k % 3 = 0 THEN 'required_keys' END, CASE WHEN k % 110 > 100 THEN 'session_score_in_range' END, CASE WHEN k % 5 > 3 THEN 'n_reps_le_candidates' END, CASE WHEN k % 5 = 0 THEN 'zero_reps_has_blocker' END],
    CASE k % 4 WHEN 0 THEN ['no_developer_text'] WHEN 1 THEN ['rep_times_inside_clip', 'rep_required_keys', 'no_developer_text'] WHEN 2 THEN ['rep_times_ordered'] ELSE [] END)) AS rule FROM o) WHERE rule IS NOT NULL GROUP BY 1, 2""")
def payload_contract(spark, sf_dir):
    return contracts.payload(payloads(spark, sf_dir), "o_orderkey", "doc", version=2).groupBy("key", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT 'm' || s_suppkey || '.a' AS id FROM supplier UNION ALL SELECT 'm' || s_suppkey || '.b' FROM supplier WHERE s_suppkey % 2 = 0), m AS (SELECT DISTINCT 'm' || s_suppkey AS id FROM supplier),
    c AS (SELECT 'm' || p_partkey AS id, p_partkey % 3 <> 0 AS measurable, p_size % 2 = 0 AS weighted, CASE WHEN p_size % 4 = 0 THEN 'm' || (p_partkey * 2) END AS base, ['m' || p_partkey || '.a', 'm' || p_partkey || '.b', 'm' || (p_partkey + p_size % 2) || '.a', 'free'] AS rules, 4 + p_partkey % 2 AS n FROM part),
    u AS (SELECT id, measurable, unnest(rules) AS rule FROM c), w AS (SELECT *, CASE WHEN contains(rule, '.') THEN split_part(rule, '.', 1) ELSE '' END AS owner FROM u)
    SELECT id, 'no_movement' AS problem, NULL AS subject FROM c WHERE measurable AND id NOT IN (SELECT id FROM m)
    UNION SELECT id, 'no_base', NULL FROM c WHERE weighted AND base IS NULL UNION SELECT id, 'unknown_base', base FROM c WHERE weighted AND base IS NOT NULL AND base NOT IN (SELECT id FROM m)
    UNION SELECT id, 'errors_listed', CAST(n AS VARCHAR) FROM c WHERE n <> 5
    UNION SELECT id, CASE WHEN NOT measurable THEN 'not_measurable' WHEN owner NOT IN (SELECT split_part(id, '.', 1) FROM r) THEN 'unknown_owner' WHEN owner <> id THEN 'foreign_rule' ELSE 'unknown_rule' END, rule FROM w WHERE NOT (measurable AND owner = id AND rule IN (SELECT id FROM r))""")
def catalogue_references(spark, sf_dir):
    s = F.concat(F.lit("m"), F.col("s_suppkey").cast("string"))
    suppliers = table(spark, sf_dir, "supplier")
    rules = suppliers.select(F.concat(s, F.lit(".a")).alias("id")).unionAll(suppliers.filter("s_suppkey % 2 = 0").select(F.concat(s, F.lit(".b"))))
    k, size = F.col("p_partkey"), F.col("p_size")
    named = lambda x, end="": F.concat(F.lit("m"), x.cast("string"), F.lit(end))
    used = F.array(named(k, ".a"), named(k, ".b"), named(k + size % 2, ".a"), F.lit("free"))
    c = table(spark, sf_dir, "part").select(named(k).alias("id"), (k % 3 != 0).alias("measurable"), (size % 2 == 0).alias("weighted"), F.when(size % 4 == 0, named(k * 2)).alias("base_of"), used.alias("rule_ids"), (4 + k % 2).alias("n_errors"))
    return contracts.references(c, suppliers.select(s.alias("id")), rules)


@query("""SELECT CAST(event_id AS VARCHAR) AS key, 'exercise_named' AS rule FROM events WHERE event_id % 2 = 0 AND event_type = 'click'""")
def fusion_contract(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2 == 0).alias("fused"), F.when(F.col("event_type") == "click", " ").otherwise(F.col("event_type")).alias("exercise"))
    return contracts.fusion(e, "event_id")


@query("""SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS c_name, CASE WHEN s_suppkey IS NULL THEN c_mktsegment WHEN s_suppkey % 2 = 0 THEN 'EVEN' END AS c_mktsegment FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 3 WHERE c_custkey % 5 <> 0""")
def updated_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.col("s_name").alias("c_name"), F.when(F.col("s_suppkey") % 2 == 0, "EVEN").alias("c_mktsegment"))
    new = keyed.updated(c, "c_custkey", changes, ["c_name", "c_mktsegment"])
    return keyed.forgotten([new], "c_custkey", c.filter("c_custkey % 5 = 0"))[0]


@query("""WITH l AS (SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey % 4 <> 0) SELECT p_partkey, part.p_size + CASE WHEN p_partkey % 6 = 1 THEN 1 ELSE 0 END AS p_size, part.p_brand, l.p_partkey IS NULL AS first_run, l.p_partkey IS NOT NULL AND p_partkey % 6 = 1 AS changed_since_lock FROM part LEFT JOIN l USING (p_partkey)""")
def threshold_locks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    now = p.withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") % 6 == 1, 1).otherwise(0))
    return keyed.against_locks(now, p.filter("p_partkey % 4 <> 0"), "p_partkey", ["p_size", "p_brand"])
