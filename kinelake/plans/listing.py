"""Registered queries of lookups, counters, chunk plans and the load model, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import graph, listings
from kinelake.plans.catalogue import _EDGES, _FRAMES, frames, query, rounded, supply_graph
from kinelake.plans.poses import _P, _R, pose_frames, repetitions
from kinelake.sources.tables import BODY, table


@query("SELECT sha256(string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY CAST(o_orderkey AS VARCHAR))) AS fingerprint FROM orders")
def table_fingerprint(spark, sf_dir):
    return listings.content_fingerprint(table(spark, sf_dir, "orders"), "o_orderkey")


@query("""SELECT r_regionkey, sha256('{"r_regionkey":' || CAST(r_regionkey AS VARCHAR) || ',"r_name":"' || r_name || '"}') AS fingerprint FROM region""")
def config_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", listings.row_fingerprint("r_regionkey", "r_name").alias("fingerprint"))


@query("""WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS ident FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_name FROM customer WHERE c_custkey % 4 = 0) SELECT DISTINCT ident, s_suppkey, s_name FROM a JOIN supplier ON ident = CAST(s_suppkey AS VARCHAR) OR ident = replace(s_name, 'Supplier', 'Customer')""")
def identifier_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    asked = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("ident")).unionAll(c.filter("c_custkey % 4 = 0").select("c_name"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("other"))
    return listings.found(s, asked, ["s_suppkey", "other"]).drop("other")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, count(*) FILTER (event_id % 7 = 0) AS sevenths FROM events GROUP BY 1""")
def batch_counters(spark, sf_dir):
    return listings.batch_counters(table(spark, sf_dir, "events"), {"high": F.col("value") > 50, "sevenths": F.col("event_id") % 7 == 0}, ["event_type"])


@query("""WITH l AS (SELECT c_custkey AS k, c_mktsegment AS s, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS here FROM customer) SELECT s AS segment, count(*) FILTER (here) AS present, count(*) FILTER (NOT here) AS missing, array_to_string(list_sort(list(k) FILTER (NOT here))[1:5], ',') AS first_missing FROM l GROUP BY 1""")
def ledger_audit(spark, sf_dir):
    ledger = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    present = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return listings.audited(ledger, present, "k", ["segment"], 5).withColumn("first_missing", F.array_join(F.col("first_missing").cast("array<string>"), ","))


@query("""SELECT o_custkey, coalesce(list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderkey % 2 = 0))) = list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderkey % 2 = 1))), false) AS agrees FROM orders GROUP BY 1""")
def list_parity(spark, sf_dir):
    of = lambda r: F.collect_list(F.when(F.col("o_orderkey") % 2 == r, F.col("o_orderpriority")))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(of(0).alias("a"), of(1).alias("b"))
    return listings.parity(rows, ["o_custkey"], ["a", "b"])


@query("""WITH t AS (SELECT user_id, event_type, CAST(sum(event_id % 9) AS BIGINT) AS n FROM events GROUP BY 1, 2) SELECT user_id, arg_min(event_type, struct_pack(a := -n, b := event_type)) AS focus, max(n) AS total FROM t GROUP BY 1""")
def focus_movements(spark, sf_dir):
    return listings.focus(table(spark, sf_dir, "events").withColumn("amount", F.col("event_id") % 9), ["user_id"], "event_type", "amount")


@query("""WITH b AS (SELECT n_regionkey, n_name, n_nationkey % 3 = 0 AS passed, 'rest ' || CAST(n_nationkey % 3 AS VARCHAR) AS reason FROM nation) SELECT n_regionkey, count(*) FILTER (passed) AS passing, min(n_name) FILTER (passed) AS reported, coalesce(array_to_string(list_sort(list_distinct(list(reason) FILTER (NOT passed))), '; '), '') AS reasons FROM b GROUP BY 1""")
def overall_bins(spark, sf_dir):
    bins = table(spark, sf_dir, "nation").select("n_regionkey", "n_name", (F.col("n_nationkey") % 3 == 0).alias("passed"), F.concat(F.lit("rest "), (F.col("n_nationkey") % 3).cast("string")).alias("reason"))
    return listings.overall(bins, ["n_regionkey"], "n_name")


@query("SELECT event_type, row_number() OVER (ORDER BY min(struct_pack(a := ts, b := event_id)), event_type) AS place FROM events GROUP BY 1")
def first_seen_names(spark, sf_dir):
    return listings.first_seen(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"]).withColumn("place", F.col("place").cast("long"))


@query("SELECT round(avg(abs(p_retailprice - s_acctbal)), 4) AS deviation FROM part, supplier")
def bank_deviation(spark, sf_dir):
    a, b = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("v")), table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v"))
    return rounded(listings.bank_deviation(a, b, "v"), 4, "deviation")


_CHUNKS = f"""c AS (SELECT user_id AS video, max(frame) AS n_frames FROM {_FRAMES} GROUP BY 1), w AS (SELECT *, greatest(1, least(4, n_frames // 15)) AS w FROM c), p AS (SELECT video, CAST(i AS INTEGER) AS chunk, CAST(round_even(i * n_frames / w, 0) AS BIGINT) AS start, CAST(round_even((i + 1) * n_frames / w, 0) AS BIGINT) AS "end" FROM (SELECT *, unnest(range(w)) AS i FROM w))"""


@query(f"""WITH {_CHUNKS} SELECT video, chunk, CASE WHEN chunk = 0 THEN 0 ELSE greatest(0, start - 5) END AS read_from, start, "end" FROM p""")
def chunk_plans(spark, sf_dir):
    clips = frames(spark, sf_dir).groupBy(F.col("user_id").alias("video")).agg(F.max("frame").alias("n_frames"))
    return listings.chunk_plan(clips, 4, 5, 15)


@query(f"""WITH {_CHUNKS}, g AS (SELECT video, unnest(range(start, "end" - CASE WHEN video % 5 = 0 AND chunk = 1 THEN 1 ELSE 0 END)) AS frame FROM p), x AS (SELECT DISTINCT video FROM p l WHERE video % 5 = 0 AND chunk = 1 AND (chunk < (SELECT max(chunk) FROM p WHERE p.video = l.video) OR "end" - start = 1)) SELECT video, frame FROM g WHERE video NOT IN (SELECT video FROM x)""")
def stitched_chunks(spark, sf_dir):
    clips = frames(spark, sf_dir).groupBy(F.col("user_id").alias("video")).agg(F.max("frame").alias("n_frames"))
    plan = listings.chunk_plan(clips, 4, 5, 15)
    short = F.when((F.col("video") % 5 == 0) & (F.col("chunk") == 1), 1).otherwise(0)
    parts = plan.filter(F.col("end") - F.col("start") - short > 0).select("video", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end") - F.col("start") - short - 1)).alias("at"))
    return listings.stitched(plan, parts)[0]


@query(f"""WITH {_P}, {_R}, j AS (SELECT rep_id, start_frame AS a, end_frame AS b, frame, left_wrist_y - 280.5 AS v FROM r JOIN p USING (video) WHERE valid AND frame BETWEEN start_frame AND end_frame), m AS (SELECT rep_id, quantile_cont(v, 0.5) FILTER (frame <= a + 3) AS x, quantile_cont(v, 0.5) FILTER (frame >= b - 3) AS y FROM j GROUP BY 1)
    SELECT rep_id, round(CASE WHEN y IS NULL OR abs(x) <= abs(y) THEN x ELSE y END, 6) AS rest FROM m""")
def rest_levels(spark, sf_dir):
    clips = pose_frames(spark, sf_dir)
    spans = repetitions(clips).select("rep_id", "video", F.col("start_frame").alias("a"), F.col("end_frame").alias("b"))
    return rounded(listings.rest_level(clips.select("video", "frame", "valid", (F.col("left_wrist_y") - 280.5).alias("v")), spans, "v"), 6, "rest")


_TRACKED = "(" + " + ".join(f"CASE WHEN {j}_c > 0.5 THEN 1 ELSE 0 END" for j in BODY) + ") / 12.0"


@query(f"""WITH {_P}, m AS (SELECT video, CASE WHEN video % 4 = 0 THEN 0.5 ELSE 30 END AS fps, avg({_TRACKED}) AS tracked FROM p GROUP BY 1) SELECT video, unnest(list_filter([CASE WHEN NOT fps BETWEEN 1 AND 480 THEN 'fps_plausible' END, CASE WHEN tracked < 0.8 THEN 'tracked_enough' END], lambda x: x IS NOT NULL)) AS rule FROM m""")
def pose_contract(spark, sf_dir):
    return listings.pose_contract(pose_frames(spark, sf_dir).withColumn("fps", F.when(F.col("video") % 4 == 0, 0.5).otherwise(30.0)), least=0.8)


@query(r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'la espalda de pie' WHEN 1 THEN 'one two three four five' WHEN 2 THEN 'no más' ELSE p_name || ' uno dos tres cuatro más' END AS x FROM part), w AS (SELECT *, regexp_extract_all(lower(x), '[\p{L}\p{N}_]+') AS w FROM t)
    SELECT p_partkey, NOT (list_has_any(w, ['the', 'widget', 'three'])) AND (len(w) < 4 OR regexp_matches(x, '[áéíóúñ¿¡]') OR list_has_any(w, ['el', 'la', 'los', 'las', 'de', 'del', 'que', 'en', 'y', 'se', 'un', 'una', 'por', 'con', 'para', 'es', 'sin', 'al', 'lo', 'su', 'más', 'muy', 'ya'])) AS spanish FROM w""")
def spanish_texts(spark, sf_dir):
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, "la espalda de pie").when(k == 1, "one two three four five").when(k == 2, "no más").otherwise(F.concat("p_name", F.lit(" uno dos tres cuatro más")))
    return table(spark, sf_dir, "part").select("p_partkey", listings.looks_spanish(x, ["the", "widget", "three"]).alias("spanish"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'me' ELSE o_orderpriority END AS owner FROM orders""")
def claimed_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("owner"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))
    return listings.claimed(rows, "me", "5-LOW").select("o_orderkey", "owner")


@query("SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY 1")
def family_names(spark, sf_dir):
    return listings.grouped_names(table(spark, sf_dir, "nation"), "n_regionkey", "n_name").withColumn("names", F.array_join("names", ","))


@query(f"""WITH {_EDGES}, n AS (SELECT r_name AS node, length(r_name) % 4 AS family FROM region UNION ALL SELECT n_name, length(n_name) % 4 FROM nation UNION ALL SELECT s_name, CAST(right(s_name, 2) AS INTEGER) % 4 FROM supplier), t AS (SELECT node, any_value(family) AS family, coalesce(max(depth), 0) AS tier FROM n LEFT JOIN paths USING (node) GROUP BY node),
    c AS (SELECT *, row_number() OVER (PARTITION BY family, tier ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY family, tier) AS k FROM t), h AS (SELECT family, max(k) * 46.0 AS h FROM c GROUP BY 1), b AS (SELECT family, h, 60.0 + coalesce(sum(h + 34.0) OVER (ORDER BY family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM h)
    SELECT node, 90.0 + tier * 180.0 AS x, CAST(top + (h - k * 46.0) / 2 + i * 46.0 + 23.0 AS DOUBLE) AS y FROM c JOIN b USING (family)""")
def tree_layout(spark, sf_dir):
    nodes, edges = supply_graph(spark, sf_dir)
    tiers = graph.tiers(nodes, graph.closure(edges))
    number = F.right("node", F.lit(2)).try_cast("int")
    family = F.when(F.startswith("node", F.lit("Supplier")), number % 4).otherwise(F.length("node") % 4)
    rows = tiers.select("node", F.col("node").alias("name"), "tier", family.alias("family"))
    order = spark.createDataFrame([(i, i) for i in range(4)], "family int, place int")
    return listings.tree_layout(rows, "family", order)


@query("""WITH p AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS reps FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(reps[1:30], ',') AS reps, array_to_string(reps[1:5], ',') AS faults, array_to_string(reps[1:3], ',') AS notes FROM p""")
def payload_digests(spark, sf_dir):
    keys = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(keys.alias("reps"))
    out = listings.payload_digest(p.select("o_custkey", "reps", F.col("reps").alias("faults"), F.col("reps").alias("notes")), "o_custkey", "faults", "reps", "notes")
    return out.withColumns({c: F.array_join(c, ",") for c in ("reps", "faults", "notes")})


@query("""WITH f AS (SELECT regr_slope(o_totalprice / 1000, o_orderkey % 100) AS w, regr_intercept(o_totalprice / 1000, o_orderkey % 100) AS b FROM orders) SELECT o_orderkey, round(b + w * (o_orderkey % 100), 2) AS kg, round(b + w * (o_orderkey % 100), 2) > 1e-6 AS estimated FROM orders, f""")
def load_estimates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    return listings.predicted_load(o, ["x"], listings.load_model(o, ["x"], "y")).select("o_orderkey", "kg", "estimated")
