"""Registered queries of scalar functions, scores, days, evaluation, jobs, graphs and contracts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import arrays, dates, num, text
from kinelake.operators import contracts, evaluation, graph, jobs, longitudinal, quality, reps, rules, sequences
from kinelake.plans.catalogue import _EDGES, _FRAMES, frames, query, rounded, supply_graph
from kinelake.sources.tables import table

# --- scalar functions --------------------------------------------------------

_SPOTTY = "CASE WHEN event_id % 7 <> 0 THEN value END"


@query(f"""SELECT user_id, round(quantile_cont({_SPOTTY}, 0.1), 6) AS p10, round(avg(CASE WHEN {_SPOTTY} >= 50 THEN 1.0 WHEN {_SPOTTY} < 50 THEN 0.0 END), 6) AS above, CASE WHEN count({_SPOTTY}) >= 2 THEN round(stddev_pop({_SPOTTY}), 6) END AS deviation,
    round(quantile_cont({_SPOTTY}, 0.95) - quantile_cont({_SPOTTY}, 0.05), 6) AS spread, round(avg({_SPOTTY}), 6) AS mean, round(quantile_cont({_SPOTTY}, 0.5), 6) AS median, round(count({_SPOTTY}) / count(*), 6) AS coverage, round(max({_SPOTTY}) - min({_SPOTTY}), 6) AS travel,
    round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS observed, CAST(CASE WHEN count(*) % 2 = 1 THEN list_sort(list(event_id))[count(*) // 2 + 1] ELSE floor((list_sort(list(event_id))[count(*) // 2] + list_sort(list(event_id))[count(*) // 2 + 1]) / 2) END AS BIGINT) AS middle_id FROM events GROUP BY 1""")
def robust_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")).otherwise(float("nan")))
    out = e.groupBy("user_id").agg(num.pct("v", 10).alias("p10"), num.frac("v", 50).alias("above"), num.deviation("v").alias("deviation"), num.spread("v").alias("spread"), num.mean("v").alias("mean"), num.med("v").alias("median"), num.coverage("v").alias("coverage"), num.travel("v").alias("travel"), num.observed(F.col("event_type") != "error").alias("observed"), num.integer_median(F.collect_list("event_id")).cast("long").alias("middle_id"))
    return rounded(out, 6, "p10", "above", "deviation", "spread", "mean", "median", "coverage", "travel", "observed")


_CMP = "CASE o_orderkey % 4 WHEN 0 THEN '<' WHEN 1 THEN '<=' WHEN 2 THEN '>' ELSE '>=' END"


@query(f"""SELECT o_orderkey, CASE {_CMP} WHEN '<' THEN o_totalprice < 1e5 WHEN '<=' THEN o_totalprice <= 1e5 WHEN '>' THEN o_totalprice > 1e5 ELSE o_totalprice >= 1e5 END AS fires, round((CASE WHEN {_CMP} IN ('<', '<=') THEN 1e5 - o_totalprice ELSE o_totalprice - 1e5 END) / (1e5 + 1e-6), 9) AS exceedance,
    round(greatest(0.0, least(1.0, o_totalprice / 3e5)), 9) AS clipped, CASE WHEN list_sum(list_transform(string_split(sha256(CAST(o_orderkey AS VARCHAR)), ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders""")
def rule_arithmetic(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cmp = F.get(F.array(*map(F.lit, ("<", "<=", ">", ">="))), (F.col("o_orderkey") % 4).cast("int"))
    price, limit = F.col("o_totalprice"), F.lit(1e5)
    out = o.select("o_orderkey", num.fires(price, cmp, limit).alias("fires"), num.exceedance(price, limit, cmp).alias("exceedance"), num.clip01(price / 3e5).alias("clipped"), num.split_of(F.col("o_orderkey").cast("string")).alias("split"))
    return rounded(out, 9, "exceedance", "clipped")


@query(r"""SELECT p_partkey, lower(trim(p_name || ' ')) AS plain, trim(lower(regexp_replace(p_brand || '_' || p_type, '[\s_-]+', ' ', 'g'))) AS label, upper(regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g')) AS code, regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9._-]+', '-', 'g') AS file,
    replace(CAST(p_size AS VARCHAR) || '.5', '.', ',') AS number, CASE WHEN contains(p_name, 'small') THEN 'S' WHEN contains(p_name, 'cold') THEN 'C' ELSE 'none' END AS first, CASE WHEN starts_with(p_type, 'ECONOMY') THEN 'eco' WHEN starts_with(p_type, 'PROMO') THEN 'promo' ELSE 'other' END AS kind,
    contains(p_name, 'widget') AS relevant, len(regexp_extract_all(p_brand || p_name, '-?\d+(?:[.,]\d+)?')) AS numbers FROM part""")
def part_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name, brand = F.col("p_name"), F.col("p_brand")
    return p.select(
        "p_partkey", text.plain(F.concat(name, F.lit(" "))).alias("plain"), text.label(F.concat_ws("_", brand, "p_type")).alias("label"), text.code(brand).alias("code"), text.file_slug(F.concat_ws(" ", brand, name)).alias("file"),
        text.localized_number(F.concat(F.col("p_size").cast("string"), F.lit(".5"))).alias("number"), text.first_match(name, [("small", "S"), ("cold", "C")], "none").alias("first"), text.starts_with(F.col("p_type"), [("ECONOMY", "eco"), ("PROMO", "promo")], "other").alias("kind"),
        text.relevant(name, F.array(F.lit("widget"))).alias("relevant"), F.size(text.numbers_in(F.concat(brand, name))).cast("long").alias("numbers"),
    )


@query("""SELECT event_id, props AS object, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 0 AND 50 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, CASE WHEN event_type = 'error' THEN 'absent' ELSE 'present' END AS verdict,
    'seen' AS code, list_value(CAST(user_id AS VARCHAR), event_type)[1] AS who FROM events""")
def reply_parsing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reply = F.concat(F.lit("so it is "), F.when(F.col("event_type") == "error", "absent").otherwise("present"), F.lit(", no doubt"))
    told = text.template(F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type"), [("seen", "user {num} did {what}"), ("other", "nothing")])
    return e.select("event_id", text.json_object(F.concat(F.lit("see: "), "props", F.lit(" end"))).alias("object"), text.small_count(F.col("props"), "k", 50).alias("k"), text.verdict(reply, ["present", "absent"]).alias("verdict"), told["code"].alias("code"), F.get(told["params"], F.lit(0)).alias("who"))


@query("""SELECT event_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(date_trunc('millisecond', ts))) / 60e6, 6) AS age, strftime(CAST(ts AS DATE) + 3, '%Y-%m-%d') AS later, round_even(event_id % 900 / 30.0, 2) AS seconds, strftime(ts, '%Y%m%dT%H%M%S') || '-' || left(sha256(CAST(event_id AS VARCHAR)), 6) AS id, CAST(date_trunc('week', ts) AS DATE) AS monday FROM events""")
def stamps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.select("event_id", dates.age_minutes(dates.stamp(F.col("ts")), F.lit("2024-02-01").cast("timestamp")).alias("age"), dates.shift(F.to_date("ts"), 3).alias("later"), dates.frame_seconds((F.col("event_id") % 900).cast("double"), F.lit(30.0)).alias("seconds"), dates.sortable_id(F.col("ts"), F.col("event_id").cast("string")).alias("id"), dates.monday(F.col("ts")).alias("monday"))
    return rounded(out, 6, "age")


_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"""SELECT vec_id, len(list_concat(v[1:4], v[54:64])) AS cut, round(v[53 + 1], 5) AS tail, round(v[1] + v[17] + v[33] + v[48] + v[64], 5) AS picked, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS dot, round(sqrt(list_sum(list_transform(range(63), lambda i: (v[i + 1] - v[i + 2]) * (v[i + 1] - v[i + 2])))), 4) AS step, round(v[2], 5) AS named FROM (SELECT vec_id, {_V} AS v FROM embeddings)""")
def vector_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    cut = arrays.head_and_tail(F.col("v"), 16, F.lit(None).cast("double"))
    out = rows.select("vec_id", F.size(F.filter(cut, lambda x: x.isNotNull())).cast("long").alias("cut"), F.get(cut, F.lit(5)).alias("tail"), total(arrays.spaced(F.col("v"), 5)).alias("picked"), arrays.dot(F.col("v"), F.col("v")).alias("dot"), arrays.l2(F.slice("v", 1, 63), F.slice("v", 2, 63)).alias("step"), F.get(arrays.vector(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.slice("v", 1, 2)), ["b", "c"]), F.lit(0)).alias("named"))
    return rounded(rounded(out, 5, "tail", "picked", "named"), 4, "dot", "step")


# --- scores --------------------------------------------------------------------

_REPS = """r AS (SELECT o_custkey AS clip, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rep_index, o_orderkey AS rep_id, o_totalprice / 4e5 AS depth, (o_orderkey % 97) / 97.0 AS peak, 0.5 + (o_orderkey % 17) / 10.0 AS ruler, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 13) / 10.0 END AS tempo, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 29) / 29.0 END AS smooth, o_orderkey % 23 <> 0 AS plausible, 0.4 + (o_orderkey % 7) / 10.0 AS quality FROM orders),
    c AS (SELECT *, CASE WHEN ruler BETWEEN 0.6 AND 1.9 THEN 0.5 * (greatest(0, least(1, depth / ruler)) + greatest(0, least(1, peak / ruler))) END AS range, CASE WHEN tempo IS NOT NULL THEN 0.25 * greatest(0, least(1, 1 - tempo / 0.7)) ELSE 0 END AS penalty FROM r),
    s AS (SELECT *, CASE WHEN NOT plausible THEN 'implausible' WHEN quality < 0.55 THEN 'low_quality' WHEN range IS NULL AND smooth IS NULL THEN 'no_component' WHEN range IS NULL THEN 'range_missing' END AS refusal, (coalesce(range, 0) * 0.75 + coalesce(smooth, 0) * 0.25) / nullif(CASE WHEN range IS NOT NULL THEN 0.75 ELSE 0 END + CASE WHEN smooth IS NOT NULL THEN 0.25 ELSE 0 END, 0) AS v FROM c),
    k AS (SELECT *, CASE WHEN refusal IS NULL THEN CAST(round_even(100 * v * (1 - penalty), 0) AS INTEGER) END AS score FROM s)"""


def scored_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sequences.numbered(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "rep_index")
    k = F.col("o_orderkey")
    rows = o.select(F.col("o_custkey").alias("clip"), F.col("rep_index").cast("long").alias("rep_index"), k.alias("rep_id"), (F.col("o_totalprice") / 4e5).alias("depth"), ((k % 97) / 97.0).alias("peak"), (0.5 + (k % 17) / 10.0).alias("ruler"), F.when(k % 11 != 0, (k % 13) / 10.0).alias("tempo"), F.when(k % 5 != 0, (k % 29) / 29.0).alias("smooth"), (k % 23 != 0).alias("plausible"), (0.4 + (k % 7) / 10.0).alias("quality"))
    rows = rows.withColumn("range", quality.range_component(F.col("depth"), F.col("peak"), F.col("ruler"))).withColumn("penalty", quality.control_penalty(F.col("tempo")))
    return quality.rep_scores(rows, {"range": 0.75, "smooth": 0.25})


@query(f"WITH {_REPS} SELECT rep_id, refusal, score, score IS NOT NULL AND range IS NOT NULL AND smooth IS NOT NULL AS complete, CASE WHEN score IS NULL THEN 'unmeasured' WHEN score >= 73 THEN 'strong' WHEN score >= 47 THEN 'solid' WHEN score >= 20 THEN 'shaky' ELSE 'broken down' END AS band FROM k")
def repetition_scores(spark, sf_dir):
    return scored_reps(spark, sf_dir).select("rep_id", "refusal", "score", "complete", rules.score_band(F.col("score")).alias("band"))


@query(f"""WITH {_REPS}, u AS (SELECT clip, 'range' AS component, range AS value FROM k UNION ALL SELECT clip, 'smooth', smooth FROM k) SELECT clip, component, count(DISTINCT round(value, 4)) AS "distinct", round(avg(CASE WHEN value >= 0.999 THEN 1.0 ELSE 0.0 END), 6) AS at_ceiling, round(max(value) - min(value), 6) AS span FROM u WHERE value IS NOT NULL GROUP BY 1, 2""")
def score_ceilings(spark, sf_dir):
    return rounded(quality.ceiling(scored_reps(spark, sf_dir), ["range", "smooth"], ["clip"]), 6, "at_ceiling", "span")


@query(f"""WITH {_REPS}, u AS (SELECT clip, 'range' AS component, avg(range) AS mean FROM k GROUP BY 1 UNION ALL SELECT clip, 'smooth', avg(smooth) FROM k GROUP BY 1) SELECT clip, arg_min(component, struct_pack(a := mean, b := component)) AS weakest, arg_max(component, struct_pack(a := mean, b := component)) AS strongest FROM u WHERE mean IS NOT NULL GROUP BY 1""")
def weakest_components(spark, sf_dir):
    return quality.weakest(scored_reps(spark, sf_dir), ["range", "smooth"], ["clip"])


@query(f"""WITH {_REPS}, t AS (SELECT clip, count(*) AS n, arg_max(tempo + 1, rep_index) / arg_min(tempo + 1, rep_index) - 1 AS drift FROM k WHERE tempo IS NOT NULL GROUP BY 1) SELECT clip, n, round(drift, 9) AS drift, CASE WHEN drift > 0.15 THEN 'slower' WHEN drift < -0.15 THEN 'faster' ELSE 'steady' END AS verdict FROM t WHERE n >= 3""")
def slowing_sets(spark, sf_dir):
    rows = scored_reps(spark, sf_dir).withColumn("seconds", F.col("tempo") + 1)
    return rounded(quality.slowing(rows, ["clip"]), 9, "drift")


@query(f"""WITH {_REPS}, q AS (SELECT clip, rep_index, score, rank() OVER a + (count(*) OVER (PARTITION BY clip, rep_index) - 1) / 2 AS x, rank() OVER b + (count(*) OVER (PARTITION BY clip, score) - 1) / 2 AS y, floor(3 * (row_number() OVER a - 1) / count(*) OVER (PARTITION BY clip)) AS third FROM k WHERE score IS NOT NULL WINDOW a AS (PARTITION BY clip ORDER BY rep_index), b AS (PARTITION BY clip ORDER BY score)),
    m AS (SELECT clip, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round((avg(x * y) - avg(x) * avg(y)) / (stddev_pop(x) * stddev_pop(y)), 6) END AS rho, round(avg(score) FILTER (third = 0) - avg(score) FILTER (third = 2), 6) AS fall FROM q GROUP BY 1)
    SELECT clip, rho, fall, coalesce(rho < 0 AND fall > 5, false) AS degrades FROM m""")
def score_degradation(spark, sf_dir):
    return rounded(quality.degradation(scored_reps(spark, sf_dir), ["clip"], 5.0), 6, "rho", "fall").withColumn("degrades", F.coalesce("degrades", F.lit(False)))


@query(f"""WITH {_REPS}, b AS (SELECT avg(score) AS base FROM k) SELECT CAST(clip % 3 AS VARCHAR) AS kind, round(any_value(base) - avg(score), 6) AS fall, any_value(base) - avg(score) > 0.1 AS detected FROM k, b GROUP BY 1""")
def score_sensitivity(spark, sf_dir):
    rows = scored_reps(spark, sf_dir)
    worse = rows.withColumn("kind", (F.col("clip") % 3).cast("string"))
    return rounded(quality.sensitivity(rows, worse, 0.1), 6, "fall")


@query(f"""WITH {_REPS}, p AS (SELECT clip, avg(score) FILTER (rep_index % 2 = 1) AS a, avg(score) FILTER (rep_index % 2 = 0) AS b FROM k GROUP BY 1) SELECT round(avg(abs(a - b)), 6) AS noise, avg(abs(a - b)) <= 5 AS passed FROM p""")
def score_reliability(spark, sf_dir):
    odd = F.col("rep_index") % 2 == 1
    pairs = scored_reps(spark, sf_dir).groupBy("clip").agg(F.avg(F.when(odd, F.col("score"))).alias("a"), F.avg(F.when(~odd, F.col("score"))).alias("b"))
    return rounded(quality.reliability(pairs), 6, "noise")


# --- days ----------------------------------------------------------------------

_DAYS = """x AS (SELECT event_type AS movement, CAST(ts AS DATE) AS day, event_id % 101 AS score, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 5 <> 0 END AS plausible FROM events),
    d AS (SELECT movement, day, count(*) AS reps, CAST(CASE WHEN count(*) % 2 = 1 THEN list_sort(list(score))[count(*) // 2 + 1] ELSE floor((list_sort(list(score))[count(*) // 2] + list_sort(list(score))[count(*) // 2 + 1]) / 2) END AS INTEGER) AS score FROM x WHERE coalesce(plausible, true) GROUP BY 1, 2)"""


def day_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("movement"), F.to_date("ts").alias("day"), (F.col("event_id") % 101).alias("score"), F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 5 != 0).alias("plausible"), F.lit(True).alias("complete"))
    return longitudinal.day_records(rows)


@query(f"WITH {_DAYS} SELECT movement, day, reps, score FROM d")
def day_records(spark, sf_dir):
    return day_table(spark, sf_dir)


@query(f"""WITH {_DAYS}, z(movement, need_reps, need_score, need_days) AS (VALUES ('click', 2, 40, 3), ('view', 3, 50, 10), ('error', 1, 90, 1)) SELECT movement, count(*) FILTER (reps >= need_reps AND score >= need_score) AS days_met, count(*) FILTER (reps >= need_reps AND score >= need_score) >= max(need_days) AS ready, arg_max(day, struct_pack(a := reps, b := score, c := day)) AS best_day, arg_max(reps, struct_pack(a := reps, b := score, c := day)) AS best_reps, arg_max(score, struct_pack(a := reps, b := score, c := day)) AS best_score FROM d JOIN z USING (movement) GROUP BY 1""")
def movement_readiness(spark, sf_dir):
    standards = spark.createDataFrame([("click", 2, 40, 3), ("view", 3, 50, 10), ("error", 1, 90, 1)], "movement string, need_reps int, need_score int, need_days int")
    return longitudinal.readiness(day_table(spark, sf_dir), standards)


@query(f"WITH {_DAYS} SELECT day, CAST(sum(reps) AS BIGINT) AS reps, CAST(floor(sum(score * reps) / sum(reps)) AS BIGINT) AS score, arg_min(movement, struct_pack(a := -reps, b := movement)) AS dominant FROM d GROUP BY 1")
def folded_days(spark, sf_dir):
    return longitudinal.folded_days(day_table(spark, sf_dir))


@query(f"WITH {_DAYS} SELECT movement, day, reps, score FROM (SELECT *, dense_rank() OVER (PARTITION BY movement ORDER BY day DESC) AS r FROM d) WHERE r <= 5")
def latest_days(spark, sf_dir):
    return longitudinal.latest_days(day_table(spark, sf_dir), ["movement"], "day", 5)


@query(f"""WITH {_DAYS}, g AS (SELECT movement, day - CAST(row_number() OVER (PARTITION BY movement ORDER BY day) AS INTEGER) AS g FROM d WHERE reps > 0), l AS (SELECT movement, max(n) AS n FROM (SELECT movement, g, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1)
    SELECT movement, bool_or(reps > 0) AS first_rep, bool_or(score >= 73) AS strong_day, sum(reps) >= 100 AS hundred_reps, coalesce(any_value(n) >= 7, false) AS week_streak FROM d LEFT JOIN l USING (movement) GROUP BY 1""")
def earned_badges(spark, sf_dir):
    return longitudinal.badges(day_table(spark, sf_dir), ["movement"])


@query(f"WITH {_DAYS}, v AS (SELECT movement, arg_max(score, day) - arg_min(score, day) AS delta FROM d GROUP BY 1) SELECT movement, delta, CASE WHEN delta > 8 THEN 'up' WHEN delta < -8 THEN 'down' ELSE 'steady' END AS direction FROM v")
def progress_directions(spark, sf_dir):
    return longitudinal.progress_direction(day_table(spark, sf_dir), ["movement"])


@query("""WITH p AS (SELECT s_suppkey AS pair, CASE WHEN s_suppkey % 2 = 0 THEN 'PLANAR' ELSE 'SCALED' END AS robustness, ['FRONTAL', 'FRONTAL,OBLIQUE', 'SAGITTAL'][s_nationkey % 3 + 1] AS a_bins, ['FRONTAL', 'FRONTAL,OBLIQUE', 'SAGITTAL'][s_suppkey % 3 + 1] AS b_bins, CASE WHEN s_suppkey % 5 = 0 THEN 'left' ELSE 'right' END AS a_sides, 'right' AS b_sides, 1.0 AS a_ruler, 1 + (s_suppkey % 7) / 20.0 AS b_ruler FROM supplier),
    q AS (SELECT *, CASE WHEN a_bins <> b_bins THEN 'viewpoint_differs' WHEN contains(a_bins, ',') THEN 'viewpoint_mixed' WHEN robustness = 'PLANAR' AND a_sides <> b_sides THEN 'side_differs' WHEN abs(a_ruler - b_ruler) > 0.15 * abs(a_ruler) THEN 'ruler_drift' END AS reason FROM p) SELECT pair, reason, reason IS NULL AS comparable FROM q""")
def comparable_sessions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    bins = F.array(F.lit("FRONTAL"), F.lit("FRONTAL,OBLIQUE"), F.lit("SAGITTAL"))
    k = F.col("s_suppkey")
    pairs = s.select(k.alias("pair"), F.when(k % 2 == 0, "PLANAR").otherwise("SCALED").alias("robustness"), F.get(bins, (F.col("s_nationkey") % 3).cast("int")).alias("a_bins"), F.get(bins, (k % 3).cast("int")).alias("b_bins"), F.when(k % 5 == 0, "left").otherwise("right").alias("a_sides"), F.lit("right").alias("b_sides"), F.lit(1.0).alias("a_ruler"), (1 + (k % 7) / 20.0).alias("b_ruler"))
    return longitudinal.comparable(pairs).select("pair", "reason", "comparable")


@query("""WITH l AS (SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS session_id, o_orderpriority AS exercise, o_orderkey % 9 AS n_reps FROM orders), s AS (SELECT o_custkey, list_sort(list_distinct(list(session_id))) AS s, list_sort(list_distinct(list(exercise))) AS e, count(*) AS clips, CAST(sum(n_reps) AS BIGINT) AS reps FROM l GROUP BY 1)
    SELECT o_custkey, array_to_string(s, ',') AS sessions, array_to_string(e, ',') AS exercises, clips, reps, array_to_string(s[greatest(len(s) - 1, 1):len(s)], ',') AS recent FROM s""")
def subject_snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("string").alias("session_id"), F.col("o_orderpriority").alias("exercise"), (F.col("o_orderkey") % 9).alias("n_reps"))
    return longitudinal.subject_snapshot(o, ["o_custkey"], 2).withColumns({c: F.array_join(c, ",") for c in ("sessions", "exercises", "recent")})


@query("""WITH r AS (SELECT o_custkey AS video, o_orderkey AS rep FROM orders WHERE o_orderstatus = 'F'), w AS (SELECT o_custkey AS video, string_agg(o_orderpriority, ' | ' ORDER BY first_place) AS reasons FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_place FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) GROUP BY 1)
    SELECT c_custkey AS video, coalesce(n, 0) AS n_reps, coalesce(reasons, '') AS reasons FROM customer LEFT JOIN (SELECT video, count(*) AS n FROM r GROUP BY 1) n ON n.video = c_custkey LEFT JOIN w ON w.video = c_custkey""")
def clip_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("video", F.col("o_custkey"))
    clips = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video"))
    return longitudinal.ingest_log(clips, o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'").select("video", F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("reason")))


@query("""WITH m AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '_' || CASE WHEN o_orderkey % 3 = 0 THEN 'push_up' ELSE 'dip' END || '_' || CAST(o_orderkey % 4 AS VARCHAR) AS name FROM orders)
    SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'clip' || CAST(o_orderkey AS VARCHAR) ELSE name END AS video, CASE WHEN o_orderkey % 10 = 0 THEN 'told' WHEN o_orderkey % 7 = 0 THEN '2024-05-06' ELSE left(name, 10) END AS session_id, CASE WHEN o_orderkey % 10 = 0 THEN 'squat' WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'push_up' ELSE 'dip' END AS exercise, count(*) AS n FROM m GROUP BY ALL""")
def clip_names(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), F.when(k % 3 == 0, "push_up").otherwise("dip"), F.lit("_"), (k % 4).cast("string"))
    # names are made unique for the join, and shortened again after it
    tag = F.concat(F.lit("#"), k.cast("string"))
    clips = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.when(k % 7 == 0, F.concat(F.lit("clip"), k.cast("string"))).otherwise(name), tag).alias("video"), F.lit("2024-05-06").cast("timestamp").alias("modificationTime"))
    told = clips.filter("o_orderkey % 10 = 0").select("video", F.lit("told").alias("session_id"), F.lit("squat").alias("exercise"), F.lit(1).alias("set_index"))
    out = longitudinal.clip_metadata(clips.select("video", "modificationTime"), told)
    return out.select(F.regexp_replace("video", "#.*$", "").alias("video"), "session_id", "exercise").groupBy("video", "session_id", "exercise").agg(F.count(F.lit(1)).alias("n"))


# --- evaluation ----------------------------------------------------------------


@query("""WITH v AS (SELECT c_custkey AS clip, c_mktsegment AS error, CASE c_custkey % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' ELSE 'unclear' END AS verdict, c_acctbal > 5000 AS truth FROM customer), s AS (SELECT error, count(*) FILTER (verdict = 'present' AND truth) AS hits, count(*) FILTER (verdict = 'present' AND NOT truth) AS false_alarms, count(*) FILTER (verdict = 'absent' AND truth) AS missed, count(*) FILTER (verdict = 'absent' AND NOT truth) AS quiet, count(*) FILTER (verdict = 'unclear') AS unclear FROM v GROUP BY 1)
    SELECT *, round(hits / nullif(hits + false_alarms, 0), 9) AS precision, round(hits / nullif(hits + missed, 0), 9) AS recall FROM s""")
def verdicts_against_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), F.col("c_mktsegment").alias("error"), F.get(F.array(*map(F.lit, ("present", "absent", "unclear"))), (F.col("c_custkey") % 3).cast("int")).alias("verdict"), (F.col("c_acctbal") > 5000).alias("truth"))
    return rounded(evaluation.against_labels(c.select("clip", "error", "verdict"), c.select("clip", "error", "truth"), ["clip", "error"]), 9, "precision", "recall")


_SETS = "f AS (SELECT o_custkey AS clip, list_distinct(list(o_orderpriority)) AS fired, list_distinct(list(o_orderpriority) FILTER (o_orderkey % 2 = 0)) AS expected, list_distinct(list(o_orderpriority) FILTER (o_orderkey % 5 = 0)) AS forbidden FROM orders GROUP BY 1)"


@query(f"""WITH {_SETS}, g AS (SELECT clip, list_distinct(list_concat(fired[2:9], [])) AS fired, coalesce(expected, []) AS expected, coalesce(forbidden, []) AS forbidden FROM (SELECT clip, list_sort(fired) AS fired, expected, forbidden FROM f))
    SELECT clip, array_to_string(list_sort(list_filter(expected, lambda x: NOT list_contains(fired, x))), ',') AS missed, array_to_string(list_sort(list_filter(fired, lambda x: NOT list_contains(expected, x))), ',') AS extra, array_to_string(list_sort(list_filter(fired, lambda x: list_contains(forbidden, x))), ',') AS forbidden FROM g""")
def fault_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    of = lambda m: F.collect_set(F.when(F.col("o_orderkey") % m == 0, F.col("o_orderpriority")))
    rows = o.groupBy(F.col("o_custkey").alias("clip")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("fired"), of(2).alias("expected"), of(5).alias("forbidden"))
    results = rows.select("clip", F.slice("fired", 2, 8).alias("fired"))
    return evaluation.set_checks(results, rows.select("clip", "expected", "forbidden"), "clip").withColumns({c: F.array_join(c, ",") for c in ("missed", "extra", "forbidden")})


@query("""WITH r AS (SELECT o_custkey AS clip, count(*) AS n_reps FROM orders GROUP BY 1), m AS (SELECT c_custkey AS clip, c_mktsegment AS movement, 8 + c_custkey % 5 AS reps FROM customer) SELECT movement, round(avg(abs(n_reps - reps)), 6) AS mean_abs_error, count(*) FILTER (n_reps = reps) AS exact, count(*) AS clips FROM r JOIN m USING (clip) GROUP BY 1""")
def count_errors(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("clip")).agg(F.count(F.lit(1)).alias("n_reps"))
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), F.col("c_mktsegment").alias("movement"), (8 + F.col("c_custkey") % 5).alias("reps"))
    return rounded(evaluation.count_errors(found, manifest, "clip"), 6, "mean_abs_error")


@query("""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'dip' ELSE 'squat' END AS directory FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 'dip' ELSE 'squat' END AS vision FROM customer), c AS (SELECT c_custkey AS k, 'squat' AS model FROM customer WHERE c_custkey % 3 = 0)
    SELECT k, directory, vision, model FROM a FULL JOIN b USING (k) FULL JOIN c USING (k) WHERE len(list_distinct(list_filter([directory, vision, model], lambda x: x IS NOT NULL))) > 1""")
def disputed_labels(spark, sf_dir):
    k = F.col("c_custkey").alias("k")
    c = table(spark, sf_dir, "customer")
    of = lambda m: F.when(F.col("c_custkey") % m == 0, "dip").otherwise("squat")
    return evaluation.disputes(c.filter("c_custkey % 5 <> 0").select(k, of(4).alias("directory")), c.select(k, of(6).alias("vision")), c.filter("c_custkey % 3 = 0").select(k, F.lit("squat").alias("model")), "k")


@query("""WITH t AS (SELECT o_orderpriority AS bin, quantile_cont(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1) SELECT o_orderpriority AS bin, o_orderstatus AS label, count(*) AS n, count(*) FILTER (o_totalprice > p95) AS detected, round(avg(CASE WHEN o_totalprice > p95 THEN 1.0 ELSE 0.0 END), 9) AS rate, round(quantile_cont(o_orderkey % 100, 0.5), 6) AS median_percentile FROM orders JOIN t ON o_orderpriority = bin GROUP BY 1, 2""")
def holdout_rates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("bin"), F.col("o_orderstatus").alias("label"), F.col("o_totalprice").alias("total"), (F.col("o_orderkey") % 100).alias("percentile"))
    limits = o.groupBy("bin").agg(F.percentile("total", F.lit(0.95)).alias("p95"))
    return rounded(rounded(evaluation.holdout_rates(o, limits, ["bin"]), 9, "rate"), 6, "median_percentile")


@query("""SELECT DISTINCT p_size / 2.0 AS threshold, s_name AS field FROM part JOIN supplier ON abs(p_size / 2.0 - s_suppkey / 4.0) < 1e-9 OR abs(p_size / 2.0 - s_suppkey * 25.0) < 1e-9""")
def matching_fields(spark, sf_dir):
    config = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("field"), (F.col("s_suppkey") / 4.0).alias("value"))
    return evaluation.matching_fields(config, table(spark, sf_dir, "part").select((F.col("p_size") / 2.0).alias("threshold")))


@query("""WITH a AS (SELECT c_custkey AS k, unnest(['name', 'segment']) AS path, unnest([c_name, c_mktsegment]) AS value FROM customer), b AS (SELECT c_custkey AS k, unnest(['name', 'segment']) AS path, unnest([c_name, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END]) AS value FROM customer WHERE c_custkey % 11 <> 0)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.path, b.path) AS path, a.value AS before, b.value AS after FROM a FULL JOIN b ON a.k = b.k AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value""")
def leaf_differences(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    leaves = lambda segment: F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), segment)
    before = evaluation.flattened(c.select("k", leaves(F.col("c_mktsegment")).alias("m")), "k", "m")
    after = evaluation.flattened(c.filter("k % 11 <> 0").select("k", leaves(F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("c_mktsegment"))).alias("m")), "k", "m")
    return evaluation.leaf_differences(before, after, "k")


@query("""WITH c AS (SELECT doc_id, doc_id % 500 AS owner, toxic FROM labels), o AS (SELECT owner, min(toxic) AS l FROM c GROUP BY 1),
    f AS (SELECT owner, (row_number() OVER (PARTITION BY l ORDER BY sha256('0:' || CAST(owner AS VARCHAR)), owner) - 1) % 5 AS fold FROM o) SELECT owner, doc_id, toxic, fold FROM c JOIN f USING (owner)""")
def stratified_folds(spark, sf_dir):
    return evaluation.folds(table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 500).alias("owner"), "toxic"), "owner", "toxic")


# --- jobs, graphs, contracts -----------------------------------------------------


@query("""SELECT user_id AS referee, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def first_claims(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("referee"), "event_id", "event_type", "ts")
    return jobs.first_claims(e, "referee", ["ts", "event_id"])


@query("""SELECT user_id, CAST(sum(event_id % 3) AS BIGINT) AS used, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS bought FROM events GROUP BY 1""")
def usage_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).alias("used"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("bought"))
    return jobs.counters(e, ["user_id"], ["used", "bought"])


@query(f"""WITH {_EDGES}, n AS (SELECT r_name AS node FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier), t AS (SELECT node, coalesce(max(depth), 0) AS tier FROM n LEFT JOIN paths USING (node) GROUP BY node), w AS (SELECT ancestor AS node FROM paths WHERE node = 'Supplier#000000003' UNION ALL SELECT 'Supplier#000000003')
    SELECT node, tier, row_number() OVER (ORDER BY tier, node) AS week FROM w JOIN t USING (node) WHERE node NOT IN (SELECT r_name FROM region WHERE r_regionkey % 2 = 0)""")
def weekly_plan(spark, sf_dir):
    nodes, edges = supply_graph(spark, sf_dir)
    paths = graph.closure(edges)
    done = table(spark, sf_dir, "region").filter("r_regionkey % 2 = 0").select(F.col("r_name").alias("node"))
    state = graph.states(nodes, edges, paths, done, done.limit(0))
    return graph.plan("Supplier#000000003", graph.tiers(nodes, paths), paths, state).select("node", "tier", F.col("week").cast("long").alias("week"))


@query("""WITH q AS (SELECT user_id AS subject, count(*) FILTER (event_type = 'purchase') > 12 AS much, count(*) FILTER (event_type = 'error') > 12 AS bad FROM events GROUP BY 1) SELECT subject, CASE WHEN much THEN CASE WHEN bad THEN 'help' ELSE 'thank' END ELSE 'remind' END AS node, CASE WHEN much THEN 3 ELSE 2 END AS steps FROM q""")
def question_walk(spark, sf_dir):
    nodes = spark.createDataFrame([("buys", "yes", "errs"), ("buys", "no", "remind"), ("errs", "yes", "help"), ("errs", "no", "thank")], "node string, answer string, target string")
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject")).agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("event_type") == "error").alias("e"))
    yes = lambda c: F.when(F.col(c) > 12, "yes").otherwise("no")
    answers = e.select("subject", F.inline(F.array(F.struct(F.lit("buys").alias("node"), yes("p").alias("answer")), F.struct(F.lit("errs").alias("node"), yes("e").alias("answer")))))
    return graph.walked(nodes, answers, "buys").select("subject", "node", F.size("path").alias("steps"))


@query(f"""WITH f AS {_FRAMES}, c AS (SELECT user_id, max(frame) AS frames FROM f GROUP BY 1), s AS (SELECT user_id, i, CAST(10 * i - CASE WHEN user_id % 4 = 0 THEN 3 ELSE 0 END AS BIGINT) AS a, CAST(10 * i + 4 AS BIGINT) AS t, CAST(10 * i + 9 - CASE WHEN user_id % 5 = 0 THEN 6 ELSE 0 END AS BIGINT) AS b, frames FROM c, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i)), o AS (SELECT *, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM s)
    SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT (a < t AND t < b) THEN 'ordered' END, CASE WHEN NOT (a >= 0 AND b < frames) THEN 'inside' END, CASE WHEN NOT before <= a THEN 'disjoint' END], lambda x: x IS NOT NULL)) AS rule FROM o) GROUP BY 1""")
def segment_contract(spark, sf_dir):
    c = frames(spark, sf_dir).groupBy("user_id").agg(F.max("frame").alias("frames")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6))))
    u = F.col("user_id")
    rows = c.select("user_id", "frames", (10 * F.col("i") - F.when(u % 4 == 0, 3).otherwise(0)).alias("a"), (10 * F.col("i") + 4).alias("t"), (10 * F.col("i") + 9 - F.when(u % 5 == 0, 6).otherwise(0)).alias("b"))
    return contracts.counted(contracts.segments(rows, "user_id", "a", "t", "b", "frames"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity - 3 AS fps, l_quantity * 30 - 30 AS frames, CASE WHEN l_quantity = 3 THEN 0 ELSE (l_quantity * 30 - 30) / (l_quantity - 3) * (1 + l_discount) END AS duration FROM lineitem)
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS key, unnest(list_filter([CASE WHEN NOT fps > 0 THEN 'fps_positive' END, CASE WHEN NOT frames > 0 THEN 'frames_positive' END, CASE WHEN NOT coalesce(abs(duration - frames / nullif(fps, 0)) <= greatest(0.05 * duration, 1 / nullif(fps, 0)), false) THEN 'duration_matches' END], lambda x: x IS NOT NULL)) AS rule FROM c""")
def container_contract(spark, sf_dir):
    q = F.col("l_quantity")
    fps, count = F.nullif(q - 3, F.lit(0.0)), q * 30 - 30
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("key"), fps.alias("fps"), count.alias("frames"), F.when(q == 3, 0.0).otherwise(count / fps * (1 + F.col("l_discount"))).alias("duration"))
    return contracts.container(rows, "key")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, unnest(list_filter([CASE WHEN NOT length(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'dip' END) > 0 THEN 'named' END, CASE WHEN NOT o_totalprice / 3e5 BETWEEN 0 AND 1 THEN 'confidence' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def detection_contract(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("dip").alias("exercise"), (F.col("o_totalprice") / 3e5).alias("confidence"))
    return contracts.detection(o, "key")


@query("""WITH t AS (SELECT o_orderkey AS k, 'scored ' || CAST(round(o_totalprice / 1000, 1) AS VARCHAR) || ' of ' || CAST(100 + o_orderkey % 50 AS VARCHAR) AS text, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 1000, 1) ELSE -1.0 END AS fact FROM orders) SELECT DISTINCT k, raw FROM (SELECT k, fact, unnest([split_part(text, ' ', 2), split_part(text, ' ', 4)]) AS raw FROM t) WHERE abs(CAST(raw AS DOUBLE) - round(fact, CAST(length(split_part(raw, '.', 2)) AS INTEGER))) > 1e-9""")
def invented_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    price = F.round(F.col("o_totalprice") / 1000, 1)
    o = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("scored "), price.cast("string"), F.lit(" of "), (100 + k % 50).cast("string")).alias("text"), F.when(k % 3 == 0, price).otherwise(-1.0).alias("fact"))
    return reps.invented_numbers(o.select("k", "text"), o.select("k", "fact"), "k")
