"""Registered queries of the analytics operators, with their DuckDB SQL.

A query applies one operator (or a small family) to whole driver tables; events
stand for a signal: clip = user_id, frame = row number by (ts, event_id).
Results are rounded where floating-point sums may differ in the last place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions import arrays, num, text
from kinelake.operators import aggregates, contracts, evaluation, graph, jobs, longitudinal, relational, reps, rules, sequences
from kinelake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def rounded(df: DataFrame, decimals: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), decimals) for c in columns})


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as clips: user_id, frame, value, event_type, ts."""
    return sequences.numbered(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date").alias("week"))


_FRAMES = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM events)"
_WEEKS = "(SELECT user_id, event_type, value, CAST(date_trunc('week', ts) AS DATE) AS week FROM events)"


@query(f"""SELECT user_id, week, count(*) AS n, count(*) FILTER (value >= 50) AS n_usable, round(avg(value), 9) AS mean_quality,
    array_to_string(list_sort(list_distinct(list(event_type))), ',') AS event_types, round(quantile_cont(value, 0.5), 4) AS value_median, count(value) AS value_n
    FROM {_WEEKS} GROUP BY user_id, week""")
def user_session_metrics(spark, sf_dir):
    out = aggregates.session_table(weekly(spark, sf_dir), ["user_id", "week"], ["value"], "value", 50, ["event_type"])
    # a mean of few decimals may lie on a tie at 4 decimals
    return rounded(rounded(out, 9, "mean_quality"), 4, "value_median")


@query(f"""WITH own AS (SELECT user_id, week, quantile_cont(value, 0.5) AS m, count(*) AS k FROM {_WEEKS} GROUP BY ALL HAVING count(*) >= 2),
    dev AS (SELECT user_id, sum((value - m) * (value - m)) AS ss, count(*) AS n, count(DISTINCT week) AS sessions FROM {_WEEKS} JOIN own USING (user_id, week) GROUP BY user_id)
    SELECT user_id, round(sqrt(ss / greatest(n - sessions, 1)), 4) AS sd, n, sessions, greatest(n - sessions, 1) AS df FROM dev""")
def pooled_noise(spark, sf_dir):
    return rounded(aggregates.pooled_noise(weekly(spark, sf_dir), ["user_id"], "week", "value"), 4, "sd")


@query(f"""WITH s AS (SELECT user_id, week, quantile_cont(value, 0.5) AS m, count(*) AS n FROM {_WEEKS} GROUP BY ALL),
    p AS (SELECT user_id, week AS a_week, m AS a, n AS an, lead(week) OVER w AS b_week, lead(m) OVER w AS b, lead(n) OVER w AS bn FROM s WINDOW w AS (PARTITION BY user_id ORDER BY week)),
    own AS (SELECT user_id, week, m, n FROM s WHERE n >= 2),
    dev AS (SELECT user_id, sqrt(sum((value - m) * (value - m)) / greatest(count(*) - count(DISTINCT week), 1)) AS sd FROM {_WEEKS} JOIN own USING (user_id, week) GROUP BY user_id)
    SELECT user_id, a_week, b_week, round(b - a, 4) AS change, round((b - a) / nullif(sd * sqrt(1.0 / an + 1.0 / bn), 0), 4) AS effect,
    coalesce(abs((b - a) / nullif(sd * sqrt(1.0 / an + 1.0 / bn), 0)) >= 2, false) AS supported FROM p LEFT JOIN dev USING (user_id) WHERE b_week IS NOT NULL""")
def session_comparison(spark, sf_dir):
    rows = weekly(spark, sf_dir)
    sessions = aggregates.session_table(rows, ["user_id", "week"], ["value"])
    pairs = relational.consecutive_pairs(sessions, ["user_id"], "week", ["value_median", "n"])
    out = aggregates.compared(pairs, aggregates.pooled_noise(rows, ["user_id"], "week", "value").select("user_id", "sd"), ["user_id"], "value")
    return rounded(out.select("user_id", "a_week", "b_week", "change", "effect", "supported"), 4, "change", "effect")


@query("""SELECT o_orderkey, o_orderpriority, round(100.0 * ((rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1) + 0.5 * count(*) OVER (PARTITION BY o_orderpriority, o_totalprice)) / count(*) OVER (PARTITION BY o_orderpriority), 6) AS percentile FROM orders""")
def empirical_percentile(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(aggregates.mid_rank_percentile(rows, ["o_orderpriority"], "o_totalprice").drop("o_totalprice"), 6, "percentile")


@query("""SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.95), 4) AS p95,
    round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, round(quantile_cont(o_totalprice, 0.95) / quantile_cont(o_totalprice, 0.5), 6) AS spread_ratio, count(*) < 12 AS resolution_limited FROM orders GROUP BY 1""")
def null_distribution(spark, sf_dir):
    out = aggregates.null_summary(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return rounded(rounded(out, 4, "median", "p95", "iqr"), 6, "spread_ratio")


@query(f"""WITH r AS (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS id FROM {_FRAMES} WHERE value >= 60)
    SELECT user_id, min(frame) AS first, max(frame) AS last, max(frame) - min(frame) + 1 AS length FROM r GROUP BY user_id, id""")
def signal_islands(spark, sf_dir):
    return sequences.islands(frames(spark, sf_dir), ["user_id"], "frame", F.col("value") >= 60)


@query(f"""WITH a AS (SELECT user_id, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame) > 3 THEN 1 ELSE 0 END AS g FROM {_FRAMES} WHERE value >= 60),
    b AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY frame) AS id FROM a),
    c AS (SELECT user_id, min(frame) AS first, max(frame) AS last, max(frame) - min(frame) + 1 AS length FROM b GROUP BY user_id, id)
    SELECT user_id, first, last, length FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first) = 1""")
def longest_active_span(spark, sf_dir):
    runs = sequences.islands(frames(spark, sf_dir), ["user_id"], "frame", F.col("value") >= 60, gap=2)
    return sequences.longest_island(runs, ["user_id"])


@query(f"""SELECT user_id, frame, value FROM (SELECT user_id, frame, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM {_FRAMES} WINDOW w AS (PARTITION BY user_id ORDER BY frame)) WHERE value > a AND value > b""")
def signal_maxima(spark, sf_dir):
    return sequences.local_maxima(frames(spark, sf_dir).select("user_id", "frame", "value"), ["user_id"], "frame", "value")


@query(f"""WITH a AS (SELECT user_id, value AS v, lead(value) OVER o - value AS d, first_value(value) OVER f AS f, last_value(value) OVER f AS l, count(*) OVER (PARTITION BY user_id) AS n FROM {_FRAMES}
      WINDOW o AS (PARTITION BY user_id ORDER BY frame), f AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    b AS (SELECT *, d * sign(l - f) AS s, coalesce((v - f) / nullif(l - f, 0) BETWEEN 0.1 AND 0.9, false) AND d IS NOT NULL AS i FROM a),
    c AS (SELECT *, avg(CASE WHEN i THEN s END) OVER (PARTITION BY user_id) AS m FROM b)
    SELECT user_id, CASE WHEN max(n) >= 6 THEN round(avg(CASE WHEN i THEN CAST(s < 0.25 * m AS DOUBLE) END), 6) END AS stalled FROM c GROUP BY user_id""")
def stalled_share(spark, sf_dir):
    return rounded(sequences.stalled_fraction(frames(spark, sf_dir), ["user_id"], "frame", "value"), 6, "stalled")


@query(f"""WITH d AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)) AS d FROM {_FRAMES})
    SELECT user_id, round(least(1.0, avg(d) / nullif(quantile_cont(d, 0.9), 0)), 6) AS evenness FROM d GROUP BY user_id""")
def step_evenness(spark, sf_dir):
    return rounded(sequences.evenness(frames(spark, sf_dir), ["user_id"], "frame", "value"), 6, "evenness")


@query(f"""SELECT user_id, CAST(floor((frame - 1) * 3 / n) AS INTEGER) AS bin, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 4) AS range
    FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {_FRAMES}) GROUP BY 1, 2""")
def phased_features(spark, sf_dir):
    rows = sequences.thirds(frames(spark, sf_dir), ["user_id"], "frame")
    out = rows.groupBy("user_id", "bin").agg(F.count(F.lit(1)).alias("n"), num.mean("value").alias("mean"), F.stddev_pop("value").alias("sd"), num.spread("value").alias("range"))
    return rounded(out, 4, "mean", "sd", "range")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), r AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS id FROM d)
    SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS length FROM r GROUP BY user_id, id""")
def day_streaks(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    return sequences.streaks(days, ["user_id"], "day")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM d),
    g AS (SELECT user_id, CAST(DATE '2024-01-15' + CAST(i AS INTEGER) AS DATE) AS day FROM u, range(7) t(i))
    SELECT g.user_id, g.day, coalesce(n, 0) AS n FROM g LEFT JOIN d USING (user_id, day)""")
def week_calendar(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sequences.week_grid(days, ["user_id"], "day", "n", F.lit("2024-01-17").cast("date"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
    t AS (SELECT event_type, CAST(sum(CASE WHEN DATE '2024-01-30' - day BETWEEN 0 AND 9 THEN n ELSE 0 END) AS BIGINT) AS recent, CAST(sum(CASE WHEN DATE '2024-01-30' - day BETWEEN 10 AND 19 THEN n ELSE 0 END) AS BIGINT) AS previous FROM d GROUP BY 1)
    SELECT event_type, recent, previous, recent - previous AS delta, round(100.0 * (recent - previous) / nullif(previous, 0), 4) AS pct FROM t""")
def fault_trend(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(aggregates.trend(days, ["event_type"], "day", "n", F.lit("2024-01-30").cast("date"), 10), 4, "pct")


@query("""WITH k AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL)
    SELECT day, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(s) / sum(n)) AS BIGINT) AS mean_amount, arg_min(event_type, struct_pack(a := -n, b := event_type)) AS dominant FROM k GROUP BY day""")
def day_summary(spark, sf_dir):
    return aggregates.day_rollup(table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date")), "day", "event_type", "value")


@query("""SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2""")
def label_confusion(spark, sf_dir):
    return aggregates.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""WITH s AS (SELECT quality AS label, quality = toxic AS hit, 1 AS t, 0 AS p FROM labels UNION ALL SELECT toxic, false, 0, 1 FROM labels),
    g AS (SELECT label, CAST(sum(t) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, count(*) FILTER (hit) AS correct FROM s GROUP BY 1)
    SELECT *, round(correct / nullif(predicted, 0), 6) AS precision, round(correct / nullif(support, 0), 6) AS recall, round(2 * correct / nullif(support + predicted, 0), 6) AS f1 FROM g""")
def class_report(spark, sf_dir):
    return rounded(aggregates.class_scores(table(spark, sf_dir, "labels"), "quality", "toxic"), 6, "precision", "recall", "f1")


@query("""WITH b AS (SELECT n_chars AS v, toxic FROM documents JOIN labels USING (doc_id)), p AS (SELECT v, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS n FROM b GROUP BY v),
    s AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS threshold, sum(p) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS fn, sum(n) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS tn, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM p),
    t AS (SELECT threshold, CAST(pos - fn AS BIGINT) AS tp, CAST(neg - tn AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round((pos - fn + tn) / (pos + neg), 6) AS agreement FROM s WHERE threshold IS NOT NULL)
    SELECT * FROM t""")
def threshold_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("v")).join(table(spark, sf_dir, "labels"), "doc_id")
    out = aggregates.threshold_sweep(rows.withColumn("rule", F.lit("n_chars")), ["rule"], "v", "toxic").drop("rule")
    return rounded(out, 6, "agreement")


@query("""WITH r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2 AS x, rank() OVER (PARTITION BY user_id ORDER BY ts) + (count(*) OVER (PARTITION BY user_id, ts) - 1) / 2 AS y FROM events)
    SELECT user_id, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round((avg(x * y) - avg(x) * avg(y)) / (stddev_pop(x) * stddev_pop(y)), 5) END AS rho FROM r GROUP BY user_id""")
def rank_correlation(spark, sf_dir):
    return rounded(aggregates.rank_correlation(table(spark, sf_dir, "events"), ["user_id"], "value", "ts"), 5, "rho")


@query("""SELECT l_suppkey, CASE WHEN count(*) >= 2 THEN round(stddev_pop(l_quantity) / nullif(avg(l_quantity), 0), 6) END AS cv FROM lineitem GROUP BY 1""")
def tempo_variation(spark, sf_dir):
    return rounded(aggregates.coefficient_of_variation(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity"), 6, "cv")


@query("""SELECT o_custkey, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS upper_median FROM orders GROUP BY 1""")
def upper_median(spark, sf_dir):
    return aggregates.upper_medians(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice")


@query("""WITH b AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL)
    SELECT c_mktsegment, CAST(arg_min(c_nationkey, struct_pack(a := -n, b := c_nationkey)) AS INTEGER) AS verdict, max(n) AS votes, CAST(sum(n) AS BIGINT) AS replies FROM b GROUP BY 1""")
def modal_answer(spark, sf_dir):
    return aggregates.consensus(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS place FROM supplier),
    p AS (SELECT s_suppkey, CAST(sum(3 - place) AS BIGINT) AS points, count(*) FILTER (place = 0) AS firsts FROM r WHERE place < 3 GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY points DESC, firsts DESC, s_suppkey) AS rank FROM p""")
def borda_count(spark, sf_dir):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    ranked = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.row_number().over(w) - 1).alias("place"))
    return relational.borda(ranked, "s_nationkey", "s_suppkey", "place", 3)


_SNAPSHOTS = """o AS (SELECT o_custkey AS k, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS first_seen, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS price FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1),
    n AS (SELECT o_custkey AS k, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS first_seen, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS price FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of customers from orders before and after a date."""
    orders = table(spark, sf_dir, "orders")
    cut = F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")
    key = F.struct("o_orderdate", "o_orderkey")
    return tuple(orders.filter(c).groupBy(F.col("o_custkey").alias("k")).agg(F.min_by("o_orderkey", key).alias("first_seen"), F.max_by("o_totalprice", key).alias("price")) for c in (cut, ~cut))


@query(f"WITH {_SNAPSHOTS} SELECT k, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.price, o.price) AS price FROM o FULL JOIN n USING (k)")
def ledger_upsert(spark, sf_dir):
    return relational.upserted(*snapshots(spark, sf_dir), ["k"], ["first_seen"])


@query(f"WITH {_SNAPSHOTS} SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n")
def replace_by_key(spark, sf_dir):
    return relational.replaced(*snapshots(spark, sf_dir), ["k"])


@query(f"WITH {_SNAPSHOTS} SELECT k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'gone' WHEN o.price = n.price THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT k FROM o UNION SELECT k FROM n) LEFT JOIN o USING (k) LEFT JOIN n USING (k)")
def snapshot_changes(spark, sf_dir):
    return relational.changes(*snapshots(spark, sf_dir), ["k"], ["price"])


@query(f"WITH {_SNAPSHOTS}, u AS (SELECT k, price, 0 AS p FROM n UNION ALL SELECT k, price, 1 FROM o) SELECT k, price FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY p) = 1")
def keep_first_union(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return relational.keep_first_union(new.select("k", "price"), old.select("k", "price"), key="k", order="price")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(spark, sf_dir):
    return jobs.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])


@query("""SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 3""")
def top_per_class(spark, sf_dir):
    return relational.top_per_key(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3)


@query("""WITH s AS (SELECT o_orderkey AS k, 0 AS lo, 40 AS hi FROM orders UNION ALL SELECT o_orderkey, 30, 90 FROM orders), p AS (SELECT DISTINCT l_orderkey AS k, date_diff('day', o_orderdate, l_shipdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    h AS (SELECT p.k, d, min(lo) AS lo FROM p JOIN s ON p.k = s.k AND d BETWEEN lo AND hi GROUP BY 1, 2)
    SELECT p.k, p.d, h.lo, CASE h.lo WHEN 0 THEN 40 WHEN 30 THEN 90 END AS hi FROM p LEFT JOIN h USING (k, d)""")
def first_span_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate").join(orders, "k").select("k", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("d")).distinct()
    spans = orders.select("k", F.inline(F.array(F.struct(F.lit(0).alias("lo"), F.lit(40).alias("hi")), F.struct(F.lit(30).alias("lo"), F.lit(90).alias("hi")))))
    return relational.in_first_span(points, spans, ["k"], "d", "lo", "hi")


@query("""SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND abs(a.value - b.value) < 0.5""")
def tolerance_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    a = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a_id"), F.col("value").alias("av"))
    b = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("b_id"), F.col("value").alias("bv"))
    return relational.within_tolerance(a, b, ["user_id"], [("av", "bv")], 0.5).select("user_id", "a_id", "b_id")


@query("""WITH v AS (SELECT doc_id, lang AS label, 0.9 AS score, 0 AS rank FROM documents UNION ALL SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END, 0.5, 1 FROM documents UNION ALL SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'en' END, 0.3, 2 FROM documents),
    g AS (SELECT doc_id, label, count(*) AS n, max(score) AS s, min(rank) AS r FROM v WHERE label IS NOT NULL GROUP BY 1, 2)
    SELECT doc_id, label, CAST(CASE WHEN n >= 2 THEN greatest(s, 0.86) ELSE s END AS DOUBLE) AS confidence, n >= 2 AS agreed FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n >= 2 THEN -n ELSE 0 END, r, label) = 1""")
def label_fusion(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    voter = lambda label, score, rank: d.select("doc_id", label.alias("label"), F.lit(score).cast("double").alias("score"), F.lit(rank).alias("rank"))
    votes = voter(F.col("lang"), 0.9, 0).unionByName(voter(F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")), 0.5, 1)).unionByName(voter(F.when(F.col("n_chars") % 2 == 0, "en"), 0.3, 2))
    return relational.vote(votes, "doc_id", "label", "score", "rank")


@query("""WITH t AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS a, min(ts) FILTER (event_type = 'view') AS b, min(ts) FILTER (event_type = 'purchase') AS c FROM events GROUP BY 1)
    SELECT user_id, 'to_view' AS stage, epoch_us(b - a) / 1e6 AS seconds FROM t WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT user_id, 'to_purchase', epoch_us(c - b) / 1e6 FROM t WHERE b IS NOT NULL AND c IS NOT NULL""")
def stage_durations(spark, sf_dir):
    return jobs.durations(table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", [("to_view", "signup", "view"), ("to_purchase", "view", "purchase")])


@query("""WITH l AS (SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1)
    SELECT user_id, event_type, ts, true AS failed FROM l WHERE event_type IN ('click', 'view') AND epoch_us(TIMESTAMP '2024-01-31' - ts) / 60e6 > 1440""")
def stale_jobs(spark, sf_dir):
    last = jobs.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "ts"])
    return jobs.stale(last, "event_type", "ts", F.lit("2024-01-31").cast("timestamp"), 1440, ["click", "view"]).drop("age_minutes")


@query("""SELECT user_id, event_id, CAST(sum(d) OVER w AS BIGINT) AS balance, sum(d) OVER w >= 0 AS accepted FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 3 ELSE -1 END AS d FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_credit(spark, sf_dir):
    ledger = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "signup", 3).otherwise(-1).alias("d"))
    return jobs.accepted_charges(ledger, "user_id", ["ts", "event_id"], "d").select("user_id", "event_id", "balance", "accepted")


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS "at" FROM events GROUP BY ALL) SELECT user_id, event_type, "at", max("at") OVER (PARTITION BY user_id ORDER BY "at", event_type ROWS UNBOUNDED PRECEDING) AS reached FROM f""")
def stage_waterfall(spark, sf_dir):
    return jobs.waterfall(table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts")


_EVIDENCE = """m AS (SELECT o_custkey AS rep, CASE o_custkey % 3 WHEN 0 THEN 'squat' WHEN 1 THEN 'dip' ELSE 'push_up' END AS movement, o_custkey % 10 AS clip, avg(o_totalprice) / 200000 AS tempo_ratio, count(*) / 40.0 AS stalled_frac, max(o_totalprice) / 500000 AS squat_depth, count(*) AS samples FROM orders GROUP BY 1),
    e AS (SELECT rep, 'tempo_ratio' AS primitive, CAST(tempo_ratio AS DOUBLE) AS value, samples FROM m UNION ALL SELECT rep, 'stalled_frac', CAST(stalled_frac AS DOUBLE), samples FROM m UNION ALL SELECT rep, 'squat_depth', CAST(squat_depth AS DOUBLE), samples FROM m),
    s AS (SELECT rep, primitive, value, CASE WHEN samples < 3 THEN 'unmeasured' ELSE 'measured' END AS state FROM e),
    r(movement, error, primitive, cmp, threshold) AS (VALUES ('dip', 'incomplete_lockout', 'start_elbow_deg', '<', 160.0), ('dip', 'excessive_depth', 'bottom_elbow_deg', '<', 90.0), ('dip', 'bounce', 'turn_speed', '>', 0.15), ('dip', 'dropped_descent', 'tempo_ratio', '<', 0.7), ('dip', 'lift_stall', 'stalled_frac', '>=', 0.05), ('push_up', 'short_travel', 'travel', '<', 0.35), ('push_up', 'incomplete_lockout', 'start_elbow_deg', '<', 160.0), ('push_up', 'hip_sag', 'hip_sag', '>', 0.12), ('push_up', 'dropped_descent', 'tempo_ratio', '<', 0.7), ('push_up', 'lift_stall', 'stalled_frac', '>=', 0.05), ('squat', 'shallow_depth', 'squat_depth', '<', 0.35), ('squat', 'dropped_descent', 'tempo_ratio', '<', 0.7), ('squat', 'knee_medial_drift', 'knee_valgus', '>', 0.12), ('squat', 'planted_ankle_rise', 'heel_rise', '>', 0.06), ('squat', 'lift_stall', 'stalled_frac', '>=', 0.05)),
    a AS (SELECT m.rep, m.clip, m.movement, r.error, s.value, r.threshold, r.cmp, CASE WHEN s.state IS NULL OR s.state <> 'measured' THEN 'unobservable' WHEN (cmp = '<' AND value < threshold) OR (cmp = '>=' AND value >= threshold) OR (cmp = '>' AND value > threshold) THEN 'observed' ELSE 'not_observed' END AS status
      FROM m JOIN r USING (movement) LEFT JOIN s ON s.rep = m.rep AND s.primitive = r.primitive)"""


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the registry over customers as repetitions."""
    orders = table(spark, sf_dir, "orders")
    m = orders.groupBy(F.col("o_custkey").alias("rep")).agg((F.avg("o_totalprice") / 200000).alias("tempo_ratio"), (F.count(F.lit(1)) / F.lit(40.0)).alias("stalled_frac"), (F.max("o_totalprice") / 500000).alias("squat_depth"), F.count(F.lit(1)).alias("samples"))
    movement = F.when(F.col("rep") % 3 == 0, "squat").when(F.col("rep") % 3 == 1, "dip").otherwise("push_up")
    subjects = m.select("rep", movement.alias("movement"), (F.col("rep") % 10).alias("clip"), F.lit(None).cast("string").alias("variant"), F.lit(False).alias("blocked"))
    evidence = m.unpivot(["rep", "samples"], ["tempo_ratio", "stalled_frac", "squat_depth"], "primitive", "value")
    evidence = evidence.withColumn("state", rules.knowability(F.col("value"), F.lit(1.0), F.col("samples"), F.lit(True)))
    return rules.assessed(subjects, rules.registry(spark), evidence, ["rep"])


@query(f"WITH {_EVIDENCE} SELECT rep, clip, movement, error, status FROM a")
def rule_verdicts(spark, sf_dir):
    return assessments(spark, sf_dir).select("rep", "clip", "movement", "error", "status")


@query(f"WITH {_EVIDENCE} SELECT movement, error, count(*) FILTER (status = 'observed') AS observed, count(*) FILTER (status = 'not_observed') AS not_observed, count(*) FILTER (status = 'unobservable') AS unobservable FROM a GROUP BY 1, 2")
def rule_summary(spark, sf_dir):
    return rules.summarised(assessments(spark, sf_dir), ["movement"])


@query(f"""WITH {_EVIDENCE}, x AS (SELECT clip, movement, count(DISTINCT rep) AS reps FROM a GROUP BY 1, 2),
    f AS (SELECT clip, movement, error, count(DISTINCT rep) AS n, max(CASE WHEN cmp = '<' THEN threshold - value ELSE value - threshold END / (abs(threshold) + 1e-6)) AS exceedance FROM a WHERE status = 'observed' GROUP BY 1, 2, 3)
    SELECT clip, movement, error, n, row_number() OVER (PARTITION BY clip, movement ORDER BY n DESC, exceedance DESC, error) AS rank FROM f JOIN x USING (clip, movement) WHERE n >= least(2, reps) QUALIFY rank <= 3""")
def top_fixes(spark, sf_dir):
    faults = rules.consensus_faults(assessments(spark, sf_dir), ["clip", "movement"], "rep")
    return rules.top_fixes(faults, ["clip", "movement"]).drop("exceedance")


_EDGES = """edges AS (SELECT n_name AS node, r_name AS requires FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    paths AS (SELECT node, requires AS ancestor, 1 AS depth FROM edges UNION ALL SELECT a.node, b.requires, 2 FROM edges a JOIN edges b ON a.requires = b.node)"""


def supply_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("requires"))
    b = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("node"), F.col("n_name").alias("requires"))
    nodes = region.select(F.col("r_name").alias("node")).unionByName(nation.select(F.col("n_name").alias("node"))).unionByName(supplier.select(F.col("s_name").alias("node")))
    return nodes, a.unionByName(b)


@query(f"WITH {_EDGES} SELECT node, ancestor, max(depth) AS depth FROM paths GROUP BY 1, 2")
def graph_closure(spark, sf_dir):
    return graph.closure(supply_graph(spark, sf_dir)[1])


@query(f"WITH {_EDGES}, n AS (SELECT r_name AS node FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier) SELECT node, coalesce(max(depth), 0) AS tier FROM n LEFT JOIN paths USING (node) GROUP BY node")
def graph_tiers(spark, sf_dir):
    nodes, edges = supply_graph(spark, sf_dir)
    return graph.tiers(nodes, graph.closure(edges))


@query(f"WITH {_EDGES} SELECT requires AS node, array_to_string(list_sort(list_distinct(list(node))), ',') AS unlocks FROM edges GROUP BY 1")
def graph_unlocks(spark, sf_dir):
    return graph.unlocks(supply_graph(spark, sf_dir)[1]).withColumn("unlocks", F.array_join("unlocks", ","))


@query(f"""WITH {_EDGES}, n AS (SELECT r_name AS node FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier),
    v AS (SELECT s_name AS node FROM supplier WHERE s_suppkey % 7 = 0), c AS (SELECT s_name AS node FROM supplier WHERE s_suppkey % 11 = 3), l AS (SELECT node, 2 AS s FROM v UNION ALL SELECT node, 1 FROM c UNION ALL SELECT ancestor, 1 FROM (SELECT node FROM v UNION ALL SELECT node FROM c) JOIN paths USING (node)), m AS (SELECT node, max(s) AS s FROM l GROUP BY 1),
    o AS (SELECT e.node, bool_and(m.node IS NOT NULL) AS open FROM edges e LEFT JOIN m ON e.requires = m.node GROUP BY 1)
    SELECT node, CASE WHEN s = 2 THEN 'verified' WHEN s = 1 THEN 'claimed' WHEN coalesce(open, true) THEN 'available' ELSE 'locked' END AS state FROM n LEFT JOIN m USING (node) LEFT JOIN o USING (node)""")
def graph_states(spark, sf_dir):
    nodes, edges = supply_graph(spark, sf_dir)
    verified = table(spark, sf_dir, "supplier").filter("s_suppkey % 7 = 0").select(F.col("s_name").alias("node"))
    claimed = table(spark, sf_dir, "supplier").filter("s_suppkey % 11 = 3").select(F.col("s_name").alias("node"))
    return graph.states(nodes, edges, graph.closure(edges), verified, claimed)


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS key, r AS rule FROM (SELECT l_orderkey, unnest(list_filter([CASE WHEN NOT l_discount < 0.08 THEN 'discount' END, CASE WHEN NOT l_quantity <= 45 THEN 'quantity' END, CASE WHEN NOT l_tax < 0.08 THEN 'tax' END], lambda x: x IS NOT NULL)) AS r FROM lineitem)""")
def contract_violations(spark, sf_dir):
    return contracts.violations(table(spark, sf_dir, "lineitem"), "l_orderkey", [("discount", F.col("l_discount") < 0.08), ("quantity", F.col("l_quantity") <= 45), ("tax", F.col("l_tax") < 0.08)])


@query("""SELECT vec_id, round(v[1], 4) AS first, round(v[16], 4) AS middle, round(v[31], 4) AS last FROM (SELECT vec_id, list_transform(range(31), lambda i: CAST(embedding[CAST(floor(i * 63 / 30) AS INTEGER) + 1] AS DOUBLE) + (CAST(embedding[CAST(least(floor(i * 63 / 30) + 1, 63) AS INTEGER) + 1] AS DOUBLE) - CAST(embedding[CAST(floor(i * 63 / 30) AS INTEGER) + 1] AS DOUBLE)) * (i * 63 / 30 - floor(i * 63 / 30))) AS v FROM embeddings)""")
def resampled_series(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", arrays.resampled(F.col("embedding"), 31).alias("v"))
    return rounded(rows.select("vec_id", F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(15)).alias("middle"), F.get("v", F.lit(30)).alias("last")), 4, "first", "middle", "last")


@query(r"""SELECT doc_id, left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_'), 60) AS slug, contains(lower(text), 'license') AS licensed, len(list_intersect(['the', 'and', 'of'], regexp_extract_all(lower(text), '([a-z]+)', 1))) AS listed FROM documents""")
def text_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.slug(F.col("text")).alias("slug"), (~text.is_clean(F.col("text"), ["license"])).alias("licensed"), F.size(text.words_in(F.col("text"), ["the", "and", "of"])).cast("long").alias("listed"))


@query("""SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, array_to_string(list(role ORDER BY turn), '|') AS roles FROM conversations GROUP BY 1""")
def ordered_narrative(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), "|")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), roles.alias("roles"))


@query(f"""WITH {_EVIDENCE}, g AS (SELECT clip, movement, error, count(*) FILTER (status = 'observed') AS yes, count(*) FILTER (status <> 'unobservable') AS judged FROM a GROUP BY 1, 2, 3)
    SELECT clip, movement, error, CASE WHEN judged = 0 THEN 'unclear' WHEN yes >= least(2, judged) THEN 'present' WHEN yes = 0 THEN 'absent' ELSE 'unclear' END AS verdict FROM g""")
def clip_verdicts(spark, sf_dir):
    return evaluation.clip_verdicts(assessments(spark, sf_dir), ["clip", "movement"])


@query(f"""WITH {_EVIDENCE}, g AS (SELECT movement, error, avg(CAST(status <> 'unobservable' AS DOUBLE)) AS judgeable, avg(CASE WHEN status <> 'unobservable' THEN CAST(status = 'observed' AS DOUBLE) END) AS fire_rate, list_sort(list(value) FILTER (status <> 'unobservable' AND value IS NOT NULL)) AS v FROM a GROUP BY 1, 2)
    SELECT movement, error, round(judgeable, 6) AS judgeable, round(fire_rate, 6) AS fire_rate, round(CASE WHEN len(v) > 0 THEN v[least(len(v) - 1, CAST(floor(len(v) * 0.5) AS BIGINT)) + 1] END, 6) AS median, coalesce(fire_rate = 0, true) AS dead FROM g""")
def rule_coverage(spark, sf_dir):
    out = evaluation.rule_coverage(assessments(spark, sf_dir)).select("movement", "error", "judgeable", "fire_rate", "median", "dead")
    return rounded(out, 6, "judgeable", "fire_rate", "median")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS reps FROM events GROUP BY ALL),
    g AS (SELECT user_id, CAST(sum(CASE WHEN day - DATE '2024-01-15' BETWEEN 0 AND 6 THEN reps ELSE 0 END) AS BIGINT) AS reps, CAST(sum(CASE WHEN day - DATE '2024-01-15' BETWEEN -7 AND -1 THEN reps ELSE 0 END) AS BIGINT) AS reps_before, count(*) FILTER (day - DATE '2024-01-15' BETWEEN 0 AND 6 AND reps = 0) AS blank_days FROM d GROUP BY 1)
    SELECT user_id, reps, reps_before, blank_days, reps - reps_before AS change FROM g""")
def week_review(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("reps")).withColumn("score", F.lit(0))
    return longitudinal.week_review(days, ["user_id"], F.lit("2024-01-15").cast("date")).drop("best_day")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), r AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS id FROM d),
    s AS (SELECT user_id, max(day) AS last, count(*) AS length FROM r GROUP BY user_id, id)
    SELECT user_id, max(CASE WHEN DATE '2024-01-30' - last BETWEEN 0 AND 1 THEN length ELSE 0 END) AS streak FROM s GROUP BY 1""")
def current_streak(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    return sequences.current_streak(sequences.streaks(days, ["user_id"], "day"), ["user_id"], F.lit("2024-01-30").cast("date"))


@query("""WITH g AS (SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_quantity) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN n > 0 AND hi - lo <= 1 THEN lo END AS count, hi > lo AS ranged FROM g""")
def count_reconciliation(spark, sf_dir):
    return aggregates.count_agreement(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity")


@query("""SELECT o_custkey, arg_min(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS a_price, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS b_price FROM orders GROUP BY 1 HAVING count(*) >= 3""")
def first_and_last_session(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_totalprice").alias("price"))
    return relational.first_and_last(rows, ["o_custkey"], "at", ["price"]).select("o_custkey", "a_price", "b_price")


@query(f"""SELECT user_id, frame, value FROM (SELECT *, greatest(ceil(count(*) OVER (PARTITION BY user_id) / 40), 1) AS step FROM {_FRAMES}) WHERE (frame - 1) % step = 0""")
def thinned_trace(spark, sf_dir):
    return sequences.thinned(frames(spark, sf_dir), ["user_id"], "frame", 40).select("user_id", "frame", "value")


@query(f"""WITH f AS (SELECT user_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS m FROM {_FRAMES}) SELECT user_id, CASE WHEN count(*) >= 6 THEN round(avg(CAST(abs(value - m) <= 20 AS DOUBLE)), 6) END AS parked FROM f GROUP BY 1""")
def parked_share(spark, sf_dir):
    return rounded(reps.parked(frames(spark, sf_dir), "user_id", "value", 20), 6, "parked")
