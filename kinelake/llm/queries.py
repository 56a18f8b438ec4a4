"""The training-data queries and their SQL, by name."""

from __future__ import annotations

import importlib

#: Query name -> (module, function); a module is imported when its query is built.
_QUERIES = {
    "op1_langid": ("langid", "op1_langid"),
    "op2_decontaminate": ("decontam", "op2_decontaminate"),
    "op3_extract_main_text": ("html_text", "op3_extract_main_text"),
    "op4_order_minhash": ("order_minhash", "op4_order_minhash"),
    "op5_near_dedup": ("near_dedup", "op5_near_dedup"),
    "op6_repeated_substrings": ("suffix_dedup", "op6_repeated_substrings"),
    "op7_lm_score": ("lm_score", "op7_lm_score"),
    "op8_mix_sources": ("mixing", "op8_mix_sources"),
    "op9_toxicity": ("toxicity", "op9_toxicity"),
    "op10_token_files": ("token_files", "op10_token_files"),
    "op11_fill_in_middle": ("fim", "op11_fill_in_middle"),
    "op12_ball_kmeans": ("ball_kmeans", "op12_ball_kmeans"),
    "op13_rule_ensemble": ("rule_ensemble", "op13_rule_ensemble"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), function) for name, (module, function) in _QUERIES.items()}


#: The exact sets, links and components, by joining all shingles.
_NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
links AS (
  SELECT a.r AS a, b.r AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r
  GROUP BY a.r, b.r
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM sizes x WHERE x.r = a.r) + (SELECT n FROM sizes y WHERE y.r = b.r) - count(*))
), reach AS (
  SELECT a AS r, b AS o FROM links
  UNION
  SELECT reach.r, links.b FROM reach JOIN links ON reach.o = links.a
), named AS (
  SELECT words.r, words.doc_id, coalesce(min(other.doc_id), words.doc_id) AS low
  FROM words LEFT JOIN reach ON reach.r = words.r LEFT JOIN words other ON other.r = reach.o
  GROUP BY words.r, words.doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(low, doc_id) AS component_id, least(low, doc_id) = doc_id AS kept
FROM named LEFT JOIN sizes USING (r)
"""

#: The windows of 200 bytes that occur again, as hexadecimal digits, by grouping all of them.
_REPEATED = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), starts AS (
  SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS h
  FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM texts WHERE length(x) >= 400)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM starts) WHERE n > 1
), runs AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b
  FROM (SELECT r, i, sum(CASE WHEN i > last + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g
        FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i) AS last FROM again))
  GROUP BY r, g
), gaps AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t FROM runs
  UNION ALL
  SELECT r, max(b), NULL FROM runs GROUP BY r
), kept AS (
  SELECT r, string_agg(substr(x, 2 * f + 1, 2 * coalesce(t, length(x) // 2) - 2 * f), '' ORDER BY f) AS k
  FROM gaps JOIN texts USING (r) GROUP BY r
), removed AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM texts LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""


#: Cuts and forms from the hash of doc_id, and both digests.
_FILL_IN_MIDDLE = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), cuts AS (
  SELECT doc_id, t, n, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS b,
         ('0x' || substr(x, 17, 8))::BIGINT % 100 AS plain, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS first FROM h
), forms AS (
  SELECT *, least(a, b) AS p, abs(a - b) AS m,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR plain >= 90 THEN 'plain' WHEN first < 20 THEN 'spm' ELSE 'psm' END AS form FROM cuts
), parts AS (SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, m) AS middle, substr(t, p + m + 1) AS suffix FROM forms)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def _ball_kmeans(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, each round's tables named by its number."""
    parts = [
        """vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c
  FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM vectors ORDER BY h, v LIMIT {k})
)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, cluster := cluster)) AS best
  FROM (SELECT r, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM vectors, c{i}) GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""m{i} AS MATERIALIZED (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT best.cluster AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{i} JOIN vectors USING (r), range(1, 65) AS p(i) GROUP BY ALL) GROUP BY cluster
)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN vectors USING (r) JOIN c{rounds} ON c{rounds}.cluster = best.cluster
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others train models, draw or write files."""
    return {"op5_near_dedup": _NEAR_DEDUP, "op6_repeated_substrings": _REPEATED, "op11_fill_in_middle": _FILL_IN_MIDDLE, "op12_ball_kmeans": _ball_kmeans()}
