"""Nulls in every column, clashing names, empty pipelines, and small parts instead of large ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinelake.llm import ball_kmeans, decontam, fim, html_text, langid, lm_score, mixing, near_dedup, order_minhash, suffix_dedup, token_files, toxicity
from kinelake.llm._common import hot_join, rows_of, shared_folder, table
from kinelake.llm.queries import queries

#: A column of every name that an operator makes, beside those of documents.
CLASHES = ["size", "key", "score", "node", "kept", "spans", "_row", "_h", "_bucket", "_shard", "block", "p", "n", "held", "train", "label", "text_", "item_ids", "_items", "_c0", "_text", "_salt", "part"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def documents():
    rng = random.Random(11)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rows = []
    for i in range(40):
        text = " ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(1, 90)))
        rows.append((i, text, rng.choice(["en", "fr"]), rng.choice("ab")))
    base = " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(80))
    for i in range(40, 60):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(None, base, None, None), (None, None, None, "a"), (None, "", "en", None), (70, None, None, None), (71, "word " * 3000, None, "b"), (3, rows[3][1], "en", "a"), (3, "another text under the same id as before", "fr", "b")]
    return [(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASHES)) for r in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edges"))
    docs = documents()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    item = docs[2][1]
    spark.createDataFrame([(1, item), (None, "alpha"), (2, None), (3, docs[45][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, None, i % 3 == 0) for i in range(50)] + [(None, 1, True), (5, 0, None)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int")).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, None, None), (1, "x", "<p>t"), (1, "x", "<p>t"), (2, None, "<div><div>")], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    vectors = [(i, [0.1 * ((i * 7 + k) % 11 - 5) for k in range(64)]) for i in range(50)] + [(None, [0.5] * 64), (3, [0.5] * 64), (60, None), (61, [None] * 64), (62, [0.5] * 63)]
    spark.createDataFrame([(*r, 1, *["x"] * 4) for r in vectors], "vec_id long, embedding array<float>, label int, v string, cluster string, distance string, turn string").write.parquet(f"{folder}/embeddings.parquet")
    return folder


#: Vectors of the table that are whole.
WHOLE_VECTORS = 52


def collected(frame):
    names = sorted(frame.columns)
    flat = frame.select(*[F.to_json(F.array(c)).alias(c) if t.startswith(("array", "struct")) else F.col(c).cast("string").alias(c) for c, t in frame.dtypes])
    return sorted(tuple(str(r[c]) for c in names) for r in flat.collect())


@pytest.mark.parametrize("name", sorted(queries()))
def test_nulls_repeats_and_clashing_names(spark, tables, name):
    out = queries()[name](spark, tables)
    n = spark.read.parquet(f"{tables}/{'pages' if 'html' in name or 'extract' in name else 'documents'}.parquet").count()
    assert out.count() == (WHOLE_VECTORS if "kmeans" in name else n)


def test_stages_keep_the_columns_whatever_their_names(spark, tables):
    docs = table(spark, tables, "documents")
    names, step = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, tables)
        assert step.columns == names
        rows = step.collect()
        assert rows and all(r.size == "x" and r["_row"] == "x" and r.item_ids == "x" for r in rows)
        step = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, step, tables).count() == len(rows)


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


SMALL = {
    "op1_langid": [(langid, "BLOCK", 100)],
    "op2_decontaminate": [(decontam, "INDEX_BYTES", 40), (decontam, "BLOCK", 300), (decontam, "COMMON", 1), (decontam, "EXPANDED", 10)],
    "op5_near_dedup": [(near_dedup, "CHUNK", 4), (near_dedup, "HUB_PAIRS", 2), (near_dedup, "HUB_PARTS", 3), (near_dedup, "SLOTS", 64), (near_dedup, "BLOCK", 500)],
    "op6_repeated_substrings": [(suffix_dedup, "HOT", 2), (suffix_dedup, "PART_BYTES", 500), (suffix_dedup, "BLOCK", 700), (suffix_dedup, "SEGMENT", 600)],
    "op7_lm_score": [(lm_score, "BLOCK", 600)],
    "op8_mix_sources": [],
    "op9_toxicity": [],
    "op10_token_files": [(token_files, "FILE_IDS", 200), (token_files.WordEncoder, "MOST_WORDS", 5), (token_files.WordEncoder, "TOGETHER", 3), (token_files, "READ_IDS", 50), (token_files, "BLOCK", 300)],
    "op11_fill_in_middle": [(fim, "BLOCK", 50)],
    "op12_ball_kmeans": [(ball_kmeans, "ROWS", 3)],
    "op4_order_minhash": [(order_minhash, "RANGE_ROWS", 4), (order_minhash, "BROADCAST_RANGES", 0)],
}


@pytest.mark.parametrize("name", sorted(SMALL))
def test_results_do_not_depend_on_sizes(spark, tables, name, monkeypatch):
    want = queries()[name](spark, tables)
    # sums of floating-point numbers may differ in the last places
    drop = [c for c in ("score", "base_score", "bits_per_byte") if c in want.columns]
    rounded = [F.round(c, 6).alias(c) for c in drop]
    keep = [c for c in want.columns if c not in drop]
    want = collected(want.select(*keep, *rounded))
    for owner, attribute, value in SMALL[name]:
        monkeypatch.setattr(owner, attribute, value)
    monkeypatch.setattr(token_files, "_ENCODERS", {})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = queries()[name](spark, tables)
        assert collected(got.select(*keep, *rounded)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rows_of_bounds_rows_and_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * k for k in (1, 2, 50, 3, 0, 0, 0, 4)]})
    parts = list(rows_of([batch], 5, "text", 2))
    assert [p.num_rows for p in parts] == [2, 1, 2, 2, 1]
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()


def test_hot_join_is_a_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 30), (None, 31)], "k int, i int")
    one = spark.createDataFrame([(1, "one"), (3, "three")], "k int, v string")
    assert hot_join(rows, one, "k", "i").count() == 30
    left = hot_join(rows, one, "k", "i", "left").collect()
    assert len(left) == 32 and sum(r.v == "one" for r in left) == 30


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        shared_folder(Session)


def test_modules_import_without_a_session():
    assert html_text.Page("").best() is None and mixing.WEIGHTS == (5, 2, 1)
    assert np.isfinite(toxicity.norms(np.arange(15))).all()


def test_one_doc_id_is_dealt_over_ranges_of_token_files(spark):
    rows = [(7, f"text {i}") for i in range(3000)] + [(None, f"none {i}") for i in range(3000)] + [(i, "same") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = token_files.in_ranges(docs)
    sizes = [r["count"] for r in got.groupBy("part").count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 4500
    spans = got.groupBy("part").agg({"doc_id": "min", "text": "count"}).orderBy("part").collect()
    firsts = [r["min(doc_id)"] for r in spans if r["min(doc_id)"] is not None]
    assert firsts == sorted(firsts)
