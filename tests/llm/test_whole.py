"""Cases that earlier versions of the training-data operators cut short."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.llm import decontam, html_text, langid, mixing, near_dedup


def shingle_similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_the_stage_links_from_80_percent(spark):
    rng = random.Random(3)
    rows, pairs = [], []
    for i in range(0, 40, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        other = list(words)
        for at in (20, 60):
            other[at] = "changed"
        a, b = " ".join(words), " ".join(other)
        assert 0.80 <= shingle_similarity(a, b) < 0.85
        rows += [(i, a), (i + 1, b)]
        pairs.append(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.keep_one_of_each(spark, docs, "").collect()}
    assert kept == set(pairs)
    assert near_dedup.near_duplicates(docs, near_dedup.PERCENT).filter("kept").count() == len(rows)


def test_banding_misses_few_pairs_at_the_threshold():
    assert near_dedup.banding(85) == (32, 8)
    for percent in (80, 85):
        bands, rows = near_dedup.banding(percent)
        assert bands * rows <= near_dedup.HASHES
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.BAND_MISS


def mixed_sources(spark, folder):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 200))), "abc"[i // 100], i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").coalesce(1)
    docs.write.parquet(f"{folder}/documents.parquet")
    return rows, spark.read.parquet(f"{folder}/documents.parquet")


def test_op8_draws_counts_by_shard_and_fills_every_slot_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    monkeypatch.setattr(mixing, "SHARD_GROUP", 4)
    rows, docs = mixed_sources(spark, tmp_path)
    light, targets, sequence = mixing.mixed(docs)
    counts = {(r._shard, r._s): r._count for r in mixing.shard_counts(targets).collect()}
    shards = sorted({s for s, _ in counts})
    assert all(sum(n for (s, _), n in counts.items() if s == shard) == 64 for shard in shards[:-1])
    # drawn counts: each shard mixes all sources, and they differ by shard
    assert len(shards) > 5 and all((s, x) in counts for s in shards[:-1] for x in "abc")
    assert len({counts[s, "a"] for s in shards[:-1]}) > 2
    of = {r._row: (r.doc_id, r.source, r.size) for r in light.collect()}
    filled, words, sources = {}, {}, {}
    for r in sequence.collect():
        doc, source, size = of[r._row]
        assert 0 <= r.lo and r.n > 0 and r.lo + r.n <= size
        filled[r._slot] = filled.get(r._slot, 0) + r.n
        words[doc] = words.get(doc, 0) + r.n
        assert sources.setdefault(r._slot, source) == source
    assert max(filled.values()) <= mixing.BLOCK_WORDS
    drawn = {}
    for slot, source in sources.items():
        drawn[slot // 64, source] = drawn.get((slot // 64, source), 0) + 1
    assert drawn == counts
    got = {r.doc_id: r.taken for r in mixing.op8_mix_sources(spark, str(tmp_path)).collect()}
    assert got == {r[0]: words.get(r[0], 0) for r in rows}


def test_the_mixing_stage_interleaves_sources(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    _, docs = mixed_sources(spark, tmp_path)
    out = mixing.mix_documents(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    for part in out.rdd.map(lambda r: r.source).glom().collect():
        if len(part) > 40:
            assert sum(a != b for a, b in zip(part, part[1:])) > len(part) / 8


def test_the_sequential_test_misses_what_it_says_over_all_looks():
    for percent in (80, 85):
        t, batch = percent / 100, near_dedup.BATCH
        alive = {0: 1.0}
        for least in near_dedup.least_matches(percent):
            after = {}
            for m, p in alive.items():
                for k in range(batch + 1):
                    after[m + k] = after.get(m + k, 0.0) + p * math.comb(batch, k) * t**k * (1 - t) ** (batch - k)
            alive = {m: p for m, p in after.items() if m >= least}
        assert 1 - sum(alive.values()) <= near_dedup.MISS


def test_the_language_stage_keeps_texts_that_several_languages_share(spark):
    rows = [(i, "uno due tre quattro cinque sei", "abc"[i % 3]) for i in range(60)] + [(60, "12 !?", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs.filter(langid.remainder("doc_id", 3) != 1)), ["doc_id"])
    assert found.filter("lang_pred <> 'und' and score < 0.5").count() == 60
    assert {r.doc_id for r in langid.keep_identified(spark, docs, "").collect()} == set(range(60))


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar x", "elementor-widget-container"])
def test_a_compound_name_does_not_hide_the_article(name):
    article = "<p>" + "The article goes on. " * 20 + "</p>"
    page = html_text.Page(f"<body><div class='{name}'><div class='entry'>{article}</div><div class='sidebar'>Links</div><div class='widget-area'>More</div></div><p>Imprint</p></body>")
    assert page.text([page.best()]) == ("The article goes on. " * 20).strip()


@pytest.mark.parametrize("name", ["sidebar", "comments", "comment-list", "site-nav"])
def test_boilerplate_names_still_hide(name):
    long = "Readers say much more. " * (20 if name != "site-nav" else 1)
    page = html_text.Page(f"<body><article><p>Short article, but the article.</p><div class='{name}'><p>{long}</p></div></article></body>")
    assert page.text([page.best()]) == "Short article, but the article."


def test_the_mixing_stage_doesn_t_depend_on_how_its_table_is_split(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i % 550, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 120))), "ab"[i % 2], i) for i in range(600)]
    rows += [rows[0], rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = sorted(map(tuple, mixing.mix_documents(spark, docs, str(tmp_path)).collect()), key=repr)
    try:
        out = mixing.mix_documents(spark, docs, str(tmp_path))  # written parts of the plan are made here
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = sorted(map(tuple, out.collect()), key=repr)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want and len(got) > 400


def test_the_mixing_stage_takes_tables_that_are_no_scan(spark, tmp_path):
    rows, docs = mixed_sources(spark, tmp_path)
    made = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    a, b = (sum(len(r.text.split()) for r in mixing.mix_documents(spark, d, str(tmp_path)).collect()) for d in (docs, made))
    assert abs(a - b) <= 10 * mixing.BLOCK_WORDS


def test_copies_don_t_multiply_pairs_when_every_slot_is_taken(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SLOTS", 64)
    monkeypatch.setattr(near_dedup, "MOST_SLOTS", 64)
    words = [f"w{i}" for i in range(120)]
    one, other = " ".join(words), " ".join([*words[:-2], "x", "y"])
    rows = [(i, one) for i in range(1000)] + [(1000 + i, other) for i in range(1000)] + [(3000 + i, " ".join(f"q{i}_{k}" for k in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = near_dedup.node_sets(docs, docs.select(F.col("doc_id").alias("low")), 2300)
    assert sets.count() == 302
    joined = []
    whole = near_dedup.confirmed

    def counted(pairs, sets_, percent):
        out = whole(pairs, sets_, percent)
        joined.append(pairs.join(sets_.select(F.col("node").alias("a")), "a").join(sets_.select(F.col("node").alias("b")), "b").count())
        return out

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 85).collect()}
    assert joined[0] == 1
    assert all(found[i] == 0 for i in range(2000)) and all(found[3000 + i] == 3000 + i for i in range(300))


@pytest.mark.parametrize("set_chunk", [None, 3000])
def test_alike_texts_that_are_no_links_make_no_rows_for_each_pair(spark, monkeypatch, set_chunk):
    """150 texts begin alike and end apart, every two of them 79 % alike; some have kin that is linked."""
    if set_chunk:
        monkeypatch.setattr(near_dedup, "SET_CHUNK", set_chunk)
    base = [f"w{i}" for i in range(200)]
    texts = [[*base, *(f"t{i}_{k}" for k in range(26))] for i in range(150)]
    for i in range(12):  # kin of kin: the first and the last of four are no link
        for step in (8, 16, 24):
            texts.append([*texts[i][:226 - step], *(f"k{i}_{k}_{step}" for k in range(step))])
    texts = [" ".join(t) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    component = list(range(len(texts)))
    linked = [(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert 30 < len(linked) < 150 and sum(100 * len(sets[0] & s) >= 78 * len(sets[0] | s) for s in sets) > 140
    for _ in texts:
        for a, b in linked:
            component[a] = component[b] = min(component[a], component[b])
    counts, whole = [], near_dedup.written

    def counted(df, name):
        out = whole(df, name)
        counts.append((name, out.count()))
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 80).collect()}
    assert found == dict(enumerate(component))
    bands, _ = near_dedup.banding(80)
    assert max(n for _, n in counts) <= bands * len(texts)
    assert sum(n for name, n in counts if name == "links2") <= 2 * len(linked)


def test_the_bitmap_is_that_of_its_slots(spark):
    slots = sorted(random.Random(2).sample(range(1 << 18), 3000))
    got = near_dedup.slot_bitmap(spark.createDataFrame([(s,) for s in slots + slots[:50]], "slot long"), 1 << 18)
    assert np.flatnonzero(np.unpackbits(got)).tolist() == slots


def test_items_with_one_preamble_stay_in_bounds():
    """30,000 items that begin alike, and a text that says the beginning again and again."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    preamble = "answer the following question as well as you can: "
    items = [preamble + " ".join(word() for _ in range(12)) for _ in range(30_000)]
    index = decontam.ItemIndex(list(range(len(items))), items)
    texts = [preamble * 40 + " ".join(word() for _ in range(600)) for _ in range(300)]
    held = {3: 17, 120: 29_999, 299: 4}
    for t, i in held.items():
        texts[t] += items[i][:60] + "x" + items[i][61:]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    assert len(data) > 1 << 20
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    tracemalloc.start()
    got = index.matches(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20
    assert {t: s for t, s in enumerate(got) if s} == {t: {i} for t, i in held.items()}


@pytest.mark.parametrize("expanded", [1, 50, 1 << 20])
def test_common_grams_left_out_miss_nothing(expanded, monkeypatch):
    """Items that are nearly equal, and equal ones, against the true edit distance."""
    monkeypatch.setattr(decontam, "COMMON", 2)
    monkeypatch.setattr(decontam, "EXPANDED", expanded)
    rng = random.Random(8)
    base = "the quick brown fox jumps over the lazy dog and runs far away into the dark wood"
    items = [base + " number " + str(i) * 3 for i in range(8)] + [base, base, "another item that has nothing in common with them at all, really"]
    index = decontam.ItemIndex(list(range(len(items))), items)
    texts = []
    for _ in range(25):
        t = list(rng.choice(items))
        for _ in range(rng.randrange(0, 7)):
            p = rng.randrange(len(t))
            t[p : p + rng.randrange(2)] = rng.choice(["", "z", "zz"])
        texts.append("before " + "".join(t) + " after")
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = index.matches(data, np.r_[0, np.cumsum([len(t) for t in texts])])

    def stretch_distance(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    for text, ids in zip(texts, got, strict=True):
        assert ids == {i for i, item in enumerate(items) if stretch_distance(item, text) <= decontam.budget(len(item))}
