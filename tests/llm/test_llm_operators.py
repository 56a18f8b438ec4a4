"""The training-data operators on small tables with nulls, empty and long texts,
repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.llm import decontam, html_text, langid, lm_score, mixing, near_dedup, order_minhash, suffix_dedup, token_files, toxicity
from kinelake.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, score string, node string, kept string, spans string"


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def made_documents():
    rng = random.Random(5)
    en = "the and of to in that is was for with house water people think small great".split()
    fr = "le la et des les une dans pour avec maison grand être déjà où très peuple".split()
    line = "this line is shared by very many documents and it is long enough to be a passage that repeats in all of them because it has more than two hundred bytes in it so that every window of it is found elsewhere too"
    texts = []
    for i in range(60):
        vocabulary, lang = (fr, "fr") if i % 3 == 0 else (en, "en")
        words = [rng.choice(vocabulary) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randrange(3, 160))]
        text = " ".join(words)
        if i % 4 == 0:
            text += "\n" + line + " " + str(i)
        texts.append((text, lang))
    base = " ".join(rng.choice(en) + str(rng.randrange(50)) for _ in range(150))
    for i in range(8):
        w = base.split()
        for _ in range(i):
            w[rng.randrange(len(w))] = "changed"
        texts.append((" ".join(w), "en"))
    texts += [(base, "en"), (base, "en"), ("", None), (None, None), ("   \n", "en"), ("123 !!", None), ("one two", "en"), ("one two", "fr"), ("é" * 30, "fr"), ("word " * 20_000, "en"), ("x" * 70_000, None)]
    rows = [(i, t, lang, None if i % 7 == 0 else f"s{i % 4}", len(t) if t else 0, 1, "k", "s", "n", None, "") for i, (t, lang) in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = made_documents()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    item = next(r[1] for r in docs if r[1] and len(words_of(r[1])) > 60)
    bench = [(1, " ".join(item.split()[5:45])), (2, None), (3, ""), (4, "not in any document at all, this one, is it?"), (5, "water people")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 5 == 0)) for r in docs[:60]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(0, "http://a.example/1", "<html><body><nav>Menu</nav><div class='ad'>Buy</div><article><h1>T &amp; U</h1><p>One  <b>two</b>three<p>four</article><footer>f</footer></body>"), (1, None, None), (2, "nonsense", ""), (3, "http://a.example/2", "<p>bare text"), (4, "http://a.example/1", "<script>if (a<b && c=='x) x<p>y</script><div id=main><p>Hello</p><div class=comments>no</div></div>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs():
    return made_documents()


def run(spark, tables, name):
    return queries()[name](spark, tables).toPandas()


def by_id(frame, docs):
    """Rows by doc_id; the repeated row must give equal results."""
    assert len(frame) == len(docs)
    return frame.drop_duplicates("doc_id").set_index("doc_id")


def test_langid(spark, tables, docs):
    got = by_id(run(spark, tables, "op1_langid"), docs)
    for doc_id, text, lang, *_ in docs:
        r = got.loc[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if not text or not any(c.isalpha() for c in text):
            assert r.lang_pred == "und" and r.score == 0
        elif len(text) > 100 and lang and "word word" not in text:
            assert r.lang_pred == lang


def test_code_lengths_are_those_of_the_escape_chain():
    model = langid.PpmModel({"a": ["abracadabra"], "b": ["banana"]}, order=2)
    count = {x: [collections.Counter() for _ in range(3)] for x in "ab"}
    for x, t in (("a", "abracadabra"), ("b", "banana")):
        t = "\n\n" + t
        for k in range(3):
            for i in range(k, len(t)):
                count[x][k][t[i - k : i + 1]] += 1

    def bits(x, context, symbol):
        for k in range(2, -1, -1):
            c = context[len(context) - k :]
            seen = {g: n for g, n in count[x][k].items() if g[:-1] == c}
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if c + symbol in seen:
                return escaped[0] - math.log2(seen[c + symbol] / (n + d))
            escaped[0] -= math.log2(d / (n + d))
        return escaped[0] + 8

    data = np.frombuffer(b"cabana", np.uint8)
    got = model.code_lengths(data, np.array([0, 6]))[0]
    for i, x in enumerate("ab"):
        want, text = 0.0, "\n\ncabana"
        for j in range(2, len(text)):
            escaped = [0.0]
            want += bits(x, text[j - 2 : j], text[j])
        assert got[i] == pytest.approx(want, rel=1e-5)


def test_code_lengths_do_not_depend_on_blocks(monkeypatch):
    model = langid.PpmModel({"a": ["abracadabra and more of it"], "b": ["banana split, one or two"]})
    texts = ["abracadabra banana " * 9, "", "x", "", "more of it", ""]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = np.vstack([model.code_lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in raw])
    for block in (1, 3, 50, 1 << 20):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert model.code_lengths(data, at) == pytest.approx(whole, abs=1e-3)


def test_a_language_of_long_texts_is_learned_and_ties_go_to_the_first(spark):
    rows = [(i, "uno due tre quattro " * 5000, "it") for i in range(3)] + [(i, "eins zwei drei vier", "de") for i in range(10, 20)] + [(i, "same words here", "b" if i % 2 else "a") for i in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ["a", "b", "de", "it"]
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, model, ["doc_id"]).collect()}
    assert found[0] == "it" and found[10] == "de"
    same = langid.PpmModel({"b": ["tie"], "a": ["tie"]})
    assert same.langs[same.predict(np.frombuffer(b"tie", np.uint8), np.array([0, 3]))[0][0]] == "a"


def test_decontamination(spark, tables, docs):
    got = by_id(run(spark, tables, "op2_decontaminate"), docs)
    item = next(r[1] for r in docs if r[1] and len(words_of(r[1])) > 60)
    passage = " ".join(item.split()[5:45])
    for doc_id, text, *_ in docs:
        want = {k for k, p in ((1, passage), (5, "water people")) if text and p in " ".join(text.lower().split(" ")).replace("\n", " ")}
        assert set(got.loc[doc_id].item_ids) == want
        assert got.loc[doc_id].contaminated == bool(want)


def test_edited_passages_within_the_budget_are_found():
    rng = random.Random(3)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(40))
    index = decontam.ItemIndex([7], [item])
    noise = " ".join("".join(rng.choice("mnopq") for _ in range(5)) for _ in range(50))
    most = decontam.budget(len(item))
    for edits in range(most + 1):
        t = list(item)
        for _ in range(edits):
            at = rng.randrange(len(t))
            kind = rng.randrange(3)
            if kind == 0:
                t[at] = "z"
            elif kind == 1:
                t.insert(at, "z")
            else:
                del t[at]
        data = (noise + "".join(t) + noise).encode()
        assert index.matches(np.frombuffer(data, np.uint8), np.array([0, len(data)])) == [{7}]
    data = noise.encode()
    assert index.matches(np.frombuffer(data, np.uint8), np.array([0, len(data)])) == [set()]


def least_edits(item, text):
    """Edits between the item and the stretch of the text that is nearest."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.r_[i, np.minimum(row[:-1] + np.array([x != c for x in text], int), row[1:] + 1)]
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return row.min()


@pytest.mark.parametrize("letters,window", [("abcdefgh", 1 << 16), ("ab", 1 << 16), ("a", 1 << 16), ("abcd", 40)])
def test_matches_are_those_of_the_true_edit_distance(letters, window, monkeypatch):
    monkeypatch.setattr(decontam, "WINDOW", window)
    monkeypatch.setattr(decontam, "BANDS_AT_ONCE", 5)
    rng = random.Random(4)
    some = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    items = [some(n) for n in (20, 60, 77, 110)]
    index = decontam.ItemIndex([0, 1, 2, 3], items)
    texts = [some(300), "", some(15)]
    for item in items:
        for edits in range(decontam.budget(len(item)) + 4):
            t = list(item)
            for _ in range(edits):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice(["z", "", "zz"])
            texts.append(some(rng.randrange(120), letters + "z") + "".join(t) + some(rng.randrange(120)))
    raw = [t.encode() for t in texts]
    got = index.matches(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [{i for i, item in enumerate(items) if least_edits(item, t) <= index.budget[i]} for t in texts]
    assert got == want
    if len(letters) > 2:
        assert any(0 < len(w) for w in want) and any(not w for w in want[3:])


def test_repetitive_texts_take_little_time_and_memory():
    index = decontam.ItemIndex([1, 2], ["a" * 4000, "ab" * 1500 + "c" * 200])
    text = b"a" * 60_000 + b"ab" * 20_000
    began = time.process_time()
    assert index.matches(np.frombuffer(text, np.uint8), np.array([0, len(text)])) == [{1}]
    assert time.process_time() - began < 60


def test_the_clean_stage_allows_any_column_names(spark, tables):
    rows = spark.createDataFrame([(1, "nothing of it", "x", [1]), (2, None, "y", [])], "doc_id long, text string, _text string, item_ids array<int>")
    assert sorted(decontam.keep_clean(spark, rows, tables).collect(), key=lambda r: r.doc_id) == rows.collect()


def test_html(spark, tables):
    got = run(spark, tables, "op3_extract_main_text").set_index("page_id")
    assert got.loc[0].text == "T & U One twothree four"
    assert got.loc[1].text == "" and got.loc[2].text == ""
    assert got.loc[3].text == "bare text"
    assert got.loc[4].text == "Hello"
    assert (got.n_chars == got.text.str.len()).all()


def test_order_minhash(spark, tables, docs):
    frame = run(spark, tables, "op4_order_minhash")
    got = by_id(frame, docs)
    order = sorted(docs, key=lambda r: (-r[0], r[1] or ""))
    for (doc_id, text, *_), after in zip(order, order[1:] + order[:1], strict=True):
        if doc_id in (3, 4):
            continue  # the repeated row has two neighbours
        text, other = text or "", after[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got.loc[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == (1.0 if text == other else r.near_next) and 0 <= r.near_edited <= 1
    same = frame.assign(text=frame.doc_id.map({r[0]: r[1] or "" for r in docs})).groupby("text").fingerprint.nunique()
    assert (same == 1).all()


@pytest.mark.parametrize("rows_of_range,quantiles,broadcast", [(3, 2, 1 << 16), (2, 4, 0), (1, 64, 1 << 16), (100, 5, 0)])
def test_neighbours_over_many_ranges(spark, monkeypatch, rows_of_range, quantiles, broadcast):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", rows_of_range)
    monkeypatch.setattr(order_minhash, "QUANTILES", quantiles)
    monkeypatch.setattr(order_minhash, "BROADCAST_RANGES", broadcast)
    rng = random.Random(9)
    ids = sorted({rng.randrange(10) for _ in range(6)} | {10**12 + rng.randrange(5000) for _ in range(20)} | {-(10**15), 2**62}, reverse=True)
    texts = {i: " ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(rng.randrange(0, 30))) for i in ids}
    rows = [(i, texts[i]) for i in ids] + [(None, "zero"), (None, None)]
    rng.shuffle(rows)
    got = order_minhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    line = [(i, texts[i]) for i in ids] + [(None, ""), (None, "zero")]
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, r)
    share = lambda a, b: 1.0 if a == b else sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / order_minhash.BINS
    for (i, text), (after, other) in zip(line[:-2], line[1:-1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert prints[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints[i].near_edited == pytest.approx(share(prints[i].fingerprint, prints[i].edited_fingerprint))
        if after is not None:
            assert prints[i].near_next == pytest.approx(share(prints[i].fingerprint, prints[after].fingerprint))
    last = [r for r in got if r.doc_id is None and r.n_chars == 4]
    assert last[0].edited_sha256 == hashlib.sha256(("ze" + line[0][1][:2]).encode()).hexdigest()


def test_places_beyond_the_packed_bits_share_the_last_one(spark):
    row = spark.range(1).select(order_minhash._pack(F.lit(-1).cast("long"), F.lit(order_minhash.PLACE + 5)).alias("x"), order_minhash._pack(F.lit(-1).cast("long"), F.lit(3)).alias("y")).first()
    assert row.x & order_minhash.PLACE == order_minhash.PLACE and row.x >> 24 == row.y >> 24 == 2**39 - 1


def brute_signature(spark, text):
    """Order MinHash by explicit loops, with the hashes of the DataFrame functions."""

    words = WORD.findall(text)
    k = order_minhash.K
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)]
    hashed = {}
    if len(words) < k:
        return None
    frame = spark.createDataFrame([(g,) for g in set(grams)], "g array<string>")
    for r in frame.select("g", F.shiftrightunsigned(F.xxhash64(*[F.get("g", F.lit(i)) for i in range(k)]), 25).alias("h")).collect():
        hashed[tuple(r.g)] = r.h
    seen, elements = collections.Counter(), []
    for i, g in enumerate(grams):
        elements.append((hashed[g], seen[g], i))
        seen[g] += 1
    repeats = [e for e in elements if e[1]]
    if repeats:
        frame = spark.createDataFrame([(h, o - 1, i) for h, o, i in repeats], "h long, o int, i int")
        renewed = {r.i: r.x for r in frame.select("i", F.shiftrightunsigned(F.xxhash64("h", "o"), 25).alias("x")).collect()}
        elements = [(renewed.get(i, h), o, i) for h, o, i in elements]
    best = {}
    for h, _, i in sorted((h, o, i) for h, o, i in elements):
        best.setdefault(h >> 33, (h, i))
    full = sorted(best)
    dense = [best[min((b for b in full if b >= t), default=full[0])] for t in range(order_minhash.BINS)]
    pairs = []
    for t in range(order_minhash.BINS):
        a, b = dense[t], dense[(t + 1) % order_minhash.BINS]
        pairs.append((t, a[0], b[0]) if a[1] <= b[1] else (t, b[0], a[0]))
    frame = spark.createDataFrame(pairs, "t int, a long, b long").select("t", F.lpad(F.hex(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFF))), 4, "0").alias("x"))
    return "".join(r.x for r in frame.orderBy("t").collect())


def test_signature_by_brute_force(spark):

    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(n)) for n in (3, 5, 40, 300)] + [" ".join(str(rng.random()) for _ in range(200))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", order_minhash.signature(F.col("t")).alias("s")).collect()
    for r in got:
        assert r.s == brute_signature(spark, r.t)


def test_near_dedup(spark, tables, docs):
    got = by_id(run(spark, tables, "op5_near_dedup"), docs)
    sets = {}
    for doc_id, text, *_ in docs:
        w = words_of(text)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    component = {i: i for i in sets}

    def find(a):
        while component[a] != a:
            a = component[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                component[max(x, y)] = min(x, y)
    for i, s in sets.items():
        assert (got.loc[i].n_shingles, got.loc[i].component_id, got.loc[i].kept) == (len(s), find(i), find(i) == i)


def test_least_matches_bound_the_miss_probability():
    least = near_dedup.least_matches()
    assert least == sorted(least) and least[-1] < 0.85 * near_dedup.HASHES


def test_repeated_substrings(spark, tables, docs):
    frame = run(spark, tables, "op6_repeated_substrings")
    raw = [(r[1] or "").encode() for r in docs]
    seen = collections.Counter(t[a : a + 200] for t in raw for a in range(len(t) - 199))
    want = collections.Counter()
    for (doc_id, *_), t in zip(docs, raw, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - 199):
            if seen[t[a : a + 200]] > 1:
                gone[a : a + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        want[(doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert collections.Counter(frame[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == want


def test_maximal_repeats_have_all_occurrences():
    a, b = b"x" + b"abcdefgh" * 30 + b"y", b"q" + b"abcdefgh" * 30 + b"z"
    groups = list(suffix_dedup.maximal_repeats([a, b], 200))
    assert (240, [(0, 1), (1, 1)]) in [(n, sorted(places)) for n, places in groups]
    assert suffix_dedup.interval_nodes([0, 5, 3, 5, 0], 3) == [(5, 0, 1), (5, 2, 3), (3, 0, 3)]


def test_lm_score(spark, tables, docs):
    got = by_id(run(spark, tables, "op7_lm_score"), docs)
    train = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    count = collections.Counter(w for r in train for w in [*words_of(r[1]), "\0end"])
    n, v = sum(count.values()), len(count)
    for doc_id, text, *_ in docs:
        t = [*words_of(text), "\0end"]
        r = got.loc[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    known = got[got.held_out]
    assert known.score.sum() > known.base_score.sum()


def brute_force_lm(docs, held_part=None):
    """Counts of tokens, pairs and contexts by plain dictionaries."""
    one, two, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for r in docs:
        t = [*words_of(r[1]), "\0end"]
        h = ["\0start", *t[:-1]]
        one.update(t)
        two.update(zip(h, t))
        ctx.update(h)
    return one, two, ctx


def test_lm_scores_against_brute_force_at_any_batch_size(spark, tables, docs, monkeypatch):
    train = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    one, two, ctx = brute_force_lm(train)
    n, v = sum(one.values()), len(one)
    rng = np.random.default_rng(3)
    weights = rng.dirichlet([1, 1, 1], lm_score.BUCKETS)
    monkeypatch.setattr(lm_score, "fit_weights", lambda *_: weights.copy())
    monkeypatch.setattr(lm_score, "BLOCK", 20_000)

    def expected(text):
        total, before = 0.0, "\0start"
        for w in [*words_of(text), "\0end"]:
            l0, l1, l2 = weights[math.ceil(math.log2(ctx[before] + 1))]
            total += math.log10(l2 * two[before, w] / max(ctx[before], 1) + l1 * one[w] / n + l0 / (v + 1))
            before = w
        return total

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for rows in ("7", "10000"):
        spark.conf.set(key, "3")
        query = queries()["op7_lm_score"](spark, tables)
        spark.conf.set(key, rows)
        got = by_id(query.toPandas(), docs)
        spark.conf.unset(key)
        for doc_id, text, *_ in docs:
            assert got.loc[doc_id].score == pytest.approx(expected(text), rel=1e-9)


def test_lm_weights_come_from_held_out_counts(spark, tables, docs, monkeypatch):
    seen = {}
    fit = lm_score.fit_weights
    monkeypatch.setattr(lm_score, "fit_weights", lambda *a: seen.setdefault("weights", fit(*a)))
    learn = lm_score.learn_weights
    monkeypatch.setattr(lm_score, "learn_weights", lambda *a: seen.setdefault("given", a) and learn(*a))
    monkeypatch.setattr(lm_score, "STEPS", 16)
    queries()["op7_lm_score"](spark, tables)
    held = {r.doc_id for r in spark.range(100).selectExpr("id AS doc_id", "pmod(xxhash64('held', id), 8) = 0 AS h").filter("h").collect()}
    train = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    main, out = [r for r in train if r[0] not in held], [r for r in train if r[0] in held]
    assert main and out
    one, two, ctx = brute_force_lm(main)
    want = collections.Counter()
    for r in out:
        before = "\0start"
        for w in [*words_of(r[1]), "\0end"]:
            want[math.ceil(math.log2(ctx[before] + 1)), two[before, w] > 0, one[w] > 0] += 1
            before = w
    bucket, r2, r1, r0, times = seen["given"]
    got = collections.Counter()
    for b, x, y, t in zip(bucket, r2, r1, times):
        got[int(b), bool(x > 0), bool(y > 0)] += int(t)
    assert got == want
    assert seen["weights"].sum(1) == pytest.approx(np.ones(lm_score.BUCKETS))


def test_lm_without_training_documents_is_uniform(spark):
    rows = spark.createDataFrame([(1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(rows, F.lit(False)).collect()}
    assert got[1].n_tokens == 3 and got[1].score == pytest.approx(0.0) and got[None].n_tokens == 1


def test_weights_maximise_the_held_out_likelihood():
    rng = np.random.default_rng(0)
    bucket = np.full(400, 5)
    r2, r1 = rng.random(400) * 0.5, rng.random(400) * 0.05
    times = rng.integers(1, 9, 400).astype(float)
    w = lm_score.learn_weights(bucket, r2, r1, 1e-4, times, 300)[5]
    value = lambda w: (times * np.log(w[0] * 1e-4 + w[1] * r1 + w[2] * r2)).sum()
    assert w.sum() == pytest.approx(1)
    for _ in range(50):
        assert value(w) >= value(rng.dirichlet([1, 1, 1])) - 1e-3


def test_mixing(spark, tables, docs):
    frame = run(spark, tables, "op8_mix_sources")
    assert len(frame) == len(docs)
    size = collections.Counter()
    for r in docs:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * size[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in full}
        left -= sum(3 * size[s] for s in full)
        open_ -= full
    source = {r[0]: r[3] for r in docs}
    frame["source"] = frame.doc_id.map(source)
    assert (frame.taken <= 3 * frame["size"]).all() and (frame.taken >= 0).all()
    for s, part in frame.groupby(frame.source.fillna("<null>")):
        s = None if s == "<null>" else s
        assert (part.source_size == size[s]).all()
        assert part.target.iloc[0] == pytest.approx(target[s])
        assert abs(part.taken.sum() - target[s]) <= 3 * mixing.BLOCK_WORDS
    again = run(spark, tables, "op8_mix_sources")
    columns = ["doc_id", "size", "taken"]
    assert frame[columns].sort_values(columns).values.tolist() == again[columns].sort_values(columns).values.tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100])
def test_permutation(spark, n):

    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long")).alias("x")).toPandas().x
    assert sorted(got) == list(range(n))


def test_toxicity_on_planted_words():
    rng = random.Random(2)
    clean_words = ["".join(rng.choice("aeiou" if i % 2 else "bdfglmnprst") for i in range(rng.randrange(3, 9))) for _ in range(400)]
    insults = ["zorgwax", "kluvvix"]

    def gapped(w):
        at = rng.randrange(2, len(w) - 1)
        return w[:at] + rng.choice(".*-") + w[at:] if rng.random() < 0.5 else w

    def text(toxic):
        w = [rng.choice(clean_words) for _ in range(60)]
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(60), gapped(rng.choice(insults)))
        return " ".join(w)

    train = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.SentenceKernelModel([t for t, _ in train], [y for _, y in train])
    test = [(text(i % 2), i % 2) for i in range(100)] + [("", 0)]
    data = "".join(t for t, _ in test).encode()
    at = np.cumsum([0, *[len(t.encode()) for t, _ in test]])
    got = model.score(np.frombuffer(data, np.uint8), at) >= 0.3
    assert (got == np.array([y for _, y in test], bool)).mean() > 0.95
    assert not got[-1]


def test_toxicity_query(spark, tables, docs):
    got = by_id(run(spark, tables, "op9_toxicity"), docs)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def kernel_map(window):
    """phi of a window, subsequence by subsequence."""
    out = collections.Counter()
    for i in range(len(window)):
        for j in range(i + 1, len(window)):
            for k in range(j + 1, min(len(window), i + toxicity.SPAN)):
                out[window[i], window[j], window[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def test_kernel_decisions_against_brute_force():
    texts = ["I.d i-o t lives here, in the Big house. So what?", "a", "", "Überraschung: 1d10t\nnext line of it is long enough", "жизнь хороша и долга, нет?"]
    raw = [t.encode() for t in texts]
    read = toxicity.Sentences(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    letters = {k: 96 for k in range(1, 27)}
    first = "".join(chr(x + letters[x]) if 0 < x < 27 else "|" for x in read.symbols[: read.end[0]])
    assert first == "idiotliveshereinthebighouse"
    assert "idiot" in "".join(chr(x + 96) if 0 < x < 27 else "|" for x in read.symbols)
    v = np.random.default_rng(0).normal(size=toxicity.SYMBOLS**3)
    sums = toxicity.by_span(read.symbols, toxicity.weight_tables(v))
    for width in toxicity.WINDOWS:
        begin, size, text = read.windows(width)
        assert set(text) == {0, 1, 3, 4}
        got = toxicity.decisions(sums, begin, size, 0.25)
        for b, n, value in zip(begin, size, got):
            window = read.symbols[b : b + n].tolist()
            assert 0 not in window
            g = math.sqrt(max(sum((j - 1) * max(n - j, 0) * toxicity.DECAY ** (2 * (j + 1)) for j in range(2, toxicity.SPAN)), toxicity.DECAY**6))
            want = sum(x * v[(p << 12) | (q << 6) | r] for (p, q, r), x in kernel_map(window).items()) / g + 0.25
            assert value == pytest.approx(want, abs=1e-3)


def test_nystroem_features_are_kernel_values():
    rng = np.random.default_rng(1)
    windows = rng.integers(1, 27, (12, 14)).astype(np.int32)
    windows[3, 9:] = 0
    maps = toxicity.Nystroem(windows)
    x = maps.features(windows)

    def scaled(w):
        w = [c for c in w.tolist() if c]
        g = math.sqrt(sum((j - 1) * max(len(w) - j, 0) * toxicity.DECAY ** (2 * (j + 1)) for j in range(2, toxicity.SPAN)))
        return {k: x / g for k, x in kernel_map(w).items()}

    maps_of = [scaled(w) for w in windows]
    kernel = [[sum(x * b.get(k, 0) for k, x in a.items()) for b in maps_of] for a in maps_of]
    assert x @ x.T == pytest.approx(np.array(kernel), abs=1e-3)


def test_long_texts_are_scored_in_pieces_as_a_whole(monkeypatch):
    rng = random.Random(8)
    lines = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(9)) for _ in range(60)]
    texts = ["\n".join(lines), "short", "no line ends " * 90, ""]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    model = toxicity.SentenceKernelModel([], [])
    model.v, model.link = np.random.default_rng(0).normal(size=toxicity.SYMBOLS**3), np.array([0.5, 0.5, 0.0, -0.1])
    want = model.score(data, at)
    monkeypatch.setattr(toxicity, "BLOCK", 700)
    monkeypatch.setattr(toxicity, "OVERLAP", 64)
    assert model.score(data, at) == pytest.approx(want)


def test_altered_insults_are_caught_when_only_plain_ones_were_seen():
    rng = random.Random(6)
    syllables = "ka lo mi ren tas vo pel dri sun ga".split()
    insults = ["worthless", "idiot", "disgusting", "moron"]

    def text(toxic, change=lambda w: w):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(80)]
        for _ in range(2 if toxic else 0):
            w.insert(rng.randrange(80), change(rng.choice(insults)))
        return " ".join(w) + "."

    train = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(450)]
    model = toxicity.SentenceKernelModel([t for t, _ in train], [y for _, y in train])

    def share(change, toxic):
        raw = [text(toxic, change).encode() for _ in range(60)]
        return (model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])) >= 0.3).mean()

    assert share(str, False) <= 0.1
    for change in (str, " ".join, ".".join, str.upper, lambda w: w[:2] + " " + w[2:], lambda w: w[:3] + "x" + w[3:], lambda w: w.replace("o", "0").replace("i", "1")):
        assert share(change, True) >= 0.9


def test_token_files(spark, tables, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    got = run(spark, tables, "op10_token_files").sort_values(["start"]).reset_index(drop=True)
    want, start = [], 0
    for r in sorted(docs, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert list(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == want


def test_dac_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    for n, top in ((0, 10), (1, 1), (1000, 200), (5000, 50_000), (3000, 1 << 31)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        ends = np.sort(rng.integers(0, n + 1, 5))
        ends[-1] = n
        reader = token_files.DacReader(token_files.DacWriter.to_bytes(ids, np.arange(5), ends))
        assert reader.all_ids().tolist() == ids.tolist()
        at = rng.integers(0, n, 200) if n else np.zeros(0, int)
        assert reader.get(at).tolist() == ids[at].tolist()
        assert reader.document(4).tolist() == ids[ends[3] :].tolist()


@pytest.mark.parametrize("text", ["Don't stop, it's 3.5%%% ÉAN naïve!! <|endoftext|> x", "a,b;c… d…!! 'tis it's, I'm. we'll!", "İstanbul ΣΑΣ. Σ", "tab\there nbsp em 1,234.5% $$a$$ a- b-"])
def test_words_encode_like_whole_texts(text):
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    data = text.encode()
    ids, at = token_files.WordEncoder(path).ids(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 2)
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2] and at.tolist() == [0, len(ids)]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, f in queries().items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_pipeline_stages(spark, tables, docs):
    import corpus_pipeline

    frame = spark.read.parquet(f"{tables}/documents.parquet")
    names = frame.columns
    step = frame
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, tables)
        assert step.columns == names, name
        counts.append(step.count())
    ids = {r.doc_id for r in step.select("doc_id").collect()}
    assert counts[1] < counts[0] < len(docs) and counts[2] < counts[1]
    assert ids <= {r[0] for r in docs}
    out = corpus_pipeline.STAGES[-1][1](spark, step, tables)
    assert out.count() == counts[3]


def test_every_layout_of_a_host_gets_its_vote(spark):
    body = "<p>" + "The article of this page. " * 12 + "</p>"
    rows = []
    for layout in range(12):
        name = "abcdefghijkl"[layout] * 2
        for i in range(4):
            # on the last page of a layout another block is longer than the article
            other = "<p>" + "Something else on this page. " * (20 if i == 3 else 1) + "</p>"
            rows.append((layout * 10 + i, f"http://h.example/{layout}/{i}", f"<body><div class='{name}'>{body}</div><table><tr><td class='{name}x'>{other}</td></tr></table></body>"))
    rows += [(900, "http://other.example/", "<p>alone"), (901, None, None), (902, "http://h.example/e", ""), (903, "http://h.example/e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows)
    for layout in range(12):
        for i in range(4):
            r = got[layout * 10 + i]
            assert r.text == ("The article of this page. " * 12).strip(), (layout, i)
            assert r.path == ">body>div." + "abcdefghijkl"[layout] * 2
    assert got[900].text == "alone" and got[901].text == "" and got[902].text == ""


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p>a<!-->b</p><p>c</p>", "ab c"),
        ("<p>a<!--->b</p><p>c</p>", "ab c"),
        ("<p>a<!-- x > y -->b</p><!-- <p>no</p> --!><p>c</p>", "ab c"),
        ("<p>a<!-- never closed <p>b</p>", "a"),
        ("<h1>Title</h1><h2 id='side-effects'>Side effects</h2><p>Some are rare.</p><section class='social-history'><p>He smokes.</p></section>", "Title Side effects Some are rare. He smokes."),
        ("<main><p>main body</p><div class='related-posts'><p>More</p></div><div class='social-icons'>x</div></main>", "main body"),
        ("<article><p>one &lt;two&gt; &eacute;&#233;&#x41;</p><ul><li>x<li>y</ul><pre>a\n  b</pre></article>", "one <two> ééA x y a b"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("a<br>b<b>c</b>d", "a bcd"),
    ],
)
def test_main_text_of_small_pages(html, text):
    page = html_text.Page(f"<body>{html}</body>")
    assert page.text([page.best()]) == text


def test_deep_nesting_takes_memory_in_proportion():
    deep = "<div>" * 20_000 + "<p>bottom of it all</p>" + "</div>" * 20_000
    page = html_text.Page(deep)
    assert page.text([page.best()]) == "bottom of it all"
    assert page.best().path().count(">div") == 20_000
