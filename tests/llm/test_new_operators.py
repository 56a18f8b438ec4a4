"""Fill-in-middle, Ball k-means and the rule ensemble, against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.llm import ball_kmeans, fim, rule_ensemble
from kinelake.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, n long, output string, form string, stat_chars string, _words string, _counts string, v string, cluster string, h1 string"
FILL = (None, None, None, "k", "", "x", "", "", "", "")


def sha(data):
    return hashlib.sha256(data.encode()).hexdigest()


def cut(doc_id, text):
    """n, form, prefix, middle and output, by the definition."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    t = text or ""
    n = len(t)
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n", "\n\n\n", "a", "<P>", "x <S> y", "<M", "< P>", "é", "日本\n語", "🙂🙂", "a\r\nb", "word " * 60_000, "é\n" * 30_000, "<" * 50 + "M>", "\\N"]
    out += ["".join(rng.choice("ab \né日🙂<P>") for _ in range(rng.randrange(60))) for _ in range(150)]
    return out


def written_docs(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")


def test_fill_in_middle_equals_the_definition(spark, tmp_path):
    rows = [(i, t, *FILL) for i, t in enumerate(texts())]
    rows += [(None, "no number at all", *FILL), rows[20], rows[20], (-5, "negative", *FILL)]
    written_docs(spark, tmp_path, rows)
    got = sorted(map(tuple, queries()["op11_fill_in_middle"](spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        n, form, a, m, out = cut(doc_id, text)
        want.append((doc_id, n, form, a, m, sha(out), sha(text or "")))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_gives_the_texts_themselves(spark):
    docs = spark.createDataFrame([(i, "one two\nthree  four") for i in range(40)], "doc_id long, text string")
    for r in fim.fill_in_middle(docs).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut(r.doc_id, "one two\nthree  four")
    own = ("[pre]", "[suf]", "[mid]")
    made = fim.fill_in_middle(docs, unit="words", seed="other", sentinels=own)
    rows = made.select("*", fim.restored(F.col("output"), F.col("form"), own).alias("back")).collect()
    assert {r.back for r in rows} == {"one two\nthree  four"} and {r.n for r in rows} == {8}
    # words and blanks stay whole
    assert {r.prefix_chars for r in rows if r.form != "plain"} <= {0, 3, 4, 7, 8, 13, 14, 15, 19}


def units_of(text, rule):
    out, gap = [], ""
    for c in [*text, None]:
        if c is None or c in rule.changers:
            step = rule.step or max(len(gap), 1)
            out += [gap[i : i + step] for i in range(0, len(gap), step)]
            gap = ""
            out += [c] if c else []
        else:
            gap += c
    return out


@pytest.mark.parametrize("unit", ["points", "words", "pieces"])
def test_ranks_find_the_places_of_a_walk_over_all_units(unit):
    rule = fim.UNITS[unit]
    scan = fim.EventScan(rule, ("<P>",))
    for text in [*(t for t in texts() if t and "<P>" not in t and len(t) < 1000), "x" * 200 + "\n" + "y" * 161]:
        units = units_of(text, rule)
        ranks = scan.read(text)
        assert ranks.n == len(units)
        for r in range(len(units) + 1):
            assert ranks.place(r) == len("".join(units[:r])), (text, r)
    assert scan.read("before <P> after") is None


def test_fill_in_middle_of_bytes_that_are_no_text(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61FF0A62C3') as string)").alias("text"))
    made = fim.fill_in_middle(docs)
    back = {bytes(r[0]) for r in made.select(fim.restored(F.col("output"), F.col("form")).cast("binary")).collect()}
    assert back == {bytes.fromhex("61FF0A62C3")}


def test_bad_sentinels_and_changers_are_refused():
    with pytest.raises(ValueError):
        fim.EventScan(fim.UNITS["points"], ("",))
    with pytest.raises(ValueError):
        fim.EventScan(fim.UnitRule("é", 1), ("<P>",))


def brute_kmeans(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (sha(f"2:{r[0]}"), r[1]))
    centres = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (dist(v, centres[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        centres = [[sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)] if c in groups else centres[c] for c in range(len(centres))]
    found = [(i, nearest(v), v) for i, v in kept]
    inertia = {}
    for _, c, v in found:
        inertia[c] = inertia.get(c, 0) + dist(v, centres[c])
    return [(i, c, dist(v, centres[c]), inertia[c], sum(inertia.values()), sha(",".join(map(str, centres[c])))) for i, c, v in found]


def kmeans_tables(spark, folder, rows):
    shape = "vec_id long, embedding array<float>, label int, v string, cluster string, distance string"
    spark.createDataFrame([(i, v, 1, "a", None, "b") for i, v in rows], shape).repartition(3).write.parquet(f"{folder}/embeddings.parquet")


def vectors_of(n, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, 64))
    return [(int(i), [float(x) for x in middle[i % 9] + rng.normal(size=64) * 0.3]) for i in range(n)]


def test_ball_kmeans_equals_all_comparisons(spark, tmp_path):
    rows = vectors_of(220, 1)
    inf, nan = float("inf"), float("nan")
    rows += [(900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 65), (904, [None] + [0.1] * 63), (905, [nan] + [0.1] * 63), (906, [-inf] + [0.1] * 63)]
    # a hot vector with a third of the rows, with one id and with many; equal starts
    rows += [(50_000 + i, [0.25] * 64) for i in range(60)] + [(7, [0.25] * 64)] * 60 + [(8, [-0.001] * 64)] * 2
    kmeans_tables(spark, tmp_path, rows)
    got = sorted(map(tuple, queries()["op12_ball_kmeans"](spark, str(tmp_path)).collect()))
    assert got == sorted(brute_kmeans(rows))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_ball_kmeans_of_few_vectors(spark, tmp_path, n):
    rows = [*vectors_of(n, 2), (99, None)]
    kmeans_tables(spark, tmp_path, rows)
    got = sorted(map(tuple, queries()["op12_ball_kmeans"](spark, str(tmp_path)).collect()))
    assert got == sorted(brute_kmeans(rows))


def test_balls_give_ties_to_the_smaller_number_from_any_hint():
    rng = np.random.default_rng(4)
    for trial in range(40):
        # few values, so that equal distances and equal centroids are frequent
        v, centres = rng.integers(-2, 3, (80, 3)), rng.integers(-2, 3, (12, 3))
        full = ((v[:, None] - centres[None]) ** 2).sum(2)
        last = rng.integers(0, 12, 80)
        for radius in (None, np.sqrt(np.array([max(full[last == i, i], default=0) for i in range(12)], float))):
            best, dist = ball_kmeans.Balls(centres, radius).assign(v, last)
            assert (best == full.argmin(1)).all() and (dist == full.min(1)).all()


def test_a_stable_core_is_compared_with_no_other_centroid():
    centres = np.array([[0, 0], [100, 0], [0, 1000]])
    balls = ball_kmeans.Balls(centres, np.array([60.0, 10.0, 10.0]))
    assert [list(n) for n in balls.near] == [[1], [], []]
    assert list(balls.reach[0]) == [2500]


def test_far_components_are_held_and_sums_beyond_64_bits_are_null(spark, tmp_path):
    rows = [(i, [3e38 if (i + c) % 2 else -3e38 for c in range(64)]) for i in range(4)]
    kmeans_tables(spark, tmp_path, rows)
    got = queries()["op12_ball_kmeans"](spark, str(tmp_path)).collect()
    assert len(got) == 4 and {r.distance for r in got} == {0}


def junk_and_prose(n):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["en", "on", "th", "er", "an", "é", "st"]) for _ in range(rng.randrange(1, 5)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        kind = i % 6
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 1:
            text = " ".join(words[:5]) + (" " + words[0]) * 40
        else:
            text = " ".join(words) + "."
        out.append((i, text, int(kind > 1)))
    return out


def quality_tables(spark, folder, rows, labels, extra=()):
    written_docs(spark, folder, [(i, t, *FILL) for i, t, _ in rows] + [(i, t, *FILL) for i, t in extra])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_rules_tell_held_out_junk_from_prose(spark, tmp_path):
    rows = junk_and_prose(600)
    extra = [(1000, None), (1001, ""), (1002, "   \n"), (None, "text without number"), (1003, "x" * 100_000), (5, rows[5][1])]
    quality_tables(spark, tmp_path, rows, [(i, y, 0) for i, _, y in rows] + [(700, None, 0), (None, 1, 0), (3, 0, 0), (3, 1, 0), (4, 7, 0)], extra)
    got = queries()["op13_rule_ensemble"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) or r.doc_id is None
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_labels_of_held_out_rows_change_nothing(spark, tmp_path):
    rows = junk_and_prose(120)
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    a, b = tmp_path / "a", tmp_path / "b"
    quality_tables(spark, a, rows, [(i, y, 0) for i, _, y in rows])
    quality_tables(spark, b, rows, [(i, 1 - y if i in held else y, 1) for i, _, y in rows])
    one, two = (sorted(map(tuple, queries()["op13_rule_ensemble"](spark, str(f)).collect())) for f in (a, b))
    assert one == two


def test_compiled_rules_equal_their_masks(spark):
    rows = junk_and_prose(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    made, names = rule_ensemble.with_statistics(docs)
    x = {r["doc_id"]: [r[f"stat_{n}"] for n in names] for r in made.collect()}
    m = np.array([x[i] for i, _, _ in rows])
    model = rule_ensemble.fit_rules(m, np.array([y for _, _, y in rows], float), names)
    assert 0 < len(model.rules) < 80
    got = {r.doc_id: r.score for r in rule_ensemble.score(docs, model).collect()}
    assert np.allclose([got[i] for i, _, _ in rows], model.score(m, names), atol=1e-12)


def test_statistics_of_known_texts(spark):
    docs = spark.createDataFrame([(0, "The cat\nthe CAT sat sat!! | 12"), (1, None), (2, "")], "doc_id long, text string")
    made, names = rule_ensemble.with_statistics(docs)
    rows = {r.doc_id: r for r in made.collect()}
    assert made.columns == ["doc_id", "text", *[f"stat_{n}" for n in names]]
    r = rows[0]
    assert r.stat_log_words == pytest.approx(math.log(9)) and r.stat_kinds == pytest.approx(8 / 8) and r.stat_line_kinds == 1
    assert r.stat_again == 0 and r.stat_marked == pytest.approx(1 / 8) and r.stat_shouted == pytest.approx(1 / 8) and r.stat_bare == pytest.approx(1 / 8)
    assert r.stat_upper == pytest.approx(4 / 18) and r.stat_digits == pytest.approx(2 / 30)
    for k in (1, 2):
        assert all(rows[k][f"stat_{n}"] == 0 for n in names)


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([(1, 1, 0), (2, 1, 0)], None)])
def test_no_labels_and_one_label(spark, tmp_path, labels, want):
    quality_tables(spark, tmp_path, junk_and_prose(12), labels)
    scores = {r.score for r in queries()["op13_rule_ensemble"](spark, str(tmp_path)).collect()}
    assert len(scores) == 1 and (want is None or scores == {want})


def test_lasso_leaves_useless_rules_out():
    rng = np.random.default_rng(0)
    m = rng.integers(0, 2, (500, 12)).astype(float)
    y = (m[:, 3] + (rng.random(500) < 0.05) > 0.5).astype(float)
    b, w = rule_ensemble.lasso(m, y, 0.02)
    assert w[3] > 1 and np.abs(np.delete(w, 3)).max() < 0.2 and (w == 0).sum() >= 6
    assert rule_ensemble.lasso(m, y, 10.0)[1].tolist() == [0.0] * 12


def test_empty_tables(spark, tmp_path):
    written_docs(spark, tmp_path, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries()["op11_fill_in_middle"](spark, str(tmp_path)).count() == 0
    assert queries()["op13_rule_ensemble"](spark, str(tmp_path)).count() == 0
