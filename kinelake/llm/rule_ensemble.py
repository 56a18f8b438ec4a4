"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Every path from a tree's root to one of its nodes is a rule, a conjunction of
intervals of statistics.  Boosted shallow trees propose rules, a lasso logistic
regression keeps few of them with weights, and the kept ones are compiled into one
Spark column expression over the statistics, which are column expressions too: a
text is read and scored in the JVM, without Python.  Training takes rows of
statistics, not texts, to the driver: at most PER_LABEL rows of a label, of some
twenty numbers each.

Defined results: null text is empty text, whose statistics are all 0; with no usable
label every score is 0.5, with one label only that label's smoothed rate; labels
other than 0 and 1, null ids and contradictory repeated labels go; repeated rows are
scored one by one; equal gains of splits go to the first statistic and the lower
threshold; only text is read when scoring.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .langid import remainder

#: Labelled documents of each label that a model is fitted on: a bounded sample by hash.
PER_LABEL = 4000
TREES, DEPTH, BINS, RATE, LEAST = 40, 3, 32, 0.3, 10
#: Penalties of the lasso, tried from the largest; the first within one standard error of the best is taken.
PENALTIES = (0.03, 0.01, 0.003, 0.001)
THRESHOLD = 0.3


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with a column for each statistic of whole texts (prefix `stat_`), and their names.

    Words and lines are columns of their own first, so that a text is split once.
    """
    docs = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    some = lambda pattern: F.filter(F.split("_text", pattern), lambda w: w != "")
    docs = docs.withColumns({"_words": some(r"[\x20\x09-\x0D]+"), "_lines": some(r"\n+")})
    t, words, lines = F.col("_text"), F.col("_words"), F.col("_lines")
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    such = lambda pattern: F.size(F.filter(words, lambda w: w.rlike(pattern)))
    next_word = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    counts = F.struct(
        F.length(t).alias("chars"),
        left(r"\p{L}+").alias("no_letters"),
        left(r"\p{Lu}+").alias("no_upper"),
        left(r"[0-9]+").alias("no_digits"),
        left(r"\s+").alias("no_space"),
        left(r"[!#$%&*@^~]+").alias("no_odd"),
        left(r"[|{}\[\]<>=/\\_+]+").alias("no_frame"),
        left(r"[.,;:?'\"()-]+").alias("no_points"),
        left(r"[^\x00-\x7F]+").alias("no_wide"),
        F.size(words).alias("words"),
        F.size(F.array_distinct(words)).alias("kinds"),
        F.size(lines).alias("lines"),
        F.size(F.array_distinct(lines)).alias("line_kinds"),
        F.array_max(F.transform(words, F.length)).alias("longest"),
        # a word right after itself: neighbours are zipped, no element is looked up
        F.size(F.filter(F.zip_with(words, next_word, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same)).alias("again"),
        such(r"[^\p{L}\p{N}]{2,}$").alias("marked"),
        such(r"^\P{Ll}*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*$").alias("shouted"),
        (F.size(words) - such(r"[\p{L}\p{N}]")).alias("bare"),
    )
    docs = docs.withColumn("_counts", counts)
    c = {name: F.col("_counts")[name] for name in "chars no_letters no_upper no_digits no_space no_odd no_frame no_points no_wide words kinds lines line_kinds longest again marked shouted bare".split()}
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    chars, count = c["chars"], c["words"]
    made = {
        "log_chars": F.log1p(chars.cast("double")),
        "log_words": F.log1p(count.cast("double")),
        "letters": share(chars - c["no_letters"], chars),
        "upper": share(chars - c["no_upper"], chars - c["no_letters"]),
        "digits": share(chars - c["no_digits"], chars),
        "space": share(chars - c["no_space"], chars),
        "odd_marks": share(chars - c["no_odd"], chars),
        "frame_marks": share(chars - c["no_frame"], chars),
        "points": share(chars - c["no_points"], chars),
        "wide": share(chars - c["no_wide"], chars),
        "kinds": share(c["kinds"], count),
        "kinds_by_root": share(c["kinds"], F.sqrt(count.cast("double"))),
        "line_kinds": share(c["line_kinds"], c["lines"]),
        "words_a_line": share(count, c["lines"]),
        "word_length": share(c["no_space"], count),
        "longest": F.coalesce(c["longest"].cast("double"), F.lit(0.0)),
        "again": share(c["again"], count),
        "marked": share(c["marked"], count),
        "shouted": share(c["shouted"], count),
        "bare": share(c["bare"], count),
    }
    docs = docs.withColumns({f"stat_{n}": v.cast("double") for n, v in made.items()})
    return docs.drop("_text", "_words", "_lines", "_counts"), list(made)


@dataclass(frozen=True)
class Rule:
    """A conjunction: statistic -> (above, up to), either may be infinite."""

    bounds: tuple[tuple[str, float, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, low, high in self.bounds:
            v = x[:, names.index(name)]
            out &= (v > low) & (v <= high)
        return out

    def column(self) -> Column:
        parts = []
        for name, low, high in self.bounds:
            if low > -math.inf:
                parts.append(F.col(f"stat_{name}") > low)
            if high < math.inf:
                parts.append(F.col(f"stat_{name}") <= high)
        out = parts[0]
        for p in parts[1:]:
            out &= p
        return out


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """Probability of label 1 over the columns of with_statistics."""
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * rule.holds(x, names)
        return 1 / (1 + np.exp(-z))


def _split(bins: np.ndarray, slope: np.ndarray, curve: np.ndarray, columns: np.ndarray):
    """Best (gain, statistic, bin) of a node, over the offered statistics."""
    best = (1e-9, -1, -1)
    g, h = slope.sum(), curve.sum()
    for c in columns:
        gl = np.cumsum(np.bincount(bins[:, c], slope, BINS + 1))[:-1]
        hl = np.cumsum(np.bincount(bins[:, c], curve, BINS + 1))[:-1]
        nl = np.cumsum(np.bincount(bins[:, c], minlength=BINS + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(nl < LEAST) | (len(bins) - nl < LEAST)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), int(c), k)
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 0) -> list[Rule]:
    """The paths of boosted trees, each tree offered half of the statistics."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in range(x.shape[1])]
    bins = np.stack([np.searchsorted(cuts[c], x[:, c], side="left") for c in range(x.shape[1])], 1)
    z, found = np.zeros(len(x)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        slope, curve = y - p, p * (1 - p)
        columns = np.sort(rng.choice(x.shape[1], max(x.shape[1] // 2, 1), replace=False))
        nodes = [(np.arange(len(x)), {}, 0)]
        while nodes:
            rows, path, depth = nodes.pop()
            gain, c, k = _split(bins[rows], slope[rows], curve[rows], columns) if depth < DEPTH else (0, -1, -1)
            if c < 0 or k >= len(cuts[c]):
                z[rows] += RATE * slope[rows].sum() / (curve[rows].sum() + 1)
                continue
            cut, (low, high) = float(cuts[c][k]), path.get(names[c], (-math.inf, math.inf))
            below = bins[rows, c] <= k
            for part, bounds in ((rows[below], (low, cut)), (rows[~below], (cut, high))):
                new = path | {names[c]: bounds}
                found[Rule(tuple(sorted((n, a, b) for n, (a, b) in new.items())))] = None
                nodes.append((part, new, depth + 1))
    return list(found)


def lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a lasso logistic regression, by accelerated proximal steps."""
    n, k = m.shape
    a = np.column_stack((np.ones(n), m))
    # the largest eigenvalue of the curvature, from above
    rate = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = at = np.zeros(k + 1)
    pace = 1.0
    for _ in range(steps):
        step = at - rate * (a.T @ (1 / (1 + np.exp(-a @ at)) - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        next_pace = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        at = new + (pace - 1) / next_pace * (new - w)
        w, pace = new, next_pace
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Rules from trees, different ones only, and their weights; a fifth of the rows chooses the penalty."""
    if len(np.unique(y)) < 2:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(math.log(rate / (1 - rate)), [])
    rules = tree_rules(x, y, names)
    masks = {}
    for rule in sorted(rules, key=lambda r: len(r.bounds)):
        holds = rule.holds(x, names)
        # a rule and its opposite tell the same; the shorter path is kept
        if 0 < holds.sum() < len(x):
            masks.setdefault(min(holds.tobytes(), (~holds).tobytes()), (rule, holds))
    rules = [r for r, _ in masks.values()]
    m = np.stack([h for _, h in masks.values()], 1).astype(float) if masks else np.zeros((len(x), 0))
    scale = m.std(0)
    m = m / scale
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2 or not held.any():
        held = np.zeros(len(y), bool)
    losses = []
    for penalty in PENALTIES:
        b, w = lasso(m[~held], y[~held], penalty)
        z = b + (m[held] if held.any() else m) @ w
        losses.append(np.logaddexp(0, np.where((y[held] if held.any() else y) == 1, -z, z)))
    best = min(range(len(PENALTIES)), key=lambda i: losses[i].mean())
    most = losses[best].mean() + losses[best].std() / math.sqrt(len(losses[best]))
    chosen = next(i for i in range(len(PENALTIES)) if losses[i].mean() <= most)
    b, w = lasso(m, y, PENALTIES[chosen])
    return RuleModel(b, [(r, float(v / s)) for r, v, s in zip(rules, w, scale, strict=True) if v != 0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> RuleModel:
    """Fit on the statistics of at most per_label documents of each label, chosen by hash of doc_id."""
    y = F.col(label)
    marks = labels.filter(y.isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(y).alias("_y"), F.max(y).alias("_most")).filter("_y = _most").drop("_most")
    turn = F.xxhash64(F.lit("rules"), F.col("doc_id"))
    picked = marks.filter("_y = 0").orderBy(turn, "doc_id").limit(per_label).unionAll(marks.filter("_y = 1").orderBy(turn, "doc_id").limit(per_label))
    # bounded by per_label, so it can be broadcast: texts are chosen in the scan
    rows, names = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    # one row of a repeated document, so that the rows that arrive are bounded too
    rows = rows.groupBy("doc_id").agg(F.min("_y").alias("_y"), *[F.min(f"stat_{n}").alias(n) for n in names]).orderBy(turn, "doc_id").collect()
    if not rows:
        return RuleModel(0.0, [])
    return fit_rules(np.array([[r[n] for n in names] for r in rows]), np.array([r["_y"] for r in rows], float), names)


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id and score of every row of docs."""
    return with_statistics(docs.select("doc_id", "text"))[0].select("doc_id", model.column().alias("score"))


def op13_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
