"""Movement model on feature vectors: prediction over Arrow batches, training and
per-group evaluation; plus the viewpoint bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.operators import kernels


def predicted(rows: DataFrame, vector: str, model: dict, labels: list[str]) -> DataFrame:
    """Class probabilities (a map), the best label, the runner-up and the margin."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def proba(x: pd.Series) -> pd.Series:
        return pd.Series(list(kernels.probabilities(shared.value, np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

    names = F.array(*[F.lit(n) for n in labels])
    ranked = F.array_sort(F.arrays_zip(F.col("_p").alias("p"), names.alias("label")), lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0))
    out = rows.withColumn("_p", proba(vector)).withColumn("_r", ranked)
    best, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    return out.withColumn("probabilities", F.map_from_arrays(names, F.col("_p"))).withColumn("label", best["label"]).withColumn("runner_up", second["label"]).withColumn("margin", best["p"] - second["p"]).drop("_p", "_r")


def out_of_fold(rows: DataFrame, vector: str, label: str, fold: str, variants: list[tuple[int, int]], folds: int = 5) -> DataFrame:
    """Out-of-fold accuracy of (hidden, seed) variants; one task per variant and fold.

    The labelled feature table is bounded by what was labelled by hand.
    """
    data = rows.select(F.col(vector).alias("x"), F.col(label).alias("y"), F.col(fold).alias("f")).withColumn("_job", F.explode(F.array(*[F.struct(F.lit(h).alias("hidden"), F.lit(s).alias("seed"), F.lit(k).alias("held")) for h, s in variants for k in range(folds)]))).select("x", "y", "f", "_job.*")

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(part["x"].to_numpy()), part["y"].to_numpy(int)
        test = part["f"].to_numpy() == key[2]
        if test.all() or not test.any():
            return pd.DataFrame({"hidden": [key[0]], "seed": [key[1]], "held": [key[2]], "n": [0], "correct": [0]})
        model = kernels.train_mlp(x[~test], y[~test], int(y.max()) + 1, key[0], 120, seed=key[1])
        hit = kernels.probabilities(model, x[test]).argmax(1) == y[test]
        return pd.DataFrame({"hidden": [key[0]], "seed": [key[1]], "held": [key[2]], "n": [len(hit)], "correct": [int(hit.sum())]})

    parts = data.groupBy("hidden", "seed", "held").applyInPandas(work, "hidden int, seed int, held int, n long, correct long")
    return parts.groupBy("hidden", "seed").agg((F.sum("correct") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


def azimuths(ratios: DataFrame, true_ratio: float, resamples: int = 400, seed: int = 0, widen: float = 0.15) -> DataFrame:
    """Median azimuth per clip with a bootstrap interval, widened for the ruler.

    ratios: video, ratio (apparent over torso, confident frames).
    """

    def work(part: pd.DataFrame) -> pd.DataFrame:
        r = part["ratio"].dropna().to_numpy(float)
        angle = lambda v, k=1.0: np.degrees(np.arcsin(np.clip(v / (true_ratio * k), 0, 1)))
        if len(r) < 10:
            return pd.DataFrame({"video": [part["video"].iloc[0]], "azimuth": [None], "low": [None], "high": [None], "n": [len(r)]})
        rng = np.random.default_rng(seed)
        medians = np.median(r[rng.integers(0, len(r), (resamples, len(r)))], axis=1)
        lo, hi = np.percentile(medians, [2.5, 97.5])
        return pd.DataFrame({"video": [part["video"].iloc[0]], "azimuth": [angle(np.median(r))], "low": [angle(lo, 1 + widen)], "high": [angle(hi, 1 - widen)], "n": [len(r)]})

    return ratios.groupBy("video").applyInPandas(work, "video string, azimuth double, low double, high double, n long")


def augmented(pose: DataFrame, views: int, noise: float = 2.0) -> DataFrame:
    """Each clip with seeded noisy views on confident joints: owner, view, is_original."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for v in range(views + 1):
            rng = np.random.default_rng(v)
            shift = rng.normal(0, noise, (len(part), 2)) * (part[["c"]].to_numpy(float) >= 0.5) * (v > 0)
            out.append(part.assign(x=part["x"] + shift[:, 0], y=part["y"] + shift[:, 1], owner=part["video"], view=v, is_original=v == 0))
        return pd.concat(out)

    return pose.groupBy("video").applyInPandas(work, "video string, frame int, joint string, x double, y double, c double, owner string, view int, is_original boolean")
