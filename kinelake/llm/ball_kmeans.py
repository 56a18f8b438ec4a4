"""Centroid clustering: exact Ball k-means over integer vectors.

A cluster is a ball: its centroid and the distance of its farthest member.  Another
centroid can win a member only if half its distance from the ball's centroid is
within the radius: those are the ball's neighbours.  Ordered by that half distance
they split the ball into a stable core, nearer than all of them, whose members need
no comparison, and annuli, whose members are compared only with the neighbours
further in.  All comparisons are of integers, so the result is that of comparing
every vector with every centroid, ties included.

The vectors stay in tables: a round is one pass of Arrow batches that writes each
vector with its cluster and distance, and one aggregate by cluster, combined before
the shuffle, so that a cluster may hold any share of the rows.  Only the k centroids
and k rows of sums come to the driver.  A ball's radius before a pass is bounded by
its last radius and the way its centroid went; a batch narrows it to its own members.

Defined results: vectors of another length, or with a null or non-finite component,
are left out; integers are held within 2 ** 27 of zero, so that distances fit 64
bits; repeated rows count each; a null vec_id hashes as no digits; starts with equal
hashes go by their components; with fewer vectors than k each starts a cluster; equal
centroids leave the larger number empty, and empty clusters keep their centroid; a sum
of distances beyond 64 bits is null; no vectors give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ROWS, table, written

K, ROUNDS, WIDTH, SCALE = 40, 5, 64, 256
MOST = 1 << 27


def integer_vectors(rows: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components times scale rounded down, of the rows with a whole vector."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = rows.filter((F.size(x) == width) & sound)
    value = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(1e15)), F.lit(-1e15))), F.lit(MOST)), F.lit(-MOST)).cast("int")
    return whole.select("vec_id", F.transform(x, value).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: str = "2:") -> np.ndarray:
    """The vectors with the smallest hashes of vec_id, in their order: k rows at most."""
    turn = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(turn.alias("turn"), "v").orderBy("turn", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squares(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = v - centre
    return np.einsum("...i,...i->...", d, d)


class Balls:
    """Centroids, and each one's neighbours in the order of their distance.

    radius: an upper bound of each ball's radius, or None for no bound.
    """

    def __init__(self, centres: np.ndarray, radius: np.ndarray | None = None):
        self.centres = centres
        self.near: list[np.ndarray] = []
        #: a member at least so far from its centroid (squared) must be compared with the neighbour
        self.reach: list[np.ndarray] = []
        for i, centre in enumerate(centres):
            apart = (squares(centres, centre) + 3) // 4
            order = np.argsort(apart, kind="stable")
            order = order[order != i]
            if radius is not None:
                order = order[np.sqrt(apart[order].astype(float)) <= radius[i] * (1 + 1e-9) + 1]
            self.near.append(order)
            self.reach.append(apart[order])

    def assign(self, v: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (the smaller number of equal ones) and squared distance; `last` is the ball each came from."""
        best, dist = last.copy(), np.zeros(len(v), np.int64)
        for i in np.unique(last):
            members = np.flatnonzero(last == i)
            own = squares(v[members], self.centres[i])
            now, low = np.full(len(members), i), own.copy()
            # the annulus of a member: how many neighbours may be as near as its own centroid
            annulus = np.searchsorted(self.reach[i], own, side="right")
            for k in range(int(annulus.max(initial=0))):
                j = self.near[i][k]
                outer = np.flatnonzero(annulus > k)
                other = squares(v[members[outer]], self.centres[j])
                wins = (other < low[outer]) | ((other == low[outer]) & (j < now[outer]))
                now[outer[wins]], low[outer[wins]] = j, other[wins]
            best[members], dist[members] = now, low
        return best, dist


def assigned(vectors: DataFrame, balls: Balls) -> DataFrame:
    """vec_id, v, cluster and distance; without a cluster every vector comes from ball 0."""
    shared = vectors.sparkSession.sparkContext.broadcast(balls)
    width = balls.centres.shape[1]
    if "cluster" not in vectors.columns:
        vectors = vectors.withColumn("cluster", F.lit(0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
                best, dist = shared.value.assign(v, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(best, pa.int32()), pa.array(dist, pa.int64())], names=["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(work, "vec_id long, v array<int>, cluster int, distance long")


def cluster_sums(rows: DataFrame, width: int) -> dict[int, dict]:
    """Number, farthest member and sums of the components of each cluster: k rows."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(width)]
    return {r["cluster"]: r.asDict() for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect()}


def ball_kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The vectors (vec_id, v) with cluster and distance after so many rounds, and the centroids."""
    vectors = written(vectors, "vectors")
    centres = first_centroids(vectors, k)
    if not len(centres):
        return vectors.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centres
    width = centres.shape[1]
    rows = written(assigned(vectors, Balls(centres)), "round_0")
    for turn in range(1, rounds + 1):
        found = cluster_sums(rows, width)
        moved, radius = centres.copy(), np.zeros(len(centres))
        for i, r in found.items():
            moved[i] = [r[f"s{c}"] // r["n"] for c in range(width)]
            radius[i] = math.sqrt(r["far"]) + math.sqrt(int(squares(moved[i], centres[i])))
        centres = moved
        rows = written(assigned(rows, Balls(centres, radius)), f"round_{turn}")
    return rows, centres


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = ball_kmeans(integer_vectors(table(spark, sf_dir, "embeddings")))
    whole = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = Decimal(sum(int(r["s"]) for r in sums))
    facts = [(r["cluster"], r["s"], total, hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()) for r in sums]
    # k rows at most
    facts = spark.createDataFrame(facts, "cluster int, s decimal(38,0), t decimal(38,0), centroid_sha256 string").select("cluster", whole("s").alias("cluster_inertia"), whole("t").alias("inertia"), "centroid_sha256")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
