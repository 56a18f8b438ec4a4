"""Closure, tiers, state and plans over a prerequisite graph (node, requires)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.lineage import cut


def closure(edges: DataFrame) -> DataFrame:
    """node, ancestor and depth (the longest path) of a graph (node, requires).

    Who reaches whom is found with paths of doubling length, until nothing is new.
    Edges inside a cycle are then left out, so that longest paths end whatever their
    length; a pair that only a cycle connects has no depth.
    """
    edges = cut(edges.select("node", F.col("requires").alias("ancestor")).distinct())
    pairs, known = edges, edges.count()
    while True:
        further = pairs.join(pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up")), "ancestor").select("node", F.col("_up").alias("ancestor"))
        pairs = cut(pairs.unionByName(further).distinct())
        if (now := pairs.count()) == known:
            break
        known = now
    back = pairs.select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor"))
    free = cut(edges.join(back, ["node", "ancestor"], "left_anti").filter("node <> ancestor"))
    up = free.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"))
    step, depth = free, 1
    found = step.withColumn("depth", F.lit(depth))
    while True:
        step = cut(step.join(up, "ancestor").select("node", F.col("_up").alias("ancestor")).distinct())
        if step.isEmpty():
            break
        depth += 1
        found = found.unionByName(step.withColumn("depth", F.lit(depth)))
    return pairs.join(found.groupBy("node", "ancestor").agg(F.max("depth").alias("depth")), ["node", "ancestor"], "left")


def tiers(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The longest path from a root to each node; roots have 0."""
    deep = paths.groupBy("node").agg(F.max("depth").alias("tier"))
    return nodes.join(deep, "node", "left").withColumn("tier", F.coalesce("tier", F.lit(0)))


def unlocks(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("requires").alias("node")).agg(F.array_sort(F.collect_set("node")).alias("unlocks"))


def states(nodes: DataFrame, edges: DataFrame, paths: DataFrame, verified: DataFrame, claimed: DataFrame) -> DataFrame:
    """verified, claimed (also ancestors of what is done), available or locked."""
    done = verified.select("node", F.lit(2).alias("_s")).unionByName(claimed.select("node", F.lit(1).alias("_s")))
    implied = done.join(paths, "node").select(F.col("ancestor").alias("node"), F.lit(1).alias("_s"))
    level = done.unionByName(implied).groupBy("node").agg(F.max("_s").alias("_s"))
    open_ = edges.join(level.select(F.col("node").alias("requires"), F.lit(1).alias("_ok")), "requires", "left").groupBy("node").agg(F.bool_and(F.col("_ok").isNotNull()).alias("_open"))
    rows = nodes.join(level, "node", "left").join(open_, "node", "left")
    state = F.when(F.col("_s") == 2, "verified").when(F.col("_s") == 1, "claimed").when(F.coalesce("_open", F.lit(True)), "available").otherwise("locked")
    return rows.withColumn("state", state).drop("_s", "_open")


def faults(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Dangling requirements and nodes that require themselves."""
    dangling = edges.join(nodes.select(F.col("node").alias("requires")), "requires", "left_anti").select("node", F.lit("dangling").alias("fault"), F.col("requires").alias("detail"))
    cycles = paths.filter("node = ancestor").select("node", F.lit("cycle").alias("fault"), F.col("ancestor").alias("detail"))
    return dangling.unionByName(cycles)


def plan(target: str, tiered: DataFrame, paths: DataFrame, state: DataFrame, most: int = 16) -> DataFrame:
    """The steps to a target that are not done, by tier and name, numbered as weeks."""
    wanted = paths.filter(F.col("node") == target).select(F.col("ancestor").alias("node")).unionByName(tiered.filter(F.col("node") == target).select("node"))
    rows = wanted.join(tiered, "node").join(state.select("node", "state"), "node").filter(~F.col("state").isin("verified", "claimed"))
    w = Window.orderBy("tier", "node")
    return rows.withColumn("week", F.row_number().over(w)).withColumn("after", F.lag("node").over(w)).filter(F.col("week") <= most)


def next_up(tiered: DataFrame, state: DataFrame, n: int = 5) -> DataFrame:
    return tiered.join(state.filter("state = 'available'").select("node"), "node").orderBy("tier", "node").limit(n)


def walked(nodes: DataFrame, answers: DataFrame, root: str) -> DataFrame:
    """Descend a question tree (node, answer, target) by given answers (subject, node, answer).

    Every subject goes on until it has no answer to a question; more steps than the
    tree has questions are a cycle, an error.
    """
    steps = cut(answers.join(nodes, ["node", "answer"]).select("subject", "node", "target"))
    most = nodes.select("node").distinct().count()
    at = answers.select("subject").distinct().withColumn("node", F.lit(root)).withColumn("path", F.array(F.lit(root)))
    for _ in range(most + 1):
        if at.join(steps, ["subject", "node"], "left_semi").isEmpty():
            return at
        at = cut(at.join(steps, ["subject", "node"], "left").select("subject", F.coalesce("target", "node").alias("node"), F.when(F.col("target").isNull(), F.col("path")).otherwise(F.concat("path", F.array("target"))).alias("path")))
    raise ValueError("the question tree has a cycle")
