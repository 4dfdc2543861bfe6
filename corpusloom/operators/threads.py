"""Message trees: branch points and the canonical thread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.workdir import materialize


def branch_points(edges: DataFrame) -> DataFrame:
    """(conv, node, children) of nodes with more than one child."""
    return edges.where("parent is not null").groupBy("conv", F.col("parent").alias("node")).agg(F.count("*").alias("children")).where("children > 1")


def ancestors(edges: DataFrame, heads: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(conv, node) on the way from each conversation's head to its root, head included.

    Jumps double every round, so a thread of n messages takes log2(n) joins; a cycle ends when no new
    node is reached.  Rounds are written, so lineage stays short.
    """
    reached = heads.select("conv", "node").distinct()
    jumps = edges.where("parent is not null").select("conv", "node", F.col("parent").alias("up"))
    n = -1
    for _ in range(most_rounds):
        more = reached.join(jumps, ["conv", "node"]).select("conv", F.col("up").alias("node"))
        reached = materialize(reached.union(more).distinct(), "thread")
        now = reached.count()
        if now == n:
            break
        n = now
        far = jumps.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"))
        jumps = materialize(jumps.join(far, ["conv", "up"]).select("conv", "node", F.col("up2").alias("up")), "thread")
    return reached


def canonical(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(conv, node, branch): nodes off the way from the head to the root are abandoned, in conversations that
    have a branch point and a way of two nodes or more; elsewhere every node is canonical."""
    way = ancestors(edges, heads).withColumn("on_way", F.lit(True))
    size = way.groupBy("conv").agg(F.count("*").alias("way"))
    split = branch_points(edges).select("conv").distinct().join(size.where("way >= 2"), "conv").select("conv", F.lit(True).alias("split"))
    rows = edges.select("conv", "node").join(way, ["conv", "node"], "left").join(split, "conv", "left")
    return rows.select("conv", "node", F.when(F.col("split") & F.col("on_way").isNull(), "abandoned").otherwise("canonical").alias("branch"))
