"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of the edges (a, b); the component is its smallest node.

    In each round every node with a lesser neighbour hangs below the least one,
    and trees shrink to their least node; edges within a tree are dropped, so the
    next round works on fewer edges between fewer nodes. A star around its least
    node takes one round. Rounds are checkpointed in the shared folder and go on
    until no edge is left.
    """
    left = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    while left.limit(1).count():
        # Each node that has a lesser neighbour hangs below the least one; chains are followed to their ends.
        hung = cut(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
        while True:
            up = hung.select(F.col("node").alias("n2"), F.col("label").alias("jump"))
            after = cut(hung.join(up, F.col("label") == F.col("n2"), "left").select("node", F.coalesce("jump", "label").alias("label"), F.col("jump").isNotNull().alias("moved")))
            hung = after.select("node", "label")
            if not after.where("moved").limit(1).count():
                break
        roots = hung.select(F.col("node").alias("n2"), F.col("label").alias("root"))
        a_end = left.join(roots, F.col("a") == F.col("n2"), "left").select(F.coalesce("root", "a").alias("a"), "b")
        ends = a_end.join(roots, F.col("b") == F.col("n2"), "left").select("a", F.coalesce("root", "b").alias("b"))
        left = cut(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if labels is None:
            labels = hung
        else:
            moved = labels.join(roots, F.col("label") == F.col("n2"), "left").select("node", F.coalesce("root", "label").alias("label"))
            labels = cut(moved.unionAll(hung.join(labels.select(F.col("node").alias("n3")), F.col("node") == F.col("n3"), "left_anti")))
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.select(F.col("label").alias("node")).distinct()
    return labels.unionAll(least.withColumn("label", F.col("node"))).select("node", F.col("label").alias("component"))
