"""Connected components in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace


def components(work: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the smallest node.

    Each round takes the smallest label among a node's neighbours, hands it to the node that the old label names as well, and jumps to
    that label's own label; rounds grow with the logarithm of a component's diameter. A round's labels are written, so that lineage stays short.
    Hub nodes: the minimum is aggregated before its shuffle, the joins are plain equi-joins whose skewed side AQE splits.
    """
    both = work.keep(edges.selectExpr("a", "b").union(edges.selectExpr("b AS a", "a AS b")).where("a <> b").distinct(), f"{name}-edges")
    labels = work.keep(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")).withColumn("changed", F.lit(True)), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels.selectExpr("node AS b", "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.selectExpr("node", "label AS old").join(near, "node", "left").selectExpr("node", "old", "coalesce(least(old, near), old) AS up")
        hook = step.groupBy(F.col("old").alias("node")).agg(F.min("up").alias("hook"))
        step = step.join(hook, "node", "left").selectExpr("node", "old", "coalesce(least(up, hook), up) AS up")
        jump = labels.selectExpr("node AS up", "label AS far")
        new = step.join(jump, "up", "left").selectExpr("node", "coalesce(least(up, far), up) AS label", "coalesce(least(up, far), up) < old AS changed")
        k += 1
        fresh = work.keep(new, f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
        labels = fresh
        if not labels.where("changed").limit(1).count():
            return labels.select("node", "label")
