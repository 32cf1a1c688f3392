"""Connected components of an edge table, by DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every end of an edge (a, b); a component is named by its least node.

    Every node is also its own neighbour, so the least label among the neighbours is a join and a grouping; then labels
    are followed one step (pointer jumping), and rounds grow with the logarithm of a component's width. A node's many
    edges only meet in partial minima. Labels are written after each round; a round without change ends it.
    """
    loops = edges.select("a", "b").union(edges.selectExpr("b AS a", "a AS b")).union(edges.selectExpr("a", "a AS b")).union(edges.selectExpr("b AS a", "b"))
    both = scratch.keep(loops.distinct(), "cc-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "cc-labels")
    while True:
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("before")
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"), own)
        jump = labels.select(F.col("node").alias("least"), F.col("component").alias("onward"))
        stepped = heard.join(jump, "least", "left").select(F.col("a").alias("node"), F.coalesce("onward", "least").alias("component"), "before")
        stepped = scratch.keep(stepped, "cc-labels")
        labels = stepped.select("node", "component")
        if not stepped.where("component <> before").limit(1).count():
            return labels
