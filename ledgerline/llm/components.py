"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Each round takes the least label of a node's neighbours, then the label of that label; both halve the distances that
    remain. Labels are written to the shared folder after each round, in place of the round before, and never come to the driver. A path of n nodes takes about log2(n) rounds."""
    both = staged(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct(), "edges")
    labels = staged(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    former = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        moved = staged(least.join(jump, "to", "left").select("node", F.least("to", "further").alias("component"), F.col("component").alias("was")), "labels")
        drop(former)
        former, labels = moved, moved.select("node", "component")
        if moved.filter(F.col("component") != F.col("was")).isEmpty():
            drop(both)
            return labels
