"""Connected components of an edge table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that spark.checkpoint.dir names, or in tests a new local one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftmark-"))
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge.

    Labels travel along edges and, by looking up the label of one's label, along chains, so that the rounds grow
    with the logarithm of the longest path. Each round is checkpointed.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = checkpointed(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("near"))
        over = labels.select(F.col("node").alias("component"), F.col("component").alias("over"))
        new = labels.join(over, "component").join(near, F.col("node") == F.col("u")).select("node", F.least("component", "over", "near").alias("new"), "component")
        new = checkpointed(new)
        labels = new.select("node", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
