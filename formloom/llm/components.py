"""Connected components of a graph given as a table of edges, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node it is connected with) for every node of `edges` (columns a and b, longs).

    Each round gives every node the smallest label among itself and its neighbours, then the label of that label. The
    number of rounds grows with the logarithm of the longest path for the star-shaped edges that the callers give.
    """
    both = written(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        stepped = least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        stepped = written(stepped, "labels")
        labels = stepped.select("node", "label")
        if not stepped.where("label <> old").limit(1).count():
            return labels
