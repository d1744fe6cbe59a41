"""Connected components of a graph that is larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges(a, b), both long; loops and repeats don't matter.

    Each round takes the smallest label among neighbours, then the label of that label; what a node knows at least doubles its
    reach, and each round is a stored table.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = shared.store(both.distinct(), "edges")
    labels = shared.store(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # A component's own smallest node is its label's label too, so the jump never leaves the component.
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = met.join(up, met["label"] == up["_n"], "left").select("node", "old", F.least("label", "_l").alias("label"))
        new = shared.store(jumped, "labels")
        moved = not new.filter("old <> label").isEmpty()
        shared.drop_stored(spark, labels)
        labels = new.select("node", "label")
        if not moved:
            shared.drop_stored(spark, both)
            return labels
