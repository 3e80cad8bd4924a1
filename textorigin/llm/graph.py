"""Connected components over an edge table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round a node takes the smallest label among itself and its neighbours, then the label of that label, until nothing changes:
    about the logarithm of the longest path in rounds. Minima are combined before the shuffle, so a node with very many edges
    is no hot group; each round is written, so a lost executor costs a re-read.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both, 2 * edges.count())
    rows = both.count()
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), rows)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut_lineage(lower.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")), rows)
        labels = new.select("node", "label")
        if new.filter("old != label").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
