"""Connected components of an edge table by distributed label spreading.

Each round gives every node the smallest label among its own and its
neighbours', then follows the label's own label (pointer jumping), so long
chains close in a logarithmic number of rounds. Nothing but a count of changed
nodes reaches the driver, and every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected ``edges`` (a long, b long); the smallest node names it."""
    both = settle(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a <> b")
        .distinct()
    )
    labels = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        # Combined before the shuffle, so a node with very many neighbours is one row per task.
        near = (
            both.join(labels.withColumnRenamed("a", "b"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        spread = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("next"))
        # A label is itself a node; follow it.
        up = labels.select(F.col("a").alias("next"), F.col("label").alias("above"))
        moved = settle(
            spread.join(up, "next").select("a", "label", F.least("next", "above").alias("next"))
        )
        changed = moved.filter("next <> label").isEmpty()
        labels = moved.select("a", F.col("next").alias("label"))
        if changed:
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
