"""Connected components of an undirected graph, by smallest labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraud_engine.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b): the smallest node it is connected with.

    In each round a node takes the smallest label among itself and its neighbours, then the label of that
    label, so a path of n nodes takes about log n rounds. Every round is a written table.
    """
    both = materialize(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        # A node hears the labels of its neighbours, and tells its own label what it has heard.
        heard = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("least"))
        own = labels.join(heard, "node").select("node", "component", F.least("component", "least").alias("least"))
        hooked = own.groupBy(F.col("component").alias("node")).agg(F.min("least").alias("root"))
        near = own.join(hooked, "node", "left").select(
            "node", F.col("component").alias("before"), F.least("least", "root").alias("component"))
        near = materialize(near, "near-labels")
        jump = near.select(F.col("node").alias("_at"), F.col("component").alias("_to"))
        moved = near.join(jump, near.component == jump._at, "left").select(
            "node", "before", F.least("component", "_to").alias("component"))
        moved = materialize(moved, "labels")
        if moved.where("component <> before").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")
