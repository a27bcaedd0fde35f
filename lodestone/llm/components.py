"""Connected components of an edge table, by hooking to smaller labels and pointer jumping.

Every round is a few shuffles over ids: each node is hooked to its smallest neighbour, hooks are followed to their ends by
doubling, and the edges between the ends are the graph of the next round, until there are none. Each
round's tables are written to the shared folder, so lineage stays short and lost executors cost one round. Minima are
taken with partial sums, and the joins are between tables that adaptive execution may split, so a hub with a third of all
edges does not become one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b), ids that order; returns (node, label) of every node that has an edge to another: label is its component's smallest node.

    Null ends and edges of a node to itself say nothing and are left out. No edges: an empty table.
    """
    edges = common.materialize(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    labels = step = _settled(_hooked(edges))
    while True:
        x, y = step.select(F.col("node").alias("a"), F.col("label").alias("la")), step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        between = edges.join(x, "a").join(y, "b").where("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct()
        edges = common.materialize(between, "cc-edges")
        if edges.isEmpty():
            return labels
        # The labels that edges join are nodes of a smaller graph.
        step = _settled(_hooked(edges))
        further = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = common.materialize(labels.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "cc-labels")


def _hooked(edges: DataFrame) -> DataFrame:
    """Each node with the smallest of its neighbours and itself."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
    return common.materialize(both.groupBy("node").agg(F.min("next").alias("low")).select("node", F.least("node", "low").alias("label")), "cc-hooks")


def _settled(labels: DataFrame) -> DataFrame:
    """Labels replaced by their labels until each label is its own."""
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = common.materialize(labels.join(up, "label", "left").select("node", F.coalesce("further", "label").alias("next"), "label"), "cc-labels")
        labels = step.select("node", F.col("next").alias("label"))
        if step.where("next <> label").isEmpty():
            return labels
