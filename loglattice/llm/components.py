"""Connected components of a graph given by its edges, by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`edges` (a, b) as (node, component): the smallest node reachable, for every node of an edge.

    A node first points to its smallest neighbour; pointers are then followed to their roots. Every round
    contracts the edges to pairs of different roots, hooks each root under its smallest neighbour and follows
    the pointers again. Grouped minima are combined before they are shuffled, so a node with very many edges
    sends one row from each task; the joins are plain equi joins, whose skew Spark can split. What a round
    leaves is a written table; nothing is collected. Self edges and repeated edges do no harm; null ends are
    left out; no edges give no rows."""
    edges = materialise(edges.select("a", "b").where("a is not null and b is not null"))
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
    labels = _rooted(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")))
    for _ in range(rounds):
        one, two = (labels.select(F.col("node").alias(end), F.col("label").alias(f"root_{end}")) for end in "ab")
        ends = edges.join(one, "a").join(two, "b").where("root_a <> root_b")
        edges = materialise(ends.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        if edges.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        hooks = edges.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("lower"))
        labels = _rooted(labels.join(hooks, "label", "left").select("node", F.coalesce("lower", "label").alias("label")))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _rooted(labels: DataFrame) -> DataFrame:
    """Follows (node, label) pointers, each to a smaller node or itself, until they reach their roots."""
    while True:
        labels = materialise(labels)
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = materialise(labels.join(above, "label").select("node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")))
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels
