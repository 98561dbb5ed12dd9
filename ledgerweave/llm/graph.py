"""Connected components of an edge table, by contraction. Only edges move; no component meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import written


def _rooted(parents: DataFrame) -> DataFrame:
    """Follow ``node -> parent`` (a forest, parents are smaller) up to the roots, doubling the step each time."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = written(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "jump")
        parents = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns ``a, b``); the root is the component's smallest node.

    Each round points every node at its smallest neighbour, follows the pointers to local minima, and goes on with the
    edges between those. A round leaves at most half of the nodes that still have an edge.
    """
    edges = written(_distinct(edges), "edges")
    label = None
    while True:
        if edges.isEmpty():
            empty = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            return label if label is not None else empty
        parents = _rooted(written(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")), "parents"))
        if label is None:
            nodes = edges.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
            label = nodes.join(parents, "node", "left").select("node", F.coalesce("parent", "node").alias("root"))
        else:
            up = parents.select(F.col("node").alias("root"), "parent")
            label = label.join(up, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        label = written(label, "labels")
        high = parents.select(F.col("node").alias("hi"), F.col("parent").alias("a"))
        low = parents.select(F.col("node").alias("lo"), F.col("parent").alias("b"))
        moved = edges.join(high, "hi", "left").join(low, "lo", "left")
        edges = written(_distinct(moved.select(F.coalesce("a", "hi").alias("a"), F.coalesce("b", "lo").alias("b"))), "edges")


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
