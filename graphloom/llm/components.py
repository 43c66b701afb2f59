"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or only edges from larger ones."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (a, b longs).

    Each round is two aggregations and two joins over the edges and ends in a written table;
    rounds grow with the logarithm of the longest path. Nodes with very many neighbours are
    aggregated before the shuffle and their join is split by adaptive execution.
    """
    labels, left = contracted(edges.filter("a != b"))
    whole = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(left).filter("a != b")
    edges = materialize(whole.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_star_forest(edges):
        edges = materialize(_small(_large(edges)).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_labels(edges: DataFrame) -> DataFrame:
    """``node, component``: for every node of ``edges`` one that is connected to it, found in two steps
    to the smallest neighbour. Equal labels mean connected nodes; different ones mean nothing."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"))
    first = materialize(first, "first-labels")
    second = first.select(F.col("node").alias("label"), F.col("label").alias("further"))
    return first.join(second, "label").select("node", F.least("label", "further").alias("component"))


def contracted(edges: DataFrame, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Labels (node, component) after rounds of ``near_labels``, each over the edges that the one before
    left between different labels; and those edges (a, b, of labels) that still are left. Together
    they connect what ``edges`` connects, in about as many edges as there are nodes."""
    labels, left = None, edges.select("a", "b")
    for _ in range(rounds):
        step = materialize(near_labels(left), "labels")
        named = lambda c, step=step: step.select(F.col("node").alias(c), F.col("component").alias(f"l_{c}"))
        left = left.join(named("a"), "a").join(named("b"), "b").filter("l_a != l_b").select(F.greatest("l_a", "l_b").alias("a"), F.least("l_a", "l_b").alias("b")).distinct()
        left = materialize(left, "edges")
        onward = step.select(F.col("node").alias("component"), F.col("component").alias("to"))
        labels = step if labels is None else labels.join(onward, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(labels, "labels"), left
