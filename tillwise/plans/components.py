"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.plans.durable import written_once


def _hung(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with b < a.

    The smallest neighbour of every node is an aggregate and the rest a join, so
    a node with very many neighbours is reduced before the shuffle and its join
    partition can be split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.filter("b < a").distinct()


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal edge sets, in one number per task."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node
    that can be reached. Edges may repeat, run either way or be loops; a node
    known from loops alone is its own component.

    Each round is written to the shared folder. Rounds grow with the logarithm
    of the longest path, not with the number of edges.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now = written_once(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .filter("b < a").distinct(), "edges")
    before, state = None, _digest(now)
    while state != before:
        now = written_once(_hung(_hung(now, large=True), large=False), "edges")
        before, state = state, _digest(now)
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
