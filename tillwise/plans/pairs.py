"""Counting which items meet in the same group (basket, customer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Items of one group that meet in one cell. A larger group is cut into blocks,
# and every two of its blocks are a cell of their own.
BLOCK = 256


def item_pairs(df: DataFrame, group: str, item: str, weight: str | None = None, *,
               block: int = BLOCK) -> DataFrame:
    """``(a, b, together, dot)`` for items ``a < b`` sharing at least one group.

    ``together`` counts the groups, ``dot`` sums the product of the weights.
    ``df`` holds a (group, item) at most once. Every pair that meets is a row of
    the result, so work follows the result; pairs are summed in the task that
    makes them, before the shuffle.
    """
    amount = F.col(weight) if weight else F.lit(1)
    met = _meetings(df, group, item, amount, block)
    return met.groupBy(*_ordered()).agg(
        F.count(F.lit(1)).alias("together"), F.sum(F.col("wx") * F.col("wy")).alias("dot"))


def _ordered():
    return F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")


def _meetings(df: DataFrame, group: str, item: str, extra: Column, block: int) -> DataFrame:
    """``(x, y, wx, wy)`` once for every group in which two items meet.

    A group of up to ``block`` items is gathered and paired where its rows are. One with
    more is spread over as many join keys as it has pairs of blocks: no task receives
    more than two blocks of it.
    """
    rows = df.where(F.col(group).isNotNull()).select(
        F.col(group).alias("g"), F.col(item).alias("i"), extra.alias("w"))
    large = (rows.groupBy("g").count().where(F.col("count") > block)
             .select("g", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    few = (rows.join(large, "g", "left_anti").groupBy("g").agg(F.collect_list(F.struct("i", "w")).alias("members"))
           .select("members", F.inline("members").alias("x", "wx"))
           .withColumn("later", F.filter("members", lambda other: F.col("x") < other["i"]))
           .select("x", "wx", F.inline("later").alias("y", "wy")))
    many = rows.join(large, "g").withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    left = many.select("g", F.col("own").alias("lo"),
                       F.explode(F.sequence("own", F.col("blocks") - 1)).alias("hi"),
                       F.col("i").alias("x"), F.col("w").alias("wx"))
    right = many.select("g", F.explode(F.sequence(F.lit(0), "own")).alias("lo"),
                        F.col("own").alias("hi"), F.col("i").alias("y"), F.col("w").alias("wy"))
    spread = left.join(right, ["g", "lo", "hi"]).where((F.col("lo") < F.col("hi")) | (F.col("x") < F.col("y")))
    return few.unionByName(spread.select("x", "wx", "y", "wy"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Unordered pairs in both orders."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(
        F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")),
                         F.struct(F.col("b").alias("a"), F.col("a").alias("b")))), *rest)


def partners_of(df: DataFrame, group: str, item: str, anchor) -> DataFrame:
    """``(item, together)``: how many groups each other item shares with one.

    The groups of the anchor are looked up, then their items are counted: work
    is linear in the rows, and no pairs are built.
    """
    groups = df.where(F.col(item) == anchor).select(group).distinct()
    return (
        df.where(F.col(item) != anchor).join(groups, group, "left_semi")
        .select(group, item).distinct()
        .groupBy(item).agg(F.count(F.lit(1)).alias("together"))
    )
