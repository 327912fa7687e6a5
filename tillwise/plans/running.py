"""A running total over a whole table, without one task sorting all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import exact
from .durable import written_once

#: Rows of a range, about, and ranges that hang on one node.
ROWS_PER_RANGE, NODE = 1 << 20, 1024
#: Sampled keys for each range.
SAMPLES_PER_RANGE = 64


def _halved(df: DataFrame, edges: str, most: int, name: str) -> DataFrame:
    """``df`` with ``name``: the number of ``edges`` at or before its key, found by halving.
    Plain expressions stay in generated code, where the edges are one shared object; a
    lambda over them would copy them into every row."""
    df = df.withColumn(name, F.lit(0))
    for step in (1 << n for n in reversed(range(most.bit_length()))):
        here = F.col(name)
        df = df.withColumn(name, F.when(F.get(edges, here + (step - 1)) <= F.col("_key"), here + step).otherwise(here))
    return df


def running_total(df: DataFrame, value: str, order: Sequence[Column], *,
                  ranges: int | None = None) -> DataFrame:
    """``df`` with ``running`` (inclusive running sum of ``value``) and ``total``.

    ``order`` is ascending and must identify a row; negate a number to sort it
    downwards. Rows are cut into key ranges whose edges come from a hash sample,
    so a value shared by many rows is split by the later keys. Each range is
    summed on its own and shifted by the sum of the ranges before it. The edges
    decide how the work is spread, not the result, and depend only on the data,
    so a task that is run again lands in the same range. Sums are decimals for
    the same reason.

    The number of ranges follows the number of rows. Beyond ``NODE`` of them they hang on
    nodes: a row finds its node first and then its range there, the sample is sorted node by
    node, and ranges are added up within their node, nodes after that. The rows are written
    once, when called, as they are gone through several times.
    """
    spark = df.sparkSession
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    keyed = written_once(df.withColumn("_key", key).withColumn("_amount", exact(value)), "keyed")
    n, amount = keyed.agg(F.count(F.lit(1)), F.sum("_amount").cast("double")).first()
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_RANGE))
    nodes = min(ranges, NODE)
    each = -(-ranges // nodes)

    def sample(parts: int) -> DataFrame:
        return keyed.where(F.pmod(F.xxhash64("_key"), F.lit(max(1, n // (parts * SAMPLES_PER_RANGE)))) == 0)

    def tiles(rows: DataFrame, parts: int, *inside: str) -> DataFrame:
        tile = F.ntile(parts).over(Window.partitionBy(*inside).orderBy("_key"))
        first = rows.withColumn("tile", tile).groupBy(*inside, "tile").agg(F.min("_key").alias("edge"))
        return first.groupBy(*inside).agg(F.sort_array(F.collect_list("edge")).alias("_edges"))

    top = tiles(sample(nodes).select("_key"), nodes).scalar()
    into_nodes = lambda rows: _halved(rows.withColumn("_edges", top), "_edges", nodes, "_node").drop("_edges")
    keyed, place = into_nodes(keyed), ["_node"]
    if each > 1:
        # A row per node, and in all a key per range.
        below = F.broadcast(tiles(into_nodes(sample(ranges)).select("_node", "_key"), each, "_node"))
        keyed = _halved(keyed.join(below, "_node", "left"), "_edges", each, "_range").drop("_edges")
        place = ["_node", "_range"]

    # A row per range, whatever the table holds: safe to broadcast.
    sums = keyed.groupBy(*place).agg(F.sum("_amount").alias("_sum"))
    earlier = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.groupBy("_node").agg(F.sum("_sum").alias("_sum")).select(
        "_node", earlier(Window.orderBy("_node")).alias("_before"))
    if each > 1:
        inner = sums.select("_node", "_range", earlier(Window.partitionBy("_node").orderBy("_range")).alias("_inner"))
        offsets = inner.join(F.broadcast(offsets), "_node").select("_node", "_range", (F.col("_before") + F.col("_inner")).alias("_before"))

    # Ordered by the key's parts: numbers sort faster than a struct of them.
    inside = (Window.partitionBy(*place).orderBy(*[F.col(f"_key.k{i}") for i in range(len(order))])
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        keyed.join(F.broadcast(offsets), place)
        .withColumn("running", (F.col("_before") + F.sum("_amount").over(inside)).cast("double"))
        .withColumn("total", F.lit(amount).cast("double"))
        .drop("_node", "_range", "_key", "_amount", "_before")
    )
