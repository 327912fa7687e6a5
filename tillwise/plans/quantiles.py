"""Exact quantiles of large columns without gathering or sorting them.

``percentile`` keeps every distinct value of a column in one aggregation buffer; over all
customers that buffer is the table. Here values become whole numbers of 64 bits in the
same order, and the wanted ranks are closed in on from the top bits down: a round counts
the rows by the next 16 bits, of those only whose higher bits are right, and keeps the
counts in which a wanted rank lies. Four rounds reach the last bit of any double; where no
more than 2^16 rows are left, all their bits are looked at at once. A round shuffles at most
2^16 counts for a column and rank, however many rows and distinct values there are.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from math import ceil, floor, inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import written_once

#: Bits that a round looks at.
ROUND_BITS = 16


def ordered_bits(value: Column) -> Column:
    """A double as a long in the same order; NaN comes last, both zeros are 0."""
    size = F.abs(value)
    power = F.floor(F.log2(size))
    # The logarithm may be off by one beside powers of two.
    power = (F.when(size < F.pow(F.lit(2.0), power), power - 1)
             .when(size >= F.pow(F.lit(2.0), power + 1), power + 1).otherwise(power))
    fraction = size / F.pow(F.lit(2.0), power) - 1
    normal = (power + 1023) * (1 << 52) + (fraction * (1 << 52)).cast("long")
    bits = (F.when(F.isnan(value), F.lit(0x7FF8 << 48)).when(size == inf, F.lit(0x7FF << 52))
            .when(size < 2.0 ** -1022, (size * 2.0 ** 537 * 2.0 ** 537).cast("long")).otherwise(normal)).cast("long")
    return F.when(value < 0, -bits).otherwise(bits)


def ordered_value(bits: int) -> float:
    """The double of ``ordered_bits``."""
    value = struct.unpack(">d", abs(bits).to_bytes(8, "big"))[0]
    return -value if bits < 0 else value


def _round(values: DataFrame, wanted: list[tuple[int, int, int, int, int]], known: int) -> list:
    """Of ``wanted`` (column, top ``known`` bits, rows before them, rows, rank): the counts by
    the next bits in which the ranks lie, as (column, bits, rows before, rows, least, most, rank)."""
    spark = values.sparkSession
    prefixes = sorted({(c, p, before, n <= 1 << ROUND_BITS) for c, p, before, n, _ in wanted})
    head = F.shiftright("bits", 64 - known) if known else F.lit(0).cast("long")
    rows = values.withColumn("head", head).join(F.broadcast(spark.createDataFrame(
        prefixes, "column int, head long, before long, whole boolean")), ["column", "head"])
    bits = F.when(F.col("whole"), F.col("bits")).otherwise(F.shiftright("bits", 64 - known - ROUND_BITS))
    counts = rows.groupBy("column", "head", "before", bits.alias("next")).agg(
        F.count("*").alias("n"), F.min("bits").alias("least"), F.max("bits").alias("most"))
    order = Window.partitionBy("column", "head").orderBy("next")
    upto = F.col("before") + F.sum("n").over(order)
    ranks = F.broadcast(spark.createDataFrame([(c, p, rank) for c, p, _, _, rank in wanted], "column int, head long, rank long"))
    found = counts.withColumn("upto", upto).join(ranks, ["column", "head"]).where(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return found.select("column", "next", (F.col("upto") - F.col("n")).alias("before"), "n", "least", "most", "rank").collect()


def _few(values: DataFrame, ends: dict[int, tuple[int, int]]) -> set[int]:
    """Columns with fewer than four distinct values: at most one lies between the ends."""
    apart = [(c, least, most) for c, (least, most) in ends.items() if least < most]
    if not apart:
        return set(ends)
    held = F.broadcast(values.sparkSession.createDataFrame(apart, "column int, least long, most long"))
    inner = values.join(held, "column").where((F.col("bits") > F.col("least")) & (F.col("bits") < F.col("most")))
    more = inner.groupBy("column").agg((F.min("bits") < F.max("bits")).alias("more")).where("more").collect()
    return set(ends) - {r["column"] for r in more}


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row ``(<column>_q array<double>, <column>_few boolean, ...)``.

    Quantiles interpolate linearly between the two nearest ranks. ``_few`` says
    that a column has fewer than four distinct values. Nulls are not allowed in
    the columns; of an empty table the quantiles are null. Runs jobs when called.
    """
    spark, columns, probabilities = df.sparkSession, list(columns), list(probabilities)
    both = F.array(*[F.struct(F.lit(i).alias("column"), ordered_bits(F.col(c).cast("double")).alias("bits"))
                     for i, c in enumerate(columns)])
    values = written_once(df.select(F.inline(both)), "values")
    ends = {r["column"]: tuple(r)[1:] for r in values.groupBy("column").agg(
        F.min("bits"), F.max("bits"), F.count("*")).collect()}
    n = ends[0][2] if ends else 0
    places = [p * (n - 1) for p in probabilities] if n else []
    ranks = {r for place in places for r in (floor(place), ceil(place))}
    wanted, found = [(c, 0, 0, n, rank) for c in range(len(columns)) for rank in ranks], {}
    for known in range(0, 64, ROUND_BITS):
        later = []
        for column, bits, before, rows, least, most, rank in _round(values, wanted, known) if wanted else []:
            # The ends of a count are values; between them only more bits can tell.
            if least == most or rank == before:
                found[column, rank] = ordered_value(least)
            else:
                later.append((column, bits, before, rows, rank))
        wanted = later
    few = _few(values, {c: e[:2] for c, e in ends.items()})
    out = []
    for c, name in enumerate(columns):
        between = [found[c, floor(x)] + (found[c, ceil(x)] - found[c, floor(x)]) * (x - floor(x)) for x in places]
        quantiles = F.array(*map(F.lit, between)) if places else F.lit(None)
        out += [quantiles.cast("array<double>").alias(f"{name}_q"), F.lit(c in few or not n).alias(f"{name}_few")]
    return spark.range(1).select(*out)


def quartile_score(value: Column, edges: Column, few: Column, *, descending: bool = False) -> Column:
    """Quartile 1-4 of a value, 2 for everyone where there are too few values.

    Ties never straddle a quartile, and equal edges need no special case.
    """
    above = sum(((value > edges[i]).cast("int") for i in range(3)), F.lit(0))
    return F.when(few, 2).otherwise(4 - above if descending else 1 + above)
