"""Mixing sources to target weights by repeating and dropping whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.sketch import unused
from tillwise.plans.durable import written_once

#: Hex digits of the document's hash that make its uniform number.
_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, _DIGITS), 16, 10).cast("double") / float(16 ** _DIGITS)


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """``sizes`` (source, size) -> source, source_size, target.

    Sources in code point order, null last, get ``weights`` in turn. Targets are
    proportional to the weights and sum up to ``share`` of all sizes. A target above
    ``most`` times its source stops there and the rest is shared out again. That ends
    in one level for all others, found here without iterating: sorted by the level at
    which they stop, the sources that stop are a prefix.

    One row per source goes through the windows; documents never do.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int"))
    limit = F.col("source_size") * most
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = (totals.withColumn("weight", weight).withColumn("limit", limit)
               .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
               .withColumn("weights", F.sum("weight").over(everything))
               .withColumn("rest", F.col("wanted") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
               .withColumn("free", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
               # rest / free is the level if exactly the sources before this one stop.
               .withColumn("stops", F.col("rest") * F.col("weight") > F.col("limit") * F.col("free"))
               .withColumn("level_rest", F.min(F.when(~F.col("stops"), F.struct(
                   F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "rest", "free"))).over(everything)))
    level = F.col("level_rest.rest") * F.col("weight") / F.col("level_rest.free")
    return weighed.select("source", "source_size", F.when(F.col("stops"), F.col("limit").cast("double"))
                          .otherwise(level).alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    return written_once(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")


def _with_copies(rows: DataFrame, sized: DataFrame, weights: Sequence[int], share: float, most: int,
                 seed: int) -> tuple[DataFrame, list[str]]:
    """``rows`` with their source's size and target, and copies, and the names of the three.
    The targets are written first: read back, their size is known and decides whether they
    are broadcast."""
    of, size, target, copies = unused(rows, "of", "source_size", "target", "copies")
    targets = written_once(source_targets(sized, weights, share, most).select(
        F.col("source").alias(of), F.col("source_size").alias(size), F.col("target").alias(target)), "targets")
    rate = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return rows.join(targets, F.col("source").eqNullSafe(F.col(of))).withColumn(
        copies, whole + (uniform(F.col("doc_id"), seed) < rate - whole).cast("long")), [size, target, copies]


def mixture(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2,
            seed: int = 0) -> DataFrame:
    """``docs`` (doc_id, text, source) -> one row per document: doc_id, source, size,
    source_size, target, copies, taken.

    A source is repeated ``target / source_size`` times: each document the whole part
    of that rate, and once more where its hash falls below the fraction. Reruns and
    re-tried tasks agree, as nothing but the id and the seed is drawn from.

    A null or empty text has size 0, and may be copied: it costs no words. A source
    without words has the rate 0. Rows with the same doc_id are copied alike. Null is a
    source of its own. Columns beside the three are not read.
    """
    sized = _sized(docs)
    copied, names = _with_copies(sized, sized, weights, share, most, seed)
    return copied.select("doc_id", "source", "size", *names, (F.col(names[-1]) * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2,
               seed: int = 0) -> DataFrame:
    """Every document as often as ``mixture`` takes it: the columns of ``docs``, and
    ``copy``, counted from 0, in place of any column of that name in any case. Other
    columns may have any names."""
    rows = docs.drop(*[c for c in docs.columns if c.lower() == "copy"])
    copied, names = _with_copies(rows, _sized(docs), weights, share, most, seed)
    copies = F.col(names[-1])
    return copied.filter(copies > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1))).drop(*names, *unused(rows, "of"))
