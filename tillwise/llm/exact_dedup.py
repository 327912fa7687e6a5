"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.sketch import position, positions, split_by_id, unused
from tillwise.plans.durable import written_once

#: Characters of the normalised text whose hash is the second key.
PREFIX = 128
_KEY = ["length", "prefix"]


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_dedup(docs: DataFrame, digests: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per document: doc_id, keep_id, group_size,
    kept, text_sha256.

    Texts are equal when their normalised texts are. Of equal texts the one with the
    most characters, then the smallest doc_id, stays (a null doc_id comes last).

    Each step looks only at what the one before could not tell apart: texts whose
    length is unique are done, then those whose (length, prefix hash) is. The keys
    are read once and kept. The last step reads the texts again; a text is hashed in
    full only if its key may be among those left, and no text is shuffled.
    ``text_sha256`` is null for texts that never had to be hashed, unless ``digests``.

    Null and empty texts are equal. Rows with the same doc_id and text are members of
    one group; if theirs is the doc_id that stays, all of them are ``kept``. Columns
    beside doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    text = normalised(F.col("text"))
    keyed = docs.select("doc_id", text.alias("_t")).select(
        F.length("_t").alias("length"), F.xxhash64(F.substring("_t", 1, PREFIX)).alias("prefix"))
    counts = written_once(keyed.groupBy(*_KEY).agg(F.count("*").alias("rows")), "lengths")
    lengths = counts.groupBy("length").agg(F.sum("rows").alias("of_length")).filter("of_length > 1")
    left = counts.filter("rows > 1").join(lengths, "length", "left_semi").select(*_KEY)
    maybe = positions(left).withColumn("maybe", F.lit(True))

    again = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), text.alias("_t")).select(
        "doc_id", "chars", "_t", F.length("_t").alias("length"), F.xxhash64(F.substring("_t", 1, PREFIX)).alias("prefix"))
    marked = again.join(F.broadcast(maybe), position(F.col("length"), F.col("prefix")) == maybe["position"], "left")
    hashed = F.sha2(F.col("_t"), 256)
    rows = written_once(marked.select(
        "doc_id", "chars", *_KEY, F.coalesce("maybe", F.lit(False)).alias("maybe"),
        (hashed if digests else F.when(F.col("maybe"), hashed)).alias("text_sha256")), "hashes")

    rank = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id")
    groups = (rows.filter("maybe").groupBy(*_KEY, "text_sha256")
              .agg(F.count("*").alias("size"), F.min(rank).alias("best")).filter("size > 1")
              .select(*_KEY, "text_sha256", "size", F.col("best.doc_id").alias("best_id"), F.lit(True).alias("grouped")))
    keep = F.when(F.col("grouped"), F.col("best_id")).otherwise(F.col("doc_id"))
    return rows.join(groups, [*_KEY, "text_sha256"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows with the
    doc_id and text that stay, one. Only texts that have a duplicate are shuffled. Other
    columns may have any names."""
    sha, gone_id, gone_sha = unused(docs, "sha", "gone_id", "gone_sha")
    groups = exact_dedup(docs).filter("group_size > 1")
    lost = written_once(groups.select("doc_id", "text_sha256", "kept"), "duplicates")
    apart, maybe = split_by_id(docs, lost.select("doc_id"))
    gone = lost.filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct()
    maybe = maybe.withColumn(sha, F.sha2(normalised(F.col("text")), 256))
    stay = maybe.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha)), "left_anti")
    return apart.unionByName(stay.dropDuplicates(["doc_id", sha]).drop(sha))
