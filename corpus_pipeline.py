"""A corpus from raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwise.llm.decontamination import without_contaminated
from tillwise.llm.exact_dedup import without_duplicates
from tillwise.llm.jaccard_join import one_per_group
from tillwise.llm.mixing import mixed_rows
from tillwise.llm.queries import toxic_lexicon
from tillwise.llm.toxicity import without_toxic
from tillwise.plans.durable import written_once

#: Learned and hashed steps: SQL does not express them.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3."""
    return without_toxic(docs, toxic_lexicon(spark, docs, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts."""
    return without_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, counted in ``copy``."""
    return mixed_rows(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join),
          ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's rows written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written_once(docs, name)
    return docs
