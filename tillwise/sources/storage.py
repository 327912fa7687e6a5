"""Reading from a live database, and writing tables and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_database(spark: SparkSession, url: str, table: str, *, key: str, low: int, high: int,
                  partitions: int = 64, **options: str) -> DataFrame:
    """A table of a live database, read in parallel key ranges over JDBC.

    Filters and column lists are pushed into the generated query. Needs the
    database's JDBC driver on the class path.
    """
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high,
                           numPartitions=partitions, properties=dict(options))


def write_by_month(transactions: DataFrame, path: str) -> None:
    """Transactions laid out by month, so that a date range prunes directories.

    Adaptive execution measures the months and splits or joins them to files of
    its advisory size, so a busy month is not one task and a small one few files.
    """
    month = F.date_format("transaction_date", "yyyy-MM")
    (transactions.withColumn("month", month).hint("rebalance", "month")
     .write.mode("overwrite").partitionBy("month").parquet(path))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A catalog table bucketed and sorted by ``key``. Headers and lines written
    with the same key and bucket count are joined without a shuffle."""
    (df.write.mode("overwrite").format("parquet")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))


def first_per_key(records: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One record per key: the smallest by ``order_by``, then by all columns.

    An aggregate, not a window: repeated keys are reduced before the shuffle, so
    a key that fills a third of the batch stays cheap.
    """
    rest = [c for c in records.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in [*order_by, *[c for c in rest if c not in order_by]]])
    best = records.groupBy(*keys).agg(F.min(rank).alias("_first"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c)
                         for c in records.columns])


def load_new_records(records: DataFrame, path: str, keys: Sequence[str],
                     order_by: Sequence[str] = ()) -> None:
    """Append the records whose key is not in the parquet table at ``path``.

    Existing keys win and repeated keys in the batch give one row, so running a
    load twice changes nothing. The check and the append are two steps: two
    writers at the same time need a table format with MERGE.
    """
    fresh = first_per_key(records, keys, order_by)
    target = _existing(records.sparkSession, path)
    if target is not None:
        fresh = fresh.join(target.select(*keys), list(keys), "left_anti")
    fresh.select(*records.columns).write.mode("append").parquet(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
