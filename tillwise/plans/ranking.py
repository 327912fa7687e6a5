"""Top rows, overall or per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of every key. Spark applies the limit before the
    shuffle as well, so a hot key sends ``k`` rows per task."""
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")
