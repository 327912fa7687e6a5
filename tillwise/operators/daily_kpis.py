"""KPIs from stored daily partials: days are added once and never read in full again.

A day is stored as its money, orders and units, and as bitmaps of its customers, 32,768
ids each. Periods of any length are sums of days; the customers of a period are the union
of its days' bitmaps, and those of two periods follow from the sizes of both and of their
union. Days are kept in one directory a month; late sales are added by storing their month
again, which replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import timestamp
from .sales import kpi_rows

_SALES = "day date, sales decimal(28,4), orders long, units long, month string"
_BUYERS = "day date, bucket long, customers binary, month string"


def store_months(transactions: DataFrame, items: DataFrame, path: str, first, last) -> None:
    """Store the days of all months from that of ``first`` to that of ``last`` under ``path``;
    months that are there already are replaced, others stay. Only transactions of these months
    are read."""
    low = F.trunc(F.to_date(timestamp(first)), "month").cast("timestamp_ntz")
    high = F.date_add(F.last_day(F.to_date(timestamp(last))), 1).cast("timestamp_ntz")
    when = F.col("transaction_date")
    # The bounds are on the stored column, so the scan can skip row groups.
    some = transactions.where((when >= low) & (when < high)).select(
        "transaction_id", "customer_id", F.col("total_amount").cast("decimal(18,4)").alias("money"), F.to_date(when).alias("day"))
    units = items.select("transaction_id", "quantity").join(some.select("transaction_id", "day"), "transaction_id").groupBy(
        "day").agg(F.sum("quantity").cast("long").alias("units"))
    sales = some.groupBy("day").agg(F.sum("money").cast("decimal(28,4)").alias("sales"), F.count("*").alias("orders"))
    _replace(sales.join(units, "day", "left").select("day", "sales", "orders", "units"), f"{path}/sales")
    buyers = some.where("customer_id is not null").groupBy("day", F.bitmap_bucket_number("customer_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("customer_id")).alias("customers"))
    _replace(buyers, f"{path}/buyers")


def _replace(days: DataFrame, path: str) -> None:
    """Adaptive execution splits a large month over several files."""
    (days.withColumn("month", F.date_format("day", "yyyy-MM")).hint("rebalance", "month").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def stored_kpis(spark: SparkSession, path: str, inventory: DataFrame, end, days: int = 30) -> DataFrame:
    """What ``kpis`` says, from the days stored under ``path``; reads the months of
    3 * ``days`` of them."""
    last_day = F.to_date(timestamp(end))

    def recent(name: str, schema: str) -> DataFrame:
        rows = spark.read.schema(schema).parquet(f"{path}/{name}")
        rows = rows.where(F.col("month") >= F.date_format(F.date_sub(last_day, 3 * days), "yyyy-MM"))
        rows = rows.where((F.col("day") > F.date_sub(last_day, 3 * days)) & (F.col("day") <= last_day))
        return rows.withColumn("period", F.floor(F.datediff(last_day, "day") / days).cast("int"))

    def whole(column: str, period: int, name: str) -> Column:
        return F.sum(F.when(F.col("period") == period, F.col(column))).alias(f"{name}{period}")

    sums = recent("sales", _SALES).agg(F.struct(
        *[whole("sales", p, "sales").cast("double").alias(f"sales{p}") for p in (0, 1)],
        *[F.coalesce(whole("orders", p, "orders"), F.lit(0)).alias(f"orders{p}") for p in (0, 1)]).alias("s"))
    units = recent("sales", _SALES).agg(F.struct(*[whole("units", p, "units") for p in (0, 1)]).alias("s"))
    # Unions of single periods, and of each with the one before.
    unions = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(10), F.lit(21)), lambda u: F.when(
        (u == F.col("period")) | (F.floor(u / 10) == F.col("period")) & (u > 9) | (u % 10 == F.col("period")) & (u > 9), u))
    customers = recent("buyers", _BUYERS).select("bucket", "customers", F.explode(F.array_compact(unions)).alias("of")).groupBy(
        "of", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("customers")).alias("n"))
    size = lambda u: F.coalesce(F.sum(F.when(F.col("of") == u, F.col("n"))), F.lit(0))
    kept = customers.agg(F.struct(
        (size(0) + size(1) - size(10)).alias("back0"), size(1).alias("base0"),
        (size(1) + size(2) - size(21)).alias("back1"), size(2).alias("base1")).alias("s"))
    return kpi_rows(spark, sums, kept, units, inventory)
