"""Transactions, lines, products, and the figures of the sales overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import days_before, exact, exact_sum, timestamp


def _between(start, end) -> Column:
    """Whether a transaction lies in a range whose ends are included; None is open."""
    when, inside = F.col("transaction_date"), F.lit(True)
    if start is not None:
        inside = inside & (when >= timestamp(start))
    return inside if end is None else inside & (when <= timestamp(end))


def extract_transactions(transactions: DataFrame, customers: DataFrame, stores: DataFrame,
                         staff: DataFrame, start, end) -> DataFrame:
    """Transactions from ``start`` to ``end`` (both included, None for no bound) with
    the names of customer, store and staff; those without one keep nulls."""
    person = lambda df, key, prefix: df.select(
        F.col(key).alias(f"_{key}"), F.col("first_name").alias(f"{prefix}first_name"),
        F.col("last_name").alias(f"{prefix}last_name"))
    shops = stores.select(F.col("store_id").alias("_store_id"), F.col("name").alias("store_name"))
    return (
        transactions.where(_between(start, end))
        .join(person(customers, "customer_id", ""), F.col("customer_id") == F.col("_customer_id"), "left")
        .join(shops, F.col("store_id") == F.col("_store_id"), "left")
        .join(person(staff, "staff_id", "staff_"), F.col("staff_id") == F.col("_staff_id"), "left")
        .select("transaction_id", "transaction_date", "total_amount", "payment_method",
                F.col("_customer_id").alias("customer_id"), "first_name", "last_name",
                F.col("_store_id").alias("store_id"), "store_name",
                F.col("_staff_id").alias("staff_id"), "staff_first_name", "staff_last_name")
    )


def calendar_features(extracted: DataFrame) -> DataFrame:
    """Adds weekday name, month name and hour of the transaction."""
    when = F.col("transaction_date")
    return extracted.withColumns({
        "day_of_week": F.date_format(when, "EEEE"),
        "month": F.date_format(when, "MMMM"),
        "hour": F.hour(when),
    })


def transaction_lines(transactions: DataFrame, items: DataFrame, newest_first: bool = False) -> DataFrame:
    """Lines with the head of their transaction. Sorting a large result costs a
    range shuffle; ask for it only where the order is used."""
    lines = transactions.select(
        "transaction_id", "transaction_date", "customer_id", "store_id", "total_amount",
    ).join(items.select("transaction_id", "product_id", "quantity", "unit_price"), "transaction_id")
    return lines.orderBy(F.col("transaction_date").desc(), "transaction_id", "product_id") if newest_first else lines


def product_catalog(products: DataFrame) -> DataFrame:
    return products.select("product_id", "sku", "name", "description", "category", "subcategory",
                           "unit_cost", "unit_price", "reorder_point", "reorder_quantity")


def product_list(products: DataFrame) -> DataFrame:
    return products.select("product_id", "name", "category").orderBy("name", "product_id")


def daily_sales_trend(transactions: DataFrame) -> DataFrame:
    """Sales and number of transactions per day."""
    return transactions.groupBy(F.to_date("transaction_date").alias("day")).agg(
        exact_sum("total_amount").alias("sales"), F.count("transaction_id").alias("orders"))


def kpis(transactions: DataFrame, items: DataFrame, inventory: DataFrame, end, days: int = 30) -> DataFrame:
    """``(metric, value, previous, change)`` of the last ``days`` days up to and
    including ``end`` against the ``days`` before.

    Retention is the share of a period's customers who buy again in the next
    one; turnover is units sold over units on hand. ``change`` is in percent of
    the value, so that ``previous = value * (1 - change / 100)``.
    """
    last_day = F.to_date(timestamp(end))
    age = F.datediff(last_day, F.to_date("transaction_date"))
    when, day_after = F.col("transaction_date"), F.date_add(last_day, 1).cast("timestamp_ntz")
    # Period 0 is the current one; period 2 only serves the previous retention.
    # The bounds are on the stored column, so the scan can skip row groups.
    periods = (
        transactions.where((when >= days_before(day_after, 3 * days)) & (when < day_after))
        .select("transaction_id", "customer_id", "total_amount",
                F.floor(age / days).cast("int").alias("period"))
    )
    in_period = lambda p: F.col("period") == p
    money = exact("total_amount")
    sales = periods.agg(F.struct(*[
        column for p in (0, 1) for column in (
            F.sum(F.when(in_period(p), money)).cast("double").alias(f"sales{p}"),
            F.count_if(in_period(p)).alias(f"orders{p}"))]).alias("s"))
    seen = periods.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        *[F.max(in_period(p)).alias(f"p{p}") for p in (0, 1, 2)])
    kept = seen.agg(F.struct(
        F.count_if(F.col("p0") & F.col("p1")).alias("back0"), F.count_if("p1").alias("base0"),
        F.count_if(F.col("p1") & F.col("p2")).alias("back1"), F.count_if("p2").alias("base1"),
    ).alias("s"))
    units = (
        items.select("transaction_id", "quantity")
        .join(periods.where("period < 2").select("transaction_id", "period"), "transaction_id")
        .agg(F.struct(*[F.sum(F.when(in_period(p), F.col("quantity"))).alias(f"units{p}")
                        for p in (0, 1)]).alias("s"))
    )
    return kpi_rows(transactions.sparkSession, sales, kept, units, inventory)


def kpi_rows(spark: SparkSession, sales: DataFrame, kept: DataFrame, units: DataFrame, inventory: DataFrame) -> DataFrame:
    """The four KPIs from one struct each of sales and orders, customers who came back, and
    units, by period."""
    one_row = spark.range(1).select(
        sales.scalar().alias("sales"), kept.scalar().alias("kept"), units.scalar().alias("units"),
        inventory.agg(F.sum("quantity")).scalar().alias("on_hand"))
    sales, kept, units, on_hand = (F.col(name) for name in one_row.columns)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b)

    def metric(name: str, value: Column, previous: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), value.alias("value"), previous.alias("previous"))

    rows = F.array(
        metric("total_sales", zero(sales["sales0"]), zero(sales["sales1"])),
        metric("average_transaction", ratio(sales["sales0"], sales["orders0"]),
               ratio(sales["sales1"], sales["orders1"])),
        metric("retention_rate", ratio(kept["back0"], kept["base0"]), ratio(kept["back1"], kept["base1"])),
        metric("inventory_turnover", ratio(units["units0"], on_hand), ratio(units["units1"], on_hand)))
    return one_row.select(F.inline(rows)).withColumn(
        "change", F.try_divide(F.col("value") - F.col("previous"), F.col("value")) * 100)


def store_performance(transactions: DataFrame, stores: DataFrame, start, end) -> DataFrame:
    """Sales, transactions and their mean for every store in a date range (None for
    no bound); ``performance`` is a store's sales over the mean of the stores. Sales
    of no known store are in neither."""
    sold = (
        transactions.where(_between(start, end))
        .groupBy("store_id").agg(exact_sum("total_amount").alias("sales"),
                                 F.count("transaction_id").alias("orders"))
    )
    rows = stores.join(sold, "store_id", "left").select(
        "store_id", F.col("name").alias("store_name"), "state",
        F.coalesce("sales", F.lit(0.0)).alias("sales"),
        F.coalesce("orders", F.lit(0).cast("long")).alias("orders"))
    mean = rows.agg((exact_sum("sales") / F.count(F.lit(1))).alias("mean")).scalar()
    return rows.withColumn("average_sale", F.try_divide(F.col("sales"), F.col("orders"))).withColumn(
        "performance", F.try_divide(F.col("sales"), mean))
