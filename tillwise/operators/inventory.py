"""Stock value, ABC classes, order quantities and reorder advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    elapsed_days, exact_sum, half_even, normal_quantile, sample_std, timestamp,
)
from ..plans.running import running_total

# Cost of one order, and yearly holding cost as a share of unit cost.
ORDERING_COST = 50
HOLDING_COST_RATE = 0.2


def _at_store(inventory: DataFrame, store_id: int | None) -> DataFrame:
    return inventory if store_id is None else inventory.where(F.col("store_id") == store_id)


def _status(quantity: str = "quantity", reorder_point: str = "reorder_point") -> Column:
    return F.when(F.col(quantity) <= F.col(reorder_point), "Low Stock").otherwise("Adequate")


def inventory_metrics(inventory: DataFrame, products: DataFrame, store_id: int | None = None) -> DataFrame:
    """Value, possible sales and status of each stock row."""
    return (
        _at_store(inventory, store_id).select("product_id", "store_id", "quantity")
        .join(products.select("product_id", "reorder_point", "reorder_quantity", "unit_cost", "unit_price"),
              "product_id")
        .withColumns({
            "stock_value": F.col("quantity") * F.col("unit_cost"),
            "potential_sales_value": F.col("quantity") * F.col("unit_price"),
            "stock_status": _status(),
        })
    )


def abc_analysis(metrics: DataFrame) -> DataFrame:
    """ABC category by running share of stock value, largest values first.

    Equal values are ordered by product and store.
    """
    share = F.try_divide(F.col("running"), F.col("total")) * 100
    return (
        running_total(metrics, "stock_value",
                      [-F.col("stock_value"), F.col("product_id"), F.col("store_id")])
        .withColumn("cumulative_value", F.col("running"))
        .withColumn("cumulative_percentage", share)
        .withColumn("abc_category",
                    F.when(F.col("cumulative_percentage") <= 80, "A")
                    .when(F.col("cumulative_percentage") <= 95, "B").otherwise("C"))
        .drop("running", "total")
    )


def eoq(annual_demand: Column, ordering_cost: Column, holding_cost: Column) -> Column:
    """Economic order quantity; 0 where demand or holding cost is not positive."""
    usable = (annual_demand > 0) & (holding_cost > 0)
    return F.when(usable, F.sqrt(F.try_divide(2 * annual_demand * ordering_cost, holding_cost))).otherwise(
        F.lit(0.0))


def safety_stock(lead_time: int, service_level: float, demand_std: Column) -> Column:
    return F.lit(normal_quantile(service_level)) * demand_std * F.sqrt(F.lit(float(lead_time)))


def _demand_per_line(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id").agg(
        F.avg("quantity").alias("daily"), F.coalesce(sample_std(F.col("quantity")), F.lit(0.0)).alias("std"))


def _demand_per_day(sales: DataFrame, days: int) -> DataFrame:
    """Moments over all calendar days of the window, days without sales as 0."""
    per_day = sales.groupBy("product_id", F.to_date("transaction_date").alias("day")).agg(
        F.sum("quantity").alias("sold"))
    total = F.sum("sold").cast("double")
    squares = F.sum((F.col("sold") * F.col("sold")).cast("decimal(18,0)")).cast("double")
    spread = F.greatest(days * squares - total * total, F.lit(0.0))
    return per_day.groupBy("product_id").agg(
        (total / days).alias("daily"),
        F.sqrt(spread / float(days * max(days - 1, 1))).alias("std"))


def optimize_inventory(stock: DataFrame, sales: DataFrame, lead_time: int = 7,
                       service_level: float = 0.95, demand_basis: str = "line",
                       days: int = 365) -> DataFrame:
    """Order quantity, safety stock and reorder point of each stock row whose
    product was sold.

    ``stock`` holds product, store, quantity, unit cost and reorder point.
    ``demand_basis='line'`` takes the mean quantity of a sales line as the daily
    demand; ``'calendar_day'`` takes the mean over the ``days`` of the window.
    """
    if demand_basis not in ("line", "calendar_day"):
        raise ValueError(f"unknown demand basis {demand_basis!r}")
    demand = _demand_per_line(sales) if demand_basis == "line" else _demand_per_day(sales, days)
    safety = safety_stock(lead_time, service_level, F.col("std"))
    return (
        stock.select("product_id", "store_id", "quantity", "unit_cost", "reorder_point")
        .join(demand, "product_id")
        .select(
            "product_id", "store_id",
            F.col("quantity").alias("current_quantity"),
            eoq(F.col("daily") * 365, F.lit(ORDERING_COST),
                F.col("unit_cost") * HOLDING_COST_RATE).alias("eoq"),
            safety.alias("safety_stock"),
            (F.col("daily") * lead_time + safety).alias("reorder_point"),
            F.col("reorder_point").alias("current_reorder_point"))
    )


def stock_values(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """Stock rows with product details, value, possible revenue and margin."""
    return (
        products.select("product_id", "name", "category", "unit_cost", "unit_price",
                        "reorder_point", "reorder_quantity")
        .join(inventory.select("product_id", "quantity", "store_id"), "product_id")
        .withColumns({
            "total_value": F.col("unit_cost") * F.col("quantity"),
            "potential_revenue": F.col("unit_price") * F.col("quantity"),
            "profit_margin": F.col("unit_price") - F.col("unit_cost"),
        })
    )


def inventory_abc(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """``stock_values`` with the ABC class by fixed share edges (0, 80], (80, 95],
    (95, 100]; outside of them the class is C. Largest values come first."""
    share = half_even(F.try_divide(F.col("running"), F.col("total")) * 100)
    return (
        running_total(stock_values(inventory, products), "total_value",
                      [-F.col("total_value"), F.col("product_id"), F.col("store_id")])
        .withColumn("cumulative_value", F.col("running"))
        .withColumn("cumulative_percentage", share)
        .withColumn("abc_category",
                    F.when((F.col("cumulative_percentage") > 0) & (F.col("cumulative_percentage") <= 80), "A")
                    .when((F.col("cumulative_percentage") > 80) & (F.col("cumulative_percentage") <= 95), "B")
                    .otherwise("C"))
        .drop("running", "total")
    )


def abc_summary(classified: DataFrame) -> DataFrame:
    """Totals per ABC class. All three classes appear, an empty one with zeros."""
    levels = classified.sparkSession.createDataFrame([("A",), ("B",), ("C",)], "abc_category string")
    totals = classified.groupBy("abc_category").agg(
        F.count("product_id").alias("product_count"),
        exact_sum("total_value").alias("total_value"),
        F.sum("quantity").alias("quantity"),
        exact_sum("potential_revenue").alias("potential_revenue"))
    return F.broadcast(levels).join(totals, "abc_category", "left").select(
        "abc_category",
        *[F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c)
          for c, kind in totals.dtypes if c != "abc_category"])


def sales_history(items: DataFrame, transactions: DataFrame, as_of, years: int = 1) -> DataFrame:
    """Sold quantities of the last year. The date filter also prunes the lines:
    Spark builds a run-time filter from the remaining transactions."""
    since = timestamp(as_of) - F.make_ym_interval(F.lit(years), F.lit(0))
    recent = transactions.where(F.col("transaction_date") >= since).select("transaction_id", "transaction_date")
    return items.select("transaction_id", "product_id", "quantity").join(recent, "transaction_id").select(
        "product_id", "quantity", "transaction_date")


def inventory_actions(optimized: DataFrame) -> DataFrame:
    """Rows to reorder or to reduce, with the recommended quantity."""
    quantity, point = F.col("current_quantity"), F.col("reorder_point")
    action = F.when(quantity <= point, "Reorder").when(quantity > point * 2, "Reduce Stock")
    return (
        optimized.withColumn("action", action).where(F.col("action").isNotNull())
        .select("product_id", "store_id", "action", "current_quantity",
                F.when(F.col("action") == "Reorder", F.col("eoq"))
                .otherwise(point + F.col("safety_stock")).alias("recommended_quantity"),
                "reorder_point")
    )


def extract_inventory(inventory: DataFrame, products: DataFrame, store_id: int | None = None) -> DataFrame:
    """Stock rows with their product's name, prices and reorder settings."""
    details = products.select(
        "product_id", F.col("name").alias("product_name"), "category", "unit_cost", "unit_price",
        "reorder_point", "reorder_quantity")
    return _at_store(inventory, store_id).join(details, "product_id").select(
        "inventory_id", "store_id", "product_id", "quantity", "last_restocked", "product_name",
        "category", "unit_cost", "unit_price", "reorder_point", "reorder_quantity")


def transform_inventory(extracted: DataFrame, as_of) -> DataFrame:
    """Extracted stock with value, days since restock, status and turnover."""
    return extracted.withColumns({
        "stock_value": F.col("quantity") * F.col("unit_cost"),
        "potential_sales_value": F.col("quantity") * F.col("unit_price"),
        "days_since_restock": elapsed_days(timestamp(as_of), F.col("last_restocked")),
        "stock_status": _status(),
        "turnover_rate": F.try_divide(F.col("quantity").cast("double"), F.col("reorder_quantity")),
    })


def inventory_snapshot(inventory: DataFrame, products: DataFrame, as_of) -> DataFrame:
    """Stock overview by store, category and product name, numbers as doubles."""
    rows = extract_inventory(inventory, products).drop("reorder_quantity").withColumns({
        "total_value": F.col("quantity") * F.col("unit_cost"),
        "days_since_restock": elapsed_days(timestamp(as_of), F.col("last_restocked")),
        "stock_status": _status(),
    })
    return rows.withColumn("quantity", F.col("quantity").cast("double")).orderBy(
        "store_id", "category", "product_name", "product_id")


def stock_by_category(stock: DataFrame) -> DataFrame:
    return stock.groupBy("category").agg(
        F.sum("quantity").alias("quantity"), exact_sum("total_value").alias("total_value"))


def inventory_kpis(stock: DataFrame) -> DataFrame:
    """Total value, number of low rows and mean stock, in one row."""
    return stock.agg(
        exact_sum("total_value").alias("total_value"),
        F.count_if(F.col("quantity") <= F.col("reorder_point")).alias("low_stock_count"),
        F.avg("quantity").alias("avg_stock"))


def low_stock_alerts(snapshot: DataFrame) -> DataFrame:
    """Rows at or under the reorder point, with the missing quantity."""
    return snapshot.where(F.col("quantity") <= F.col("reorder_point")).select(
        "inventory_id", "store_id", "product_id", "product_name", "quantity", "reorder_point",
        (F.col("reorder_point") - F.col("quantity")).alias("shortfall"))
