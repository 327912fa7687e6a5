"""The extract steps together, and loading of aggregated results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import load_keyed
from ..sources.storage import load_new_records
from ..sources.tables import RetailTables
from .customers import customer_metrics, customer_summary
from .inventory import inventory_snapshot
from .sales import product_catalog, transaction_lines


def extract_bundle(tables: RetailTables, as_of) -> dict[str, DataFrame]:
    """The four extracts of the overview, lazy: nothing runs until one is used."""
    return {
        "transaction_data": transaction_lines(tables.transactions, tables.items),
        "inventory_data": inventory_snapshot(tables.inventory, tables.products, as_of),
        "product_data": product_catalog(tables.products),
        "customer_data": customer_summary(tables.customers, tables.transaction_headers),
    }


def write_bundle(bundle: dict[str, DataFrame], directory: str) -> None:
    for name, frame in bundle.items():
        frame.write.mode("overwrite").parquet(f"{directory}/{name}")


def bundle_sizes(bundle: dict[str, DataFrame]) -> DataFrame:
    """``(name, rows)`` of every extract."""
    counts = [frame.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
              for name, frame in bundle.items()]
    return reduce(DataFrame.unionByName, counts)


def has_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """``(name, has_rows)``: whether there is anything in each frame. One row of it is read."""
    found = [frame.limit(1).agg(F.lit(name).alias("name"), (F.count(F.lit(1)) > 0).alias("has_rows"))
             for name, frame in frames.items()]
    return reduce(DataFrame.unionByName, found)


def load_customer_metrics(transactions: DataFrame, path: str) -> None:
    """Adds the customers not yet in the ``customer_metrics`` table at ``path``."""
    load_new_records(customer_metrics(transactions), path, ["customer_id"])


def load_customer_metrics_keyed(transactions: DataFrame, path: str) -> int:
    """The same for a table by key (``sources.keyed``): only the buckets of the customers in
    ``transactions`` are read, and loads may run at the same time. Returns the new version."""
    return load_keyed(customer_metrics(transactions), path, ["customer_id"])


def load_product_metrics(transformed_inventory: DataFrame, path: str) -> None:
    """Adds the products not yet in the ``product_metrics`` table at ``path``."""
    load_new_records(product_metrics(transformed_inventory), path, ["product_id"])


def product_metrics(transformed_inventory: DataFrame) -> DataFrame:
    """Stock value and mean turnover per product, from the transformed stock rows.

    Both are summed as decimals, so the order of addition does not matter."""
    return transformed_inventory.groupBy("product_id").agg(
        F.sum(F.col("stock_value").cast("decimal(18,4)")).cast("double").alias("stock_value"),
        F.try_divide(F.sum(F.col("turnover_rate").cast("decimal(28,10)")).cast("double"),
                     F.count("turnover_rate")).alias("turnover_rate"))
