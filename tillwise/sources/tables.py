"""The retail tables, either as stored under their own names or derived from
TPC-H-like tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_long, _int, _text, _double, _ts = (
    T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType(),
)

SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(customer_id=_long, first_name=_text, last_name=_text, email=_text,
                         phone=_text, city=_text, state=_text),
    "products": _schema(product_id=_long, sku=_text, name=_text, description=_text,
                        category=_text, subcategory=_text, unit_cost=_double,
                        unit_price=_double, reorder_point=_int, reorder_quantity=_int),
    "stores": _schema(store_id=_int, name=_text, state=_text),
    "staff": _schema(staff_id=_long, store_id=_int, first_name=_text, last_name=_text),
    "transactions": _schema(transaction_id=_long, store_id=_int, customer_id=_long,
                            staff_id=_long, transaction_date=_ts, total_amount=_double,
                            payment_method=_text),
    "transaction_items": _schema(transaction_id=_long, product_id=_long, quantity=_int,
                                 unit_price=_double, total_price=_double),
    "inventory": _schema(inventory_id=_long, store_id=_int, product_id=_long, quantity=_int,
                         last_restocked=_ts),
}


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A retail table stored as parquet under its own name, with its declared
    schema (no inference pass over the files)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}")


class RetailTables:
    """Retail tables as lazy views over TPC-H-like parquet files.

    Each view is built on first use, so a job opens only the files it reads.
    """

    def __init__(self, spark: SparkSession, directory: str):
        self._spark = spark
        self._directory = directory
        self._opened: dict[str, DataFrame] = {}

    def _raw(self, name: str) -> DataFrame:
        """A stored table, opened once: opening it again reads its footer again."""
        if name not in self._opened:
            self._opened[name] = self._spark.read.parquet(f"{self._directory}/{name}.parquet")
        return self._opened[name]

    @cached_property
    def _nations(self) -> DataFrame:
        return self._raw("nation").join(
            self._raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def customers(self) -> DataFrame:
        name = F.split("c_name", "#")
        return (
            self._raw("customer")
            .join(self._nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("customer_id"),
                name[0].alias("first_name"),
                name[1].alias("last_name"),
                F.concat(F.lit("c"), F.col("c_custkey").cast("string"),
                         F.lit("@example.com")).alias("email"),
                F.lit(None).cast("string").alias("phone"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("state"),
            )
        )

    @cached_property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self._raw("part").select(
            key.alias("product_id"),
            F.concat(F.lit("SKU-"), F.upper(F.substring("p_type", 1, 3)), F.lit("-"),
                     key.cast("string")).alias("sku"),
            F.col("p_name").alias("name"),
            F.lit(None).cast("string").alias("description"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("subcategory"),
            F.round(F.col("p_retailprice") / 1.5, 2).alias("unit_cost"),
            F.col("p_retailprice").alias("unit_price"),
            (15 + F.col("p_size") % 36).alias("reorder_point"),
            (50 + key % 151).cast("int").alias("reorder_quantity"),
        )

    @cached_property
    def stores(self) -> DataFrame:
        return self._nations.select(
            F.col("n_nationkey").alias("store_id"), F.col("n_name").alias("name"),
            F.col("r_name").alias("state"))

    @cached_property
    def staff(self) -> DataFrame:
        name = F.split("s_name", "#")
        return self._raw("supplier").select(
            F.col("s_suppkey").alias("staff_id"), F.col("s_nationkey").alias("store_id"),
            name[0].alias("first_name"), name[1].alias("last_name"))

    @cached_property
    def transaction_headers(self) -> DataFrame:
        """Transactions without ``store_id``.

        The store of an order is its customer's nation here, which costs a join;
        jobs that never look at the store read this view and skip it.
        """
        key = F.col("o_orderkey")
        return self._raw("orders").select(
            key.alias("transaction_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(key % 11 != 10, key % 10).alias("staff_id"),
            F.col("o_orderdate").alias("transaction_date"),
            F.col("o_totalprice").alias("total_amount"),
            F.when(key % 3 == 0, "Cash").when(key % 3 == 1, "Credit Card")
            .otherwise("Debit Card").alias("payment_method"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        stores = self._raw("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("store_id"))
        return self.transaction_headers.join(stores, "customer_id").select(
            *SCHEMAS["transactions"].fieldNames())

    @cached_property
    def items(self) -> DataFrame:
        return self._raw("lineitem").select(
            F.col("l_orderkey").alias("transaction_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
            F.col("l_extendedprice").alias("total_price"),
        )

    @cached_property
    def inventory(self) -> DataFrame:
        """Stock per store and product, derived from shipped lines.

        Lines are summed per supplier and product before the join, so the
        supplier lookup sees the reduced rows only.
        """
        shipped = self._raw("lineitem").groupBy("l_suppkey", "l_partkey").agg(
            F.sum("l_quantity").alias("units"), F.max("l_shipdate").alias("shipped"))
        return (
            shipped.join(self._raw("supplier").select("s_suppkey", "s_nationkey"),
                         F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("s_nationkey", "l_partkey")
            .agg(F.sum("units").alias("units"), F.max("shipped").alias("last_restocked"))
            .select(
                (F.col("s_nationkey").cast("long") * (1 << 40) + F.col("l_partkey"))
                .alias("inventory_id"),
                F.col("s_nationkey").alias("store_id"),
                F.col("l_partkey").alias("product_id"),
                (F.col("units").cast("int") % 201).alias("quantity"),
                "last_restocked",
            )
        )
