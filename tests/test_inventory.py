from datetime import datetime
from math import sqrt
from statistics import NormalDist

import pytest

from tillwise.operators import inventory as inv

PRODUCTS = ("product_id long, name string, category string, unit_cost double, unit_price double, "
            "reorder_point int, reorder_quantity int")
STOCK = "inventory_id long, store_id int, product_id long, quantity int, last_restocked timestamp_ntz"


@pytest.fixture
def products(spark):
    return spark.createDataFrame([
        (1, "a", "x", 10.0, 15.0, 20, 50), (2, "b", "x", 10.0, 15.0, 20, 0),
        (3, "c", "y", 5.0, 7.5, 20, 60), (4, "d", "y", 0.0, 1.0, 5, 60)], PRODUCTS)


@pytest.fixture
def stock(spark):
    day = datetime(2024, 6, 1)
    return spark.createDataFrame([
        (1, 1, 1, 80, day), (2, 1, 2, 15, day), (3, 2, 3, 10, datetime(2024, 7, 2, 12)), (4, 2, 4, 7, day)], STOCK)


def test_shares_exactly_on_the_edges(stock, products):
    """Values 800, 150, 50, 0: shares 80, 95, 100, 100."""
    abc = {r["product_id"]: r for r in inv.abc_analysis(inv.inventory_metrics(stock, products)).collect()}
    assert [abc[i]["cumulative_percentage"] for i in (1, 2, 3, 4)] == [80.0, 95.0, 100.0, 100.0]
    assert [abc[i]["abc_category"] for i in (1, 2, 3, 4)] == ["A", "B", "C", "C"]


def test_equal_values_are_ordered_by_id(spark, products):
    day = datetime(2024, 6, 1)
    stock = spark.createDataFrame([(i, s, p, 5, day) for i, (p, s) in enumerate([(2, 2), (1, 2), (2, 1), (1, 1)])], STOCK)
    abc = inv.abc_analysis(inv.inventory_metrics(stock, products)).orderBy("cumulative_value").collect()
    assert [(r["product_id"], r["store_id"]) for r in abc] == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_summary_has_every_class(spark, stock, products, rows):
    classified = inv.inventory_abc(stock.where("product_id = 1"), products)
    got = rows(inv.abc_summary(classified), "abc_category", "product_count", "total_value", "quantity", "potential_revenue")
    # A single row has share 100: class C. A and B stay, with zeros.
    assert got == [("A", 0, 0.0, 0, 0.0), ("B", 0, 0.0, 0, 0.0), ("C", 1, 800.0, 80, 1200.0)]


def test_worthless_stock_is_class_c(stock, products, rows):
    classified = inv.inventory_abc(stock.where("product_id = 4"), products)
    assert rows(classified, "abc_category", "cumulative_percentage") == [("C", None)]


def test_metrics_per_store(stock, products, rows):
    got = rows(inv.inventory_metrics(stock, products, store_id=2), "product_id", "stock_value",
               "potential_sales_value", "stock_status")
    assert got == [(3, 50.0, 75.0, "Low Stock"), (4, 0.0, 7.0, "Adequate")]
    assert inv.extract_inventory(stock, products, store_id=0).count() == 0
    assert inv.extract_inventory(stock, products).count() == 4


def test_optimize(spark, stock, products):
    sales = spark.createDataFrame(
        [(1, 4, datetime(2024, 5, 1)), (1, 8, datetime(2024, 5, 1)), (2, 3, datetime(2024, 5, 2))],
        "product_id long, quantity int, transaction_date timestamp_ntz")
    full = inv.extract_inventory(stock, products)
    got = {r["product_id"]: r for r in inv.optimize_inventory(full, sales).collect()}
    assert set(got) == {1, 2}  # never sold: no row
    z = NormalDist().inv_cdf(0.95)
    safety = z * sqrt(8) * sqrt(7)
    assert got[1]["eoq"] == pytest.approx(sqrt(2 * 6 * 365 * 50 / 2.0))
    assert got[1]["safety_stock"] == pytest.approx(safety)
    assert got[1]["reorder_point"] == pytest.approx(6 * 7 + safety)
    assert got[1]["current_reorder_point"] == 20
    assert got[2]["safety_stock"] == 0  # one sale: no spread
    by_day = {r["product_id"]: r for r in inv.optimize_inventory(full, sales, demand_basis="calendar_day", days=10).collect()}
    assert by_day[1]["eoq"] == pytest.approx(sqrt(2 * 1.2 * 365 * 50 / 2.0))
    std = sqrt((10 * 144 - 144) / 90)
    assert by_day[1]["safety_stock"] == pytest.approx(z * std * sqrt(7))
    with pytest.raises(ValueError):
        inv.optimize_inventory(full, sales, demand_basis="week")


def test_eoq_needs_positive_inputs(spark):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([(0.0, 1.0), (5.0, 0.0), (-1.0, 1.0), (2.0, 4.0)], "d double, h double").select(
        inv.eoq(F.col("d"), F.lit(50), F.col("h")).alias("q")).collect()
    assert [r["q"] for r in got] == [0.0, 0.0, 0.0, pytest.approx(sqrt(50.0))]


def test_actions(spark, rows):
    optimized = spark.createDataFrame([
        (1, 1, 10, 7.0, 2.0, 10.0, 5), (2, 1, 11, 7.0, 2.0, 10.0, 5), (3, 1, 20, 7.0, 2.0, 10.0, 5),
        (4, 1, 21, 7.0, 2.0, 10.0, 5)],
        "product_id long, store_id int, current_quantity int, eoq double, safety_stock double, "
        "reorder_point double, current_reorder_point int")
    got = rows(inv.inventory_actions(optimized), "product_id", "action", "recommended_quantity")
    assert got == [(1, "Reorder", 7.0), (4, "Reduce Stock", 12.0)]


def test_transform(stock, products):
    got = {r["product_id"]: r for r in
           inv.transform_inventory(inv.extract_inventory(stock, products), "2024-07-02").collect()}
    assert got[2]["turnover_rate"] is None  # reorder quantity 0
    assert got[1]["turnover_rate"] == 1.6
    assert got[1]["days_since_restock"] == 31
    assert got[3]["days_since_restock"] == -1  # half a day ahead


def test_snapshot_order_kpis_and_alerts(stock, products, rows):
    snapshot = inv.inventory_snapshot(stock, products, "2024-07-02")
    assert [r["inventory_id"] for r in snapshot.collect()] == [1, 2, 3, 4]
    assert dict(snapshot.dtypes)["quantity"] == "double"
    assert rows(inv.low_stock_alerts(snapshot), "inventory_id", "shortfall") == [(2, 5.0), (3, 10.0)]
    values = inv.stock_values(stock, products)
    assert rows(inv.inventory_kpis(values)) == [(1000.0, 2, 28.0)]
    assert rows(inv.stock_by_category(values)) == [("x", 95, 950.0), ("y", 17, 50.0)]


def test_sales_history_window(spark, rows):
    items = spark.createDataFrame([(1, 7, 2), (2, 8, 3)], "transaction_id long, product_id long, quantity int")
    tx = spark.createDataFrame([(1, datetime(2023, 7, 1)), (2, datetime(2023, 6, 30, 23))],
                               "transaction_id long, transaction_date timestamp_ntz")
    assert rows(inv.sales_history(items, tx, "2024-07-01"), "product_id", "quantity") == [(7, 2)]
