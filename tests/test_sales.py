import random
from datetime import datetime, timedelta

import pytest

from tillwise.operators import daily_kpis, loading, sales
from tillwise.operators.customers import customer_metrics
from tillwise.sources import storage
from tillwise.sources.tables import SCHEMAS, RetailTables, read_table

TX = ("transaction_id long, store_id int, customer_id long, staff_id long, transaction_date timestamp_ntz, "
      "total_amount double, payment_method string")


@pytest.fixture
def tx(spark):
    return spark.createDataFrame([
        (1, 1, 10, None, datetime(2024, 6, 1), 10.0, "Cash"),
        (2, 2, None, 7, datetime(2024, 6, 30, 23, 30), 20.0, "Cash"),
        (3, 1, 11, 7, datetime(2024, 7, 1), 30.0, "Cash")], TX)


@pytest.fixture
def shops(spark):
    return spark.createDataFrame([(1, "north", "n"), (2, "south", "s"), (3, "new", "w")],
                                 "store_id int, name string, state string")


def test_extract_keeps_unknown_parties(spark, tx, shops):
    people = "id long, first_name string, last_name string"
    customers = spark.createDataFrame([(10, "a", "b")], people).withColumnRenamed("id", "customer_id")
    staff = spark.createDataFrame([(7, "s", "t")], people).withColumnRenamed("id", "staff_id")
    got = {r["transaction_id"]: r for r in
           sales.extract_transactions(tx, customers, shops, staff, "2024-06-01", "2024-07-01").collect()}
    assert set(got) == {1, 2, 3}  # both ends included
    assert (got[1]["first_name"], got[1]["staff_id"], got[2]["customer_id"], got[3]["first_name"]) == ("a", None, None, None)
    assert (got[3]["customer_id"], got[3]["store_name"], got[3]["staff_first_name"]) == (None, "north", "s")


def test_calendar(tx, rows):
    got = rows(sales.calendar_features(tx).where("transaction_id = 2"), "day_of_week", "month", "hour")
    assert got == [("Sunday", "June", 23)]


def test_lines_newest_first(spark, tx):
    items = spark.createDataFrame([(1, 5, 1, 10.0), (3, 6, 2, 15.0), (9, 6, 1, 1.0)],
                                  "transaction_id long, product_id long, quantity int, unit_price double")
    assert [r["transaction_id"] for r in sales.transaction_lines(tx, items, newest_first=True).collect()] == [3, 1]


def test_trend(tx, rows):
    assert [r[1:] for r in rows(sales.daily_sales_trend(tx))] == [(10.0, 1), (20.0, 1), (30.0, 1)]


def test_kpis_with_an_empty_earlier_period(spark):
    tx = spark.createDataFrame([
        (1, 1, 10, None, datetime(2024, 6, 30), 40.0, "Cash"), (2, 1, 10, None, datetime(2024, 6, 29), 60.0, "Cash")], TX)
    items = spark.createDataFrame([(1, 3), (2, 5)], "transaction_id long, quantity int")
    stock = spark.createDataFrame([(16,)], "quantity int")
    got = {r["metric"]: r for r in sales.kpis(tx, items, stock, "2024-06-30", 2).collect()}
    assert (got["total_sales"]["value"], got["total_sales"]["previous"], got["total_sales"]["change"]) == (100.0, 0.0, 100.0)
    assert (got["average_transaction"]["value"], got["average_transaction"]["previous"]) == (50.0, None)
    assert got["retention_rate"]["value"] is None
    assert (got["inventory_turnover"]["value"], got["inventory_turnover"]["previous"]) == (0.5, None)


def test_kpis_over_two_periods(spark):
    day = lambda d: datetime(2024, 6, d)
    tx = spark.createDataFrame([
        (i, 1, customer, None, day(d), 10.0 * i, "Cash") for i, (customer, d) in enumerate(
            [(10, 30), (11, 29), (10, 28), (12, 27), (12, 26), (13, 25)], start=1)], TX)
    items = spark.createDataFrame([(i, i) for i in range(1, 7)], "transaction_id long, quantity int")
    stock = spark.createDataFrame([(4,), (6,)], "quantity int")
    got = {r["metric"]: r for r in sales.kpis(tx, items, stock, "2024-06-30", 2).collect()}
    assert (got["total_sales"]["value"], got["total_sales"]["previous"]) == (30.0, 70.0)
    assert got["retention_rate"]["value"] == 0.5      # of customers 10 and 12, 10 came again
    assert got["retention_rate"]["previous"] == 0.5   # of customers 12 and 13, 12 came again
    assert got["inventory_turnover"]["value"] == pytest.approx(0.3)
    change = got["total_sales"]["change"]
    assert got["total_sales"]["value"] * (1 - change / 100) == pytest.approx(70.0)


def test_kpis_of_stored_days(spark, tmp_path):
    """Months stored one by one, out of order and twice, say what all transactions say; a
    month that comes late is added without reading the others."""
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    tx = spark.createDataFrame([
        (i, 1, rng.choice([None, rng.randrange(60), 40_000 + rng.randrange(9)]), None, start + timedelta(hours=rng.randrange(24 * 150)),
         rng.randrange(100) / 4, "Cash") for i in range(600)], TX)
    items = spark.createDataFrame([(i, i % 5) for i in range(600) if i % 7], "transaction_id long, quantity int")
    stock = spark.createDataFrame([(40,)], "quantity int")
    path = str(tmp_path / "days")
    for month in (2, 1, 4, 1):
        daily_kpis.store_months(tx, items, path, f"2024-0{month}-01", f"2024-0{month}-09")
    daily_kpis.store_months(tx.where("month(transaction_date) in (3, 5)"), items, path, "2024-03-07", "2024-03-20")
    daily_kpis.store_months(tx.where("month(transaction_date) in (3, 5)"), items, path, "2024-05-01", "2024-05-02")
    for end, days in (("2024-05-20", 30), ("2024-05-20", 7), ("2024-03-31", 20), ("2024-02-01", 30), ("2023-01-01", 5)):
        want = {r["metric"]: r for r in sales.kpis(tx, items, stock, end, days).collect()}
        got = {r["metric"]: r for r in daily_kpis.stored_kpis(spark, path, stock, end, days).collect()}
        assert got == want


def test_has_rows(spark, tx):
    got = {r["name"]: r["has_rows"] for r in loading.has_rows({"all": tx, "none": tx.where("false")}).collect()}
    assert got == {"all": True, "none": False}


def test_store_performance(tx, shops, rows):
    got = rows(sales.store_performance(tx, shops, "2024-06-01", "2024-07-01"),
               "store_id", "sales", "orders", "average_sale", "performance")
    assert got == [(1, 40.0, 2, 20.0, 2.0), (2, 20.0, 1, 20.0, 1.0), (3, 0.0, 0, None, 0.0)]


def test_sales_of_no_store_leave_the_mean_alone(spark, rows):
    tx = spark.sql("""select * from values (1, 1, timestamp_ntz'2024-06-02', 10.0d), (2, 2, timestamp_ntz'2024-06-02', 10.0d),
                      (3, null, timestamp_ntz'2024-06-02', 20.0d) t(transaction_id, store_id, transaction_date, total_amount)""")
    two = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "store_id int, name string, state string")
    assert rows(sales.store_performance(tx, two, None, None), "store_id", "performance") == [(1, 1.0), (2, 1.0)]


# -- writing and reading -------------------------------------------------------------

def test_load_skips_known_and_repeated_keys(spark, tmp_path, rows):
    path = str(tmp_path / "metrics")
    schema = "customer_id long, total_spent double"
    batch = spark.createDataFrame([(1, 5.0), (1, 3.0), (2, 7.0)], schema)
    storage.load_new_records(batch, path, ["customer_id"], ["total_spent"])
    assert rows(spark.read.parquet(path)) == [(1, 3.0), (2, 7.0)]
    storage.load_new_records(batch, path, ["customer_id"], ["total_spent"])
    more = spark.createDataFrame([(2, 99.0), (3, 1.0)], schema)
    storage.load_new_records(more, path, ["customer_id"])
    assert rows(spark.read.parquet(path)) == [(1, 3.0), (2, 7.0), (3, 1.0)]


def test_load_customer_metrics_twice(spark, tx, tmp_path, rows):
    path = str(tmp_path / "customer_metrics")
    for _ in range(2):
        loading.load_customer_metrics(tx, path)
    assert rows(spark.read.parquet(path)) == rows(customer_metrics(tx))


def test_month_layout_prunes(spark, tx, tmp_path, rows):
    path = str(tmp_path / "tx")
    storage.write_by_month(tx, path)
    june = spark.read.parquet(path).where("month = '2024-06'")
    assert [r[0] for r in rows(june, "transaction_id")] == [1, 2]
    assert "PartitionFilters: [isnotnull(month" in june._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_a_shuffle(spark, tx):
    items = spark.createDataFrame([(1, 5, 2), (3, 6, 1)], "transaction_id long, product_id long, quantity int")
    names = ("tillwise_test_tx", "tillwise_test_items")
    try:
        for name, frame in zip(names, (tx, items)):
            storage.write_bucketed(frame, name, "transaction_id", 4)
        joined = spark.table(names[0]).hint("merge").join(spark.table(names[1]), "transaction_id")
        assert joined.count() == 2
        assert "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString()
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in names:
            spark.sql(f"drop table if exists {name}")


def test_declared_schema(spark, tx, tmp_path):
    tx.write.parquet(str(tmp_path / "transactions"))
    assert read_table(spark, str(tmp_path), "transactions").schema == SCHEMAS["transactions"]


def test_bundle(spark, tmp_path):
    tables = RetailTables(spark, "/root/testdata/sf0.001")
    bundle = loading.extract_bundle(tables, "2001-11-05")
    assert set(bundle) == {"transaction_data", "inventory_data", "product_data", "customer_data"}
    sizes = {r["name"]: r["rows"] for r in loading.bundle_sizes(bundle).collect()}
    assert all(sizes.values())
    loading.write_bundle(bundle, str(tmp_path))
    assert {name: spark.read.parquet(f"{tmp_path}/{name}").count() for name in bundle} == sizes


@pytest.mark.parametrize("name", ["customers", "products", "stores", "staff", "transactions", "inventory"])
def test_roles_have_the_declared_columns(spark, name):
    frame = getattr(RetailTables(spark, "/root/testdata/sf0.001"), name)
    assert {f.name: f.dataType for f in frame.schema} == {f.name: f.dataType for f in SCHEMAS[name]}
