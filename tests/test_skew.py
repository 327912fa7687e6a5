"""Whole queries on data where one customer, one transaction, one product and one
stock value hold a third of the rows each, against their oracles."""

import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare
from tillwise.plans import pairs, partners

SOURCE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    directory = tmp_path_factory.mktemp("skewed")
    duck = duckdb.connect()
    for table in TABLES[:-2]:
        shutil.copy(f"{SOURCE}/{table}.parquet", directory / f"{table}.parquet")
    newest = duck.execute(f"select o_orderkey from '{SOURCE}/orders.parquet' order by o_orderdate desc, 1 limit 1").fetchall()[0][0]
    duck.execute(f"""copy (select * replace (case when o_orderkey % 3 = 0 then 0 else o_custkey end as o_custkey)
                     from '{SOURCE}/orders.parquet') to '{directory}/orders.parquet' (format parquet)""")
    duck.execute(f"""copy (select * replace (
                         case when l_linenumber % 3 = 0 then {newest} else l_orderkey end as l_orderkey,
                         case when l_linenumber % 3 = 1 then 34 else l_partkey end as l_partkey,
                         case when l_linenumber % 3 = 2 then 0.0 else l_quantity end as l_quantity)
                     from '{SOURCE}/lineitem.parquet') to '{directory}/lineitem.parquet' (format parquet)""")
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{directory}/{table}.parquet'")
    return str(directory), duck


@pytest.mark.parametrize("name", [
    "customer_rfm", "customer_metrics", "extract_transactions", "abc_analysis", "inventory_abc",
    "pair_rules", "association_rules", "item_cosine", "similar_to", "similar_products", "bought_together_all", "shared_customers_all",
    "category_correlation", "daily_demand", "forecast_accuracy",
])
def test_query_on_skewed_data(spark, skewed, monkeypatch, name):
    directory, duck = skewed
    # Small enough that the hot customer, transaction and product count as such here.
    monkeypatch.setattr(pairs.item_pairs, "__kwdefaults__", {"block": 32})
    monkeypatch.setattr(partners, "LARGE_GROUP", 50)
    monkeypatch.setattr(partners, "HEAVY_ITEM", 2_000)
    monkeypatch.setattr(partners, "BLOCK_MEMBERS", 5_000)
    got = entry.queries()[name](spark, directory).toPandas()
    assert len(got) > 0
    assert compare(got, duck.execute(entry.oracle_sql()[name]).df()).startswith("ok")
