"""The driver contract, and every query against its oracle on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

DIRECTORY = "/root/testdata/sf0.001"
# Iterative or numeric models that SQL does not express.
ROWS_ONLY = {"customer_kmeans", "customer_value_model", "fourier_trend_forecast"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{DIRECTORY}/{table}.parquet'")
    return connection


OWN = sorted(set(entry.queries()) - set(entry._corpus()[0]))


def test_keys():
    assert set(OWN) == set(entry.oracle_sql()) - set(entry._corpus()[1]) | ROWS_ONLY


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [name for name in OWN if name not in ROWS_ONLY])
def test_query_equals_oracle(spark, duck, name):
    got = entry.queries()[name](spark, DIRECTORY).toPandas()
    assert compare(got, duck.execute(entry.oracle_sql()[name]).df()).startswith("ok")
