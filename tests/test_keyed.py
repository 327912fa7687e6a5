"""Loads by key: what they read, and two at a time."""

import pytest

from tillwise.sources import keyed

SCHEMA = "customer_id long, total_spent double"


@pytest.fixture
def table(tmp_path):
    return str(tmp_path / "table")


def test_known_and_repeated_keys(spark, table, rows):
    batch = spark.createDataFrame([(1, 5.0), (1, 3.0), (2, 7.0), (None, 1.0)], SCHEMA)
    assert [keyed.load_keyed(batch, table, ["customer_id"], ["total_spent"]) for _ in range(2)] == [1, 2]
    keyed.load_keyed(spark.createDataFrame([(2, 99), (3, 1)], "customer_id int, total_spent int"), table, ["customer_id"])
    assert rows(keyed.read_keyed(spark, table)) == sorted([(1, 3.0), (2, 7.0), (3, 1.0), (None, 1.0)], key=repr)
    assert keyed.read_keyed(spark, table).schema.simpleString() == "struct<customer_id:bigint,total_spent:double>"


def test_a_load_reads_the_buckets_of_its_keys(spark, table, monkeypatch):
    keyed.load_keyed(spark.range(5000).selectExpr("id customer_id", "1D total_spent"), table, ["customer_id"], buckets=128)
    read, real = [], keyed._rows

    def watched(spark, path, state, buckets):
        found = real(spark, path, state, buckets)
        read.append((len(buckets), found._jdf.queryExecution().executedPlan().toString(), found.count()))
        return found

    monkeypatch.setattr(keyed, "_rows", watched)
    keyed.load_keyed(spark.range(4995, 5005).selectExpr("id customer_id", "2D total_spent"), table, ["customer_id"])
    [(wanted, plan, n)] = read
    assert wanted <= 10 and "PartitionFilters: [key_bucket" in plan and n < 5000 * 20 / 128
    monkeypatch.undo()
    assert keyed.read_keyed(spark, table).groupBy("total_spent").count().orderBy("total_spent").collect() == [(1.0, 5000), (2.0, 5)]


@pytest.mark.parametrize("begun", [False, True])
def test_two_loads_at_the_same_time(spark, table, rows, monkeypatch, begun):
    """The second load begins and ends after the first has looked, before it commits."""
    if begun:
        keyed.load_keyed(spark.createDataFrame([(0, 0.0)], SCHEMA), table, ["customer_id"])
    real, tries = keyed._committed, []

    def late(*args):
        tries.append(args[2])
        if len(tries) == 1:
            other = spark.createDataFrame([(2, 20.0), (3, 30.0)], SCHEMA)
            assert keyed.load_keyed(other, table, ["customer_id"]) == 1 + begun
        return real(*args)

    monkeypatch.setattr(keyed, "_committed", late)
    mine = spark.createDataFrame([(1, 1.0), (2, 2.0)], SCHEMA)
    assert keyed.load_keyed(mine, table, ["customer_id"]) == 2 + begun
    assert rows(keyed.read_keyed(spark, table)) == [(0, 0.0)][:begun] + [(1, 1.0), (2, 20.0), (3, 30.0)]


def test_loads_of_nothing_and_of_other_keys(spark, table):
    keyed.load_keyed(spark.createDataFrame([], SCHEMA), table, ["customer_id"])
    assert keyed.read_keyed(spark, table).count() == 0
    with pytest.raises(ValueError, match="keys"):
        keyed.load_keyed(spark.createDataFrame([(1, 1.0)], SCHEMA), table, ["total_spent"])
    with pytest.raises(ValueError, match="layout"):
        keyed.load_keyed(spark.createDataFrame([(1,)], "Load_Id long"), table + "2", ["Load_Id"])
