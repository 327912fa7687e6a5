"""The multi-step patterns against brute force, with hot keys."""

import random
from collections import Counter
from itertools import combinations
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillwise.plans import partners, quantiles, running
from tillwise.plans.pairs import item_pairs, mirrored, partners_of
from tillwise.plans.partners import best_partners
from tillwise.plans.quantiles import exact_quantiles, ordered_bits, ordered_value
from tillwise.plans.ranking import top_per_key
from tillwise.plans.running import running_total

QUARTERS = [0.25, 0.5, 0.75]


@pytest.mark.parametrize("values", [
    [1.0],
    [1.0, 2.0],
    [1, 1, 1, 1, 1, 2, 3, 4],
    [5.0] * 40,
    list(range(101)),
])
def test_quantiles_of_small_columns(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    row = exact_quantiles(df, ["x"], QUARTERS).first()
    assert row["x_q"] == pytest.approx(np.quantile(values, QUARTERS))
    assert row["x_few"] == (len(set(values)) < 4)


def test_quantiles_beyond_the_sketch(spark):
    """More rows than the sketch resolves, a third of them one value."""
    rng = np.random.default_rng(3)
    n = 60_000
    frame = pd.DataFrame({
        "x": np.where(rng.random(n) < 0.34, 10.0, rng.lognormal(2, 1, n)),
        "y": rng.integers(0, 50, n).astype(float)})
    row = exact_quantiles(spark.createDataFrame(frame), ["x", "y"], [0.0, *QUARTERS, 0.999, 1.0]).first()
    for name in ("x", "y"):
        assert row[f"{name}_q"] == list(np.quantile(frame[name], [0.0, *QUARTERS, 0.999, 1.0]))
        assert row[f"{name}_few"] is False


def test_quantiles_of_any_double(spark):
    """Signs, zeros, powers of two and their neighbours, the smallest and the largest."""
    ends = [0.0, -0.0, 5e-324, 2.0 ** -1022, 2.0 ** -1022 - 5e-324, 1.7976931348623157e308, 1e-310]
    powers = [x for e in range(-40, 60, 7) for x in (2.0 ** e, np.nextafter(2.0 ** e, 0), np.nextafter(2.0 ** e, np.inf))]
    rng = np.random.default_rng(8)
    values = np.array([s * x for x in [*ends, *powers, *rng.lognormal(0, 40, 300)] for s in (1, -1)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    steps = np.arange(len(values)) / (len(values) - 1)
    got = exact_quantiles(df, ["x"], [float(p) for p in steps[::7]]).first()["x_q"]
    ranks = [p * (len(values) - 1) for p in steps[::7]]
    s = np.sort(values)
    assert got == [s[int(np.floor(r))] + (s[int(np.ceil(r))] - s[int(np.floor(r))]) * (r - np.floor(r)) for r in ranks]
    bits = df.select("x", ordered_bits(F.col("x")).alias("b")).collect()
    assert all(ordered_value(r["b"]) == r["x"] for r in bits)


def test_quantiles_of_close_values_and_of_nothing(spark, monkeypatch):
    """Values that differ in their last bits only need every round."""
    monkeypatch.setattr(quantiles, "ROUND_BITS", 8)
    values = [1 + i * 2.0 ** -52 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values for _ in range(3)], "x double")
    row = exact_quantiles(df, ["x"], [0.5, 1.0]).first()
    assert row["x_q"] == [float(np.quantile(np.repeat(values, 3), 0.5)), values[-1]] and row["x_few"] is False
    row = exact_quantiles(df.where("false"), ["x"], [0.5]).first()
    assert row["x_q"] is None and row["x_few"] is True


@pytest.mark.parametrize("values,few", [([1, 2, 3] * 5, True), ([1, 2, 3, 4], False), ([7, 7], True)])
def test_few_distinct_values(spark, values, few):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).first()["x_few"] is few


@pytest.mark.parametrize("ranges,node", [(1, 1024), (3, 1024), (200, 1024), (200, 8), (90, 90), (91, 7)])
def test_running_total_equals_a_plain_window(spark, monkeypatch, ranges, node):
    """A third of the rows share one value: only the ids can split them."""
    monkeypatch.setattr(running, "NODE", node)
    rng = random.Random(5)
    data = [(i, 12.5 if rng.random() < 0.34 else round(rng.uniform(0, 100), 2)) for i in range(20_000)]
    df = spark.createDataFrame(data, "id long, v double").repartition(6)
    got = running_total(df, "v", [-F.col("v"), F.col("id")], ranges=ranges).toPandas().sort_values(
        ["v", "id"], ascending=[False, True])
    expected = np.cumsum(np.rint(got["v"].to_numpy() * 100).astype(int)) / 100
    assert np.array_equal(got["running"].to_numpy(), expected)
    assert set(got["total"]) == {expected[-1]}


@pytest.mark.parametrize("node", [1024, 4])
def test_running_total_spreads_a_hot_value(spark, monkeypatch, node):
    """No range holds more than a small part of the rows."""
    monkeypatch.setattr(running, "NODE", node)
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).otherwise(4.0).alias("v"))
    got = running_total(df, "v", [-F.col("v"), F.col("id")], ranges=20)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 20_000 / 2


def test_running_total_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v double")
    assert running_total(df, "v", [-F.col("v"), F.col("id")]).count() == 0


def _baskets(seed=1):
    """Many small groups and one that holds a third of the rows."""
    rng = random.Random(seed)
    rows = {(f"g{rng.randrange(300)}", rng.randrange(90)) for _ in range(1_000)}
    return sorted(rows | {("hot", i) for i in range(500)})


def _brute_pairs(rows):
    groups = {}
    for group, item in rows:
        groups.setdefault(group, set()).add(item)
    return Counter(pair for items in groups.values() for pair in combinations(sorted(items), 2))


@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_item_pairs_with_a_hot_group(spark, block):
    data = _baskets()
    df = spark.createDataFrame(data, "g string, i long")
    got = {(r["a"], r["b"]): r["together"] for r in item_pairs(df, "g", "i", block=block).collect()}
    assert got == dict(_brute_pairs(data))


def test_item_pairs_weights_and_null_groups(spark):
    df = spark.createDataFrame(
        [("x", "p", 2), ("x", "q", 3), ("y", "p", 1), ("y", "q", 1), (None, "p", 9), (None, "q", 9)],
        "g string, i string, w int")
    assert [tuple(r) for r in item_pairs(df, "g", "i", "w").collect()] == [("p", "q", 2, 7)]


def test_partners_equal_the_pairs_of_one_item(spark):
    data = _baskets(2)
    df = spark.createDataFrame(data, "g string, i long")
    every = mirrored(item_pairs(df, "g", "i").select("a", "b", "together")).where("a = 17")
    one = partners_of(df, "g", "i", 17)
    assert sorted(map(tuple, every.select("b", "together").collect())) == sorted(map(tuple, one.collect()))


def _overlapping(seed):
    """Ten large groups that share items, over many small ones."""
    rng = random.Random(seed)
    rows = {(f"g{rng.randrange(80)}", rng.randrange(70)) for _ in range(250)}
    for number in range(10):
        rows |= {(f"hot{number}", i) for i in rng.sample(range(100), 25 + 4 * number)}
    return sorted(rows | {("all", i) for i in range(0, 100, 2)})


def _brute_partners(data, k):
    expected = {}
    for (a, b), count in _brute_pairs(data).items():
        expected.setdefault(a, []).append((-count, b))
        expected.setdefault(b, []).append((-count, a))
    return {a: [(b, -c) for c, b in sorted(found)[:k]] for a, found in expected.items()}


def _as_lists(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["a"], []).append((r["b"], r["score"]))
    return {a: sorted(found, key=lambda x: (-x[1], x[0])) for a, found in got.items()}


@pytest.mark.parametrize("seed,k,large,heavy,block,bound", [
    (1, 3, 12, 10_000, 300, 10), (2, 1, 12, 40, 50, 10), (3, 10, 12, 300, 10_000, 9_000), (4, 5, 40, 10_000, 10_000, 0),
    (5, 4, 10_000, 10_000, 400, 0), (6, 120, 12, 100, 10_000, 30), (7, 4, 10_000, 200, 400, 100), (8, 7, 10_000, 10_000, 400, 9_000)])
def test_best_partners(spark, monkeypatch, seed, k, large, heavy, block, bound):
    """Large groups, heavy items, bounds and several blocks, together and each alone."""
    for name, value in (("LARGE_GROUP", large), ("HEAVY_ITEM", heavy), ("BLOCK_MEMBERS", block), ("BOUND_FROM", max(bound, 1))):
        monkeypatch.setattr(partners, name, value)
    data = _overlapping(seed)
    df = spark.createDataFrame([*data, (None, 3), ("g1", None)], "g string, i long")
    assert _as_lists(best_partners(df, "g", "i", k)) == _brute_partners(data, k)


@pytest.mark.parametrize("seed,large,heavy,block,bound", [
    (1, 10_000, 10_000, 300, 1), (2, 10_000, 100, 300, 50), (3, 12, 100, 300, 9_000), (4, 10_000, 10_000, 3_000, 9_000)])
def test_best_partners_by_cosine(spark, monkeypatch, seed, large, heavy, block, bound):
    for name, value in (("LARGE_GROUP", large), ("HEAVY_ITEM", heavy), ("BLOCK_MEMBERS", block), ("BOUND_FROM", bound)):
        monkeypatch.setattr(partners, name, value)
    rng = random.Random(seed)
    data = [(g, i, rng.choice([1, 1, 2, 9])) for g, i in _overlapping(seed)]
    of = {}
    for g, i, w in data:
        of.setdefault(i, {})[g] = w
    square = {i: float(sum(w * w for w in x.values())) for i, x in of.items()}
    expected = {}
    for a in of:
        found = [(-sum(w * of[b].get(g, 0) for g, w in of[a].items()) / sqrt(square[a] * square[b]), b) for b in of if a != b]
        expected[a] = [(b, -s) for s, b in sorted(f for f in found if f[0])[:4]]
    got = _as_lists(best_partners(spark.createDataFrame(data, "g string, i long, w int"), "g", "i", 4, "w"))
    assert got == {a: x for a, x in expected.items() if x}


def test_bounds_spare_large_groups():
    """Once k partners share two groups, the one large group is not gone through."""
    small = [[1, 2, 3, 4], [1, 2, 3, 4]]
    lists = partners._Lists(pa.array(
        [[{"i": i, "block": 0} for i in g] for g in [*small, list(range(1, 5000))]],
        pa.list_(pa.struct([("i", pa.int64()), ("block", pa.int32())]))))
    seen = []
    met = lists.met
    lists.met = lambda groups, weights: (seen.extend(groups), met(groups, weights))[1]
    ids, score = partners._best(lists, 1, np.arange(3), np.ones(3), 1.0, np.array([]), 3, False)
    assert ids.tolist() == [2, 3, 4] and score.tolist() == [3, 3, 3] and 2 not in seen


def test_lists_are_dealt_out_in_few_bytes(spark):
    """Each list goes to as many blocks as it has members: two bytes for an id near the one before."""
    lists = [[7, 8, 30_000], [-5, 40_000, 90_000], [-2**63, 0, 2**63 - 1], [3, 2**31, 2**32], [2**62, 2**62 + 1]]
    packed = partners._packed(spark.createDataFrame([(x, [0]) for x in lists], "ids array<long>, blocks array<int>"))
    assert partners._unpacked(packed.toArrow()).flatten().field("i").to_pylist() == sum(lists, [])
    assert [(r["width"], len(r["pieces"])) for r in packed.collect()] == [(1, 3), (2, 6), (5, 15), (5, 15), (1, 2)]


def test_best_partners_of_items_far_apart(spark, monkeypatch):
    monkeypatch.setattr(partners, "BLOCK_MEMBERS", 20)
    of = [-2**63, -1, 0, 5, 70_000, 2**40, 2**63 - 1]
    data = [(g, of[i % 7]) for g, i in _overlapping(9)]
    df = spark.createDataFrame(data, "g string, i long").distinct()
    assert _as_lists(best_partners(df, "g", "i", 3)) == _brute_partners(sorted({*data}), 3)


def test_a_large_group_is_not_expanded(spark, monkeypatch):
    """4,000 items in one group would be 8 million pairs; k + 1 each are made."""
    monkeypatch.setattr(partners, "LARGE_GROUP", 1_000)
    df = spark.range(4_000).select(F.lit("walk-in").alias("g"), F.col("id").alias("i"))
    got = best_partners(df, "g", "i", 3)
    assert got.count() == 12_000
    assert {r["b"] for r in got.where("a = 2").collect()} == {0, 1, 3}
    assert best_partners(df.where("false"), "g", "i", 3).count() == 0


def test_top_per_key_breaks_ties(spark):
    df = spark.createDataFrame([("k", 3, 1), ("k", 1, 1), ("k", 2, 1), ("k", 9, 0)], "a string, b int, s int")
    got = top_per_key(df, "a", 2, F.col("s").desc(), F.col("b"))
    assert sorted(r["b"] for r in got.collect()) == [1, 2]
