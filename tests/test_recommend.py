from collections import Counter
from datetime import datetime
from itertools import combinations
from math import sqrt

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

from pyspark.sql import functions as F
from tillwise.operators import recommend as r
from tillwise.plans import dealing, pairs

AS_OF = "2024-07-01"
LINES = "transaction_id long, product_id long, product_name string, category string"
# Five baskets; the first repeats an item, tea-milk-cake is a frequent triple.
BASKETS = [
    (1, 1, "tea", "drink"), (1, 1, "tea", "drink"), (1, 2, "milk", "drink"), (1, 3, "cake", "food"),
    (2, 1, "tea", "drink"), (2, 2, "milk", "drink"), (2, 3, "cake", "food"),
    (3, 1, "tea", "drink"), (3, 3, "cake", "food"),
    (4, 2, "milk", "drink"), (4, 4, "soap", "home"),
    (5, 4, "soap", "home"),
]


@pytest.fixture
def baskets(spark):
    return spark.createDataFrame(BASKETS, LINES)


def _brute_rules(min_support, min_confidence):
    groups = {}
    for t, _, name, _ in BASKETS:
        groups.setdefault(t, set()).add(name)
    n, names = len(groups), sorted({b[2] for b in BASKETS})
    freq = {s: sum(set(s) <= g for g in groups.values()) for k in range(1, 5) for s in combinations(names, k)}
    freq = {s: c for s, c in freq.items() if c / n >= min_support and c}
    rules = {}
    for whole, count in freq.items():
        for k in range(1, len(whole)):
            for left in combinations(whole, k):
                right = tuple(x for x in whole if x not in left)
                if count / freq[left] >= min_confidence:
                    rules[left, right] = (count / n, count / freq[left], count * n / (freq[left] * freq[right]))
    return rules


@pytest.mark.parametrize("support,confidence", [(0.2, 0.1), (0.4, 0.5), (0.4, 1.0), (0.6, 0.7)])
def test_rules_with_several_items_on_both_sides(baskets, support, confidence):
    got = {(tuple(x["antecedents"]), tuple(x["consequents"])): (x["support"], x["confidence"], x["lift"])
           for x in r.association_rules(baskets, support, confidence).collect()}
    expected = _brute_rules(support, confidence)
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_rules_of_a_set_of_32_items(spark):
    """Of its four thousand million splits only those that stay confident are tried."""
    items = [f"i{n:02d}" for n in range(32)]
    without = lambda *names: [x for x in items if x not in names]
    sets = [(items, 50), (without("i03"), 60), (without("i07"), 200), (without("i03", "i07"), 250),
            (["i03"], 900), (["i07"], 500), (["i03", "i07"], 450)]
    sets = spark.createDataFrame([(*x, 1000) for x in sets], "items array<string>, freq long, n long")
    rules = lambda confidence: {(len(x["antecedents"]), *x["consequents"]): x["confidence"]
                                for x in r.rules_of_itemsets(sets, confidence).collect() if len(x["antecedents"]) > 1}
    many = {(31, "i03"): 50 / 60, (30, "i03"): 200 / 250}
    assert rules(0.6) == many
    assert rules(0.2) == {**many, (31, "i07"): 50 / 200, (30, "i07"): 60 / 250, (30, "i03", "i07"): 50 / 250}


def test_no_frequent_item(spark, baskets):
    assert r.association_rules(baskets, 0.9, 0.1).count() == 0
    assert r.association_rules(baskets.where("false"), 0.1, 0.1).count() == 0


def test_only_items_of_frequent_pairs_enter_the_trees(spark, monkeypatch):
    """Of twelve frequent items two are bought together often."""
    lines = [(t, f"i{t % 10:02d}") for t in range(100)] + [(t, x) for t in range(0, 100, 4) for x in ("tea", "milk")]
    lines = spark.createDataFrame([(t, 0, x, "c") for t, x in lines], LINES)
    grown, seen = r.FPGrowth, []

    class Seen(grown):
        def fit(self, baskets):
            seen.extend(tuple(sorted(x["items"])) for x in baskets.collect())
            return super().fit(baskets)

    monkeypatch.setattr(r, "FPGrowth", Seen)
    sets = lambda support: {tuple(x["items"]): (x["freq"], x["n"]) for x in r.frequent_itemsets(lines, support).collect()}
    singles = {(f"i{i:02d}",): (10, 100) for i in range(10)} | {("tea",): (25, 100), ("milk",): (25, 100)}
    assert sets(0.1) == singles | {("milk", "tea"): (25, 100)} and seen == [("milk", "tea")] * 25
    seen.clear()
    assert sets(0.25) == {("tea",): (25, 100), ("milk",): (25, 100), ("milk", "tea"): (25, 100)}
    seen.clear()
    assert sets(0.26) == {} and seen == []
    lines = lines.where("product_name != 'milk'")
    assert sets(0.1) == {k: v for k, v in singles.items() if k != ("milk",)} and seen == []


def test_baskets_of_frequent_pairs_stay_in_their_tasks(spark, monkeypatch):
    monkeypatch.setattr(dealing, "TASK_ROWS", 100)
    tx = spark.range(250).selectExpr("id transaction_id", "timestamp_ntz '2024-06-01' transaction_date")
    items = spark.range(1_000).selectExpr("id % 250 transaction_id", "id % 7 product_id")
    products = spark.range(7).selectExpr("id product_id", "concat('p', id) name", "'c' category")
    gathered = r._gathered(r._basket_items(r.basket_lines(items, tx, products, AS_OF, None), "product_name")).persist()
    try:
        assert gathered.count() == 250
        kept = r._only_partners(gathered, r._with_partner(gathered, 250, 0.1), 0.1)
        by_task = [x["count"] for x in kept.groupBy(F.spark_partition_id()).count().collect()]
        assert len(by_task) > 8 and max(by_task) < sum(by_task) / 5
    finally:
        gathered.unpersist()


def test_pair_rules_are_the_single_item_rules(baskets):
    got = {(x["antecedent"], x["consequent"]): x["lift"] for x in r.pair_rules(baskets, 0.2, 0.3).collect()}
    expected = {(a[0], b[0]): v[2] for (a, b), v in _brute_rules(0.2, 0.3).items() if len(a) == len(b) == 1}
    assert set(got) == set(expected) and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_rule_edges(spark, rows):
    rules = spark.createDataFrame([(["a", "b"], ["c", "d"], 1.5)],
                                  "antecedents array<string>, consequents array<string>, lift double")
    assert rows(r.rule_edges(rules)) == [(x, y, 1.5) for x in "ab" for y in "cd"]


def test_cosine_counts_lines(baskets):
    got = {(x["a"], x["b"]): x["score"] for x in r.item_cosine(baskets).collect()}
    matrix = pd.crosstab([b[0] for b in BASKETS], [b[1] for b in BASKETS]).to_numpy(float)
    norm = np.linalg.norm(matrix, axis=0)
    dense = matrix.T @ matrix / np.outer(norm, norm)
    for a in range(4):
        for b in range(4):
            if a != b:
                assert got.get((a + 1, b + 1), 0.0) == pytest.approx(dense[a, b])
    assert all(0 <= s <= 1 + 1e-12 and got[b, a] == s for (a, b), s in got.items())


def test_similar_products_all_and_one(baskets, rows):
    every = r.similar_products(baskets, 2)
    for product in (1, 2, 3, 4):
        some = r.similar_to(baskets, product, 2)
        assert rows(some, "a", "b") == rows(every.where(every["a"] == product), "a", "b")
    best = r.similar_to(baskets, 1, 1).first()
    assert best["b"] == 3 and best["score"] == pytest.approx(4 / sqrt(6 * 3))


def test_category_correlation_has_zeros_diagonal_and_both_orders(baskets):
    got = {(x["a"], x["b"]): x["score"] for x in r.category_correlation(baskets, full=True).collect()}
    meeting = {(x["a"], x["b"]): x["score"] for x in r.category_correlation(baskets).collect()}
    assert len(meeting) == 7 and meeting.items() <= got.items()
    dense = pd.crosstab([b[0] for b in BASKETS], [b[3] for b in BASKETS]).corr()
    assert len(got) == 9
    assert all(got[a, b] == pytest.approx(dense.loc[a, b]) for a in dense for b in dense)


def test_category_bought_the_same_everywhere(spark):
    lines = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "a", "x")], LINES)
    assert [tuple(x) for x in r.category_correlation(lines).collect()] == [("x", "x", None)]


# -- baskets of products and customers -----------------------------------------

@pytest.fixture
def copurchase(spark):
    recent, old = datetime(2024, 6, 1), datetime(2024, 1, 1)
    tx = spark.createDataFrame([
        (1, 100, recent), (2, 101, recent), (3, None, recent), (4, 100, old), (5, 102, datetime(2024, 4, 2))],
        "transaction_id long, customer_id long, transaction_date timestamp_ntz")
    items = spark.createDataFrame([
        (1, 1, 2, 1.5), (1, 2, 1, 2.0), (1, 2, 1, 2.0), (1, 3, 1, 4.0), (2, 1, 1, 1.5), (2, 3, 5, 4.0), (2, 2, 1, 2.0),
        (3, 1, 1, 1.5), (3, 4, 1, 9.0), (4, 1, 1, 1.5), (4, 4, 1, 9.0), (5, 2, 1, 2.0)],
        "transaction_id long, product_id long, quantity int, unit_price double")
    products = spark.createDataFrame([(i, f"p{i}", "even" if i % 2 == 0 else "odd") for i in (1, 2, 3, 4)],
                                     "product_id long, name string, category string")
    return items, tx, products


def test_bought_together_window_and_ties(copurchase, rows):
    got = r.bought_together(*copurchase, product_id=1, as_of=AS_OF, k=3).collect()
    assert sorted((x["related_product_id"], x["co_purchase_count"]) for x in got) == [(2, 2), (3, 2), (4, 1)]
    top = r.bought_together(*copurchase, product_id=1, as_of=AS_OF, k=1)
    assert rows(top, "related_product_id", "related_product_name", "related_category") == [(2, "p2", "even")]


def test_shared_customers_ignore_unknown_customers(copurchase, rows):
    got = r.shared_customers(*copurchase, product_id=1)
    assert rows(got, "similar_product_id", "common_customers") == [(2, 2), (3, 2), (4, 1)]


def test_all_products_at_once_equal_one_by_one(copurchase, rows):
    together, shared = r.bought_together_all(*copurchase, AS_OF, 2), r.shared_customers_all(*copurchase, 2)
    for product in (1, 2, 3, 4):
        assert rows(together.where(f"product_id = {product}")) == rows(
            r.bought_together(*copurchase, product, AS_OF, 2))
        assert rows(shared.where(f"product_id = {product}")) == rows(r.shared_customers(*copurchase, product, 2))


def test_category_performance(copurchase, rows):
    got = r.category_performance(*copurchase, AS_OF)
    assert [x["category"] for x in got.collect()] == ["odd", "even"]
    assert rows(got, "category", "transaction_count", "total_quantity", "total_revenue", "product_count") == [
        ("even", 4, 5, 17.0, 2), ("odd", 3, 10, 30.0, 2)]


def test_lookup(copurchase):
    products = copurchase[2]
    assert r.product_lookup(products, 3).first()["product_name"] == "p3"
    assert r.product_lookup(products, 9).count() == 0
    with pytest.raises(ValueError):
        r.product_lookup(products, 9, strict=True)
    with pytest.raises(ValueError):
        r.product_report(*copurchase, 9, AS_OF)
    assert set(r.product_report(*copurchase, 1, AS_OF)) == {
        "similar_products", "frequently_bought_together", "category_analysis"}


# -- advice --------------------------------------------------------------------------

@pytest.fixture
def rules_corr(spark):
    rules = spark.createDataFrame([
        (["a"], ["b"], 0.8, 2.5), (["a"], ["c"], 0.7, 3.0), (["b"], ["c"], 0.9, 2.0), (["c"], ["a", "b"], 0.71, 2.01)],
        "antecedents array<string>, consequents array<string>, confidence double, lift double")
    corr = spark.createDataFrame(
        [("x", "x", 1.0), ("x", "y", 0.6), ("y", "x", 0.6), ("x", "z", 0.5), ("z", "x", 0.5), ("y", "y", 1.0)],
        "a string, b string, score double")
    return rules, corr


def test_insights(rules_corr):
    row = r.recommendation_insights(*rules_corr).first()
    assert (row["strong_rules"], row["strong_category_pairs"]) == (2, 1)
    assert row["rule_insight"] == "Found 2 strong product associations for cross-selling"
    assert row["category_insight"] == "Identified 1 strong category relationships"
    none = r.recommendation_insights(rules_corr[0].where("lift > 9"), rules_corr[1].where("score > 9")).first()
    assert tuple(none) == (0, 0, None, None)


def test_strategies(rules_corr, rows):
    got = rows(r.recommendation_strategies(*rules_corr), "type", "a", "b", "score")
    assert got == [("Category-based", "x", "y", 0.6), ("Cross-selling", "a", "b", 2.5),
                   ("Cross-selling", "a", "c", 3.0), ("Cross-selling", "c", "a, b", 2.01)]
    assert len(rows(r.recommendation_strategies(*rules_corr, k=1))) == 2


def test_basket_lines(copurchase, rows):
    got = Counter(x[0] for x in rows(r.basket_lines(*copurchase, AS_OF), "transaction_id"))
    assert got == {1: 4, 2: 3, 3: 2, 5: 1}


def test_tasks_of_all_time_follow_the_rows(spark, monkeypatch):
    """Adaptive execution puts so few rows into one task."""
    monkeypatch.setattr(dealing, "TASK_ROWS", 100)
    tx = spark.range(250).selectExpr("id transaction_id", "timestamp_ntz '2024-06-01' transaction_date")
    items = spark.range(1_000).selectExpr("if(id % 9 = 8, null, id % 250) transaction_id", "id % 7 product_id")
    products = spark.range(7).selectExpr("id product_id", "concat('p', id) name", "'c' category")
    lines = r.basket_lines(items, tx, products, AS_OF, None)
    by_task = [x["count"] for x in lines.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert sum(by_task) == 889 and max(by_task) < 200
    whole = r._basket_items(lines, "product_name").withColumn("task", F.spark_partition_id())
    assert whole.groupBy("basket").agg(F.countDistinct("task").alias("n")).where("n > 1").isEmpty()
    assert whole.select("task").distinct().count() > 8


def test_baskets_of_all_time_stay_in_their_tasks(spark, monkeypatch):
    """Neither a join with many products nor the gathering of baskets or pairs deals them anew."""
    monkeypatch.setattr(dealing, "TASK_ROWS", 100)
    tx = spark.range(250).selectExpr("id transaction_id", "timestamp_ntz '2024-06-01' transaction_date")
    items = spark.range(1_000).selectExpr("if(id % 9 = 8, null, id % 250) transaction_id", "id % 7 product_id")
    products = spark.range(7).selectExpr("id product_id", "concat('p', id) name", "concat('c', id % 3) category")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = r.basket_lines(items, tx, products, AS_OF, None)
        rows = r._basket_items(lines, "category")
        frequent = r._frequent(rows, F.lit(250), 0.1)
        gathered = r._only_frequent(rows, frequent, 0.1).groupBy("basket").agg(F.collect_list("item").alias("items"))
        met = pairs._meetings(rows, "basket", "item", F.lit(1), pairs.BLOCK)
        for whole in (lines, rows, gathered, met):
            by_task = [x["count"] for x in whole.groupBy(F.spark_partition_id()).count().collect()]
            assert len(by_task) > 8 and max(by_task) < sum(by_task) / 5
        assert met.count() > 0 and gathered.count() == gathered.select("basket").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_insights_count_categories_that_never_meet(spark, monkeypatch):
    lines = spark.createDataFrame([(i, i, f"n{i}", f"c{i % 12}") for i in range(36)],
                                  "transaction_id long, product_id long, product_name string, category string")
    monkeypatch.setattr(entry, "_baskets", lambda t, days=90: lines)
    got = entry.RECOMMEND["recommendation_insights"](None).first()
    assert got["strong_category_pairs"] == 66  # each two of 12 correlate with -1/11
