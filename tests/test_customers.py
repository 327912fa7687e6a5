from datetime import datetime

import numpy as np
import pytest

from tillwise.operators import customers as c

AS_OF = "2024-07-01"
TX = "transaction_id long, customer_id long, transaction_date timestamp_ntz, total_amount double"


@pytest.fixture
def tx_small(spark):
    return spark.createDataFrame([
        (1, 10, datetime(2024, 6, 29, 1), 20.0),     # 47 hours before: one whole day
        (2, 10, datetime(2023, 7, 2), 5.5),          # exactly at the cutoff
        (3, 11, datetime(2023, 7, 1, 23, 59), 9.0),  # a minute too early
        (4, None, datetime(2024, 6, 1), 99.0),
        (5, 12, datetime(2024, 6, 30, 12), 1.0),
    ], TX)


@pytest.fixture
def customers_idle(spark):
    return spark.createDataFrame(
        [(i, f"f{i}", f"l{i}", f"c{i}@example.com", None) for i in (10, 11, 12, 13)],
        "customer_id long, first_name string, last_name string, email string, phone string")


def test_rfm_window_and_whole_days(tx_small, rows):
    got = rows(c.rfm_metrics(tx_small, AS_OF), "customer_id", "frequency", "monetary", "recency")
    assert got == [(10, 2, 25.5, 1), (12, 1, 1.0, 0)]


def test_customer_rfm_keeps_idle_customers(customers_idle, tx_small):
    got = {r["customer_id"]: r for r in c.customer_rfm(customers_idle, tx_small, AS_OF).collect()}
    assert set(got) == {10, 11, 12, 13}
    idle = got[13]
    assert (idle["recency"], idle["frequency"], idle["monetary"], idle["last_purchase"]) == (365, 0, 0.0, None)
    # Only three frequencies exist (0, 1, 2): everyone scores 2.
    assert {r["F"] for r in got.values()} == {2}
    assert got[10]["RFM_Score"] == f"{got[10]['R']}2{got[10]['M']}"


def test_colliding_quartile_edges(spark):
    values = [1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(i, i, 1, v) for i, v in enumerate(values)],
                               "customer_id long, recency int, frequency long, monetary double")
    scored = c._with_scores(df, "R", "F", "M", keep_few=True).orderBy("customer_id").collect()
    assert [r["M"] for r in scored] == [1, 1, 1, 1, 1, 3, 4, 4]  # quartile edges are 1, 1 and 2.25
    assert [r["R"] for r in scored] == [4, 4, 3, 3, 2, 2, 1, 1]


@pytest.mark.parametrize("r,f,m,label", [
    (4, 4, 4, "Best Customers"), (3, 4, 4, "Loyal Customers"), (1, 4, 4, "Loyal Customers"),
    (1, 3, 4, "Big Spenders"), (1, 4, 3, "Lost Customers"), (4, 4, 3, "Recent Customers"),
    (4, 1, 1, "Recent Customers"), (2, 4, 3, "Average Customers"), (3, 3, 3, "Average Customers"),
])
def test_segment_labels(spark, r, f, m, label):
    from pyspark.sql import functions as F
    row = spark.range(1).select(c.segment_label(F.lit(r), F.lit(f), F.lit(m)).alias("s")).first()
    assert row["s"] == label


def test_code_segments(spark):
    # recency descending, frequency and monetary ascending with the id
    df = spark.createDataFrame([(i, 100 - 10 * i, i + 1, float(i + 1)) for i in range(8)],
                               "customer_id long, recency int, frequency long, monetary double")
    coded = c.rfm_codes(df)
    got = {r["customer_id"]: (r["rfm_score"], r["segment"]) for r in coded.collect()}
    assert got[7] == ("444", "Best Customers") and got[0] == ("111", "Lost Customers")
    assert got[4] == ("333", "Average Customers")
    summary = {r["segment"]: r for r in c.code_summary(coded).collect()}
    assert summary["Best Customers"]["count"] == 2 and summary["Best Customers"]["percentage"] == 25.0
    profile = {r["segment"]: r for r in c.segment_profile(coded).collect()}
    assert (profile["Lost Customers"]["recency_min"], profile["Lost Customers"]["recency_max"]) == (90, 100)
    assert sum(r["customer_id_count"] for r in profile.values()) == 8


def test_summary_shares_and_actions(customers_idle, tx_small, spark):
    scored = c.customer_rfm(customers_idle, tx_small, AS_OF)
    summary = c.segment_summary(scored).collect()
    assert sum(r["count"] for r in summary) == 4
    assert sum(r["percentage"] for r in summary) == pytest.approx(100)
    assert sum(r["total_monetary"] for r in summary) == pytest.approx(35.5)
    segments = spark.createDataFrame([("Lost Customers",), ("Best Customers",), ("Lost Customers",)], "Segment string")
    got = c.segment_actions(segments).collect()
    assert sorted((r["Segment"], r["action_no"]) for r in got if r["action"]) == [("Lost Customers", n) for n in (1, 2, 3)]
    assert [r["action"] for r in got if r["Segment"] == "Best Customers"] == [None]


def test_metrics_and_summary_skip_null_customers(customers_idle, tx_small, rows):
    got = rows(c.customer_metrics(tx_small), "customer_id", "transaction_count", "total_spent", "average_transaction")
    assert got == [(10, 2, 25.5, 12.75), (11, 1, 9.0, 9.0), (12, 1, 1.0, 1.0)]
    summary = rows(c.customer_summary(customers_idle, tx_small), "customer_id", "total_transactions", "total_spent")
    assert summary == [(10, 2, 25.5), (11, 1, 9.0), (12, 1, 1.0), (13, 0, None)]


def test_value_and_clusters(tx_small, rows):
    value = {r["customer_id"]: r for r in c.customer_value(tx_small, AS_OF).collect()}
    assert value[12]["orders_per_year"] == 365.0  # less than a day: counted as one
    assert value[10]["average_order_value"] == 12.75
    rfm = c.rfm_metrics(tx_small, AS_OF, days_back=400)
    clusters = c.customer_kmeans(rfm, k=2).collect()
    assert len(clusters) == 3 and {r["cluster"] for r in clusters} == {0, 1}


def test_clusters_do_not_depend_on_layout(spark):
    """Equal under 1 and 64 partitions, and those of a plain loop."""
    draw = np.random.default_rng(11)
    data = [(i, int(r), int(n), float(round(m, 2))) for i, (r, n, m) in enumerate(zip(
        draw.integers(0, 300, 900), draw.integers(1, 40, 900), draw.lognormal(5, 1, 900)))]
    rfm = spark.createDataFrame(data, "customer_id long, recency int, frequency long, monetary double")
    found = [{r["customer_id"]: r["cluster"] for r in c.customer_kmeans(rfm.repartition(n, "monetary")).collect()} for n in (1, 64)]
    assert found[0] == found[1]

    points = np.array([x[1:] for x in data], float)
    scale = points.std(axis=0, ddof=1)
    apart = lambda centres: (((points[:, None] - np.array(centres)) / scale) ** 2).sum(2)
    centres = [points.mean(0)]
    while len(centres) < 4:
        centres.append(points[apart(centres).min(1).argmax()])
    for _ in range(c.KMEANS_FIRST[0]):  # all customers are in the sample
        near = apart(centres).argmin(1)
        before, centres = centres, [points[near == j].mean(0) for j in range(len(centres)) if (near == j).any()]
        if len(before) == len(centres) and (((np.array(before) - centres) / scale) ** 2).sum(1).max() <= c.KMEANS_FIRST[1] ** 2:
            break
    centres = [points[apart(centres).argmin(1) == j].mean(0) for j in range(len(centres))]
    assert [found[0][x[0]] for x in data] == apart(sorted(map(tuple, centres))).argmin(1).tolist()


def test_clusters_of_few_customers(spark):
    schema = "customer_id long, recency int, frequency long, monetary double"
    same = spark.createDataFrame([(i, 5, 2, 9.5) for i in range(6)], schema)
    assert {r["cluster"] for r in c.customer_kmeans(same).collect()} == {0}
    two = spark.createDataFrame([(1, 5, 2, 9.5), (2, 50, 2, 9.5), (3, 50, 2, 9.5)], schema)
    assert {r["customer_id"]: r["cluster"] for r in c.customer_kmeans(two).collect()} == {1: 0, 2: 1, 3: 1}
    assert c.customer_kmeans(same.where("false")).count() == 0
