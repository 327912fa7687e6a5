"""The purchase model against simulated customers and plain loops."""

from math import exp, lgamma, log

import numpy as np
import pytest

from tillwise.operators import value_model as v

TRUE = v.ValueModel(1.2, 60.0, 0.8, 2.5)
HISTORY = "customer_id long, repeats long, recency long, age long, average_order_value double"


def _simulated(n, ahead, seed=4):
    """(history rows, purchases of each customer in the ``ahead`` days after)."""
    draw = np.random.default_rng(seed)
    rows, later = [], []
    for i in range(n):
        age, rate, leave = int(draw.integers(200, 700)), draw.gamma(TRUE.r, 1 / TRUE.alpha), draw.beta(TRUE.a, TRUE.b)
        now, times = 0.0, []
        while (now := now + draw.exponential(1 / rate)) <= age + ahead:
            times.append(now)
            if draw.random() < leave:
                break
        past = [t for t in times if t <= age]
        rows.append((i, len(past), int(past[-1]) if past else 0, age, 10.0 if i else None))
        later.append(len(times) - len(past))
    return rows, later


def test_parameters_of_simulated_customers(spark):
    rows, later = _simulated(6000, 180)
    history = spark.createDataFrame(rows, HISTORY)
    model = v.fit_value_model(history)
    assert np.abs(np.log(np.array(model) / np.array(TRUE))).max() < 0.3
    values = {r["model"]: r["log_likelihood"] for r in v.log_likelihoods(v.history_counts(history), [model, TRUE]).collect()}
    assert values[0] >= values[1]
    got = {r["customer_id"]: r for r in v.customer_value_model(history, model, 180).collect()}
    assert len(got) == 6000 and all(0 <= r["alive"] <= 1 and r["expected_orders"] >= 0 for r in got.values())
    assert sum(r["expected_orders"] for r in got.values()) == pytest.approx(sum(later), rel=0.08)
    often = [i for i, row in enumerate(rows) if row[1] >= 4]
    assert sum(got[i]["expected_orders"] for i in often) == pytest.approx(sum(later[i] for i in often), rel=0.12)
    assert got[0]["expected_value"] is None and got[1]["expected_value"] == pytest.approx(10 * got[1]["expected_orders"])
    again = v.fit_value_model(history.repartition(13, "age"))
    assert again == pytest.approx(model, rel=1e-3)


def test_likelihood_and_expectation_by_plain_loops(spark):
    rows, _ = _simulated(60, 10, seed=9)
    history = spark.createDataFrame(rows * 2, HISTORY)
    r, alpha, a, b = TRUE
    want = 0.0
    for _, x, last, age, _ in rows * 2:
        rising = sum(log(r + k) for k in range(x)) + r * log(alpha)  # gamma(r + x) / gamma(r)
        stayed = exp(lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x))
        left = exp(lgamma(a + b) + lgamma(a + 1) + lgamma(b + x - 1) - lgamma(a) - lgamma(b) - lgamma(a + b + x)) if x else 0.0
        want += rising + log(stayed * (alpha + age) ** -(r + x) + left * (alpha + last) ** -(r + x))
    assert v.log_likelihoods(v.history_counts(history), [TRUE]).first()["log_likelihood"] == pytest.approx(want)

    # A customer known to be one: orders in the days ahead as the mean over posterior draws.
    draw = np.random.default_rng(1)
    x, age, days = 3, 300, 200
    rate, leave = draw.gamma(r + x, 1 / (alpha + age), 400_000), draw.beta(a, b + x, 400_000)
    expected = ((1 - np.exp(-leave * rate * days)) / leave).mean()
    one = v.customer_value_model(spark.createDataFrame([(1, x, age, age, 1.0)], HISTORY), TRUE, days).first()
    assert one["expected_orders"] / one["alive"] == pytest.approx(expected, rel=0.01)


def test_history_and_hard_cases(spark):
    rows = [(1, 5, "2001-01-01 08:00:00", 10.0), (2, 5, "2001-01-01 20:00:00", 20.0), (3, 5, "2001-01-31 08:00:00", 30.0),
            (4, None, "2001-01-02 08:00:00", 1.0), (5, 6, None, 1.0), (6, 7, "2001-02-28 10:00:00", None), (7, 7, "2001-03-02 00:00:00", 1.0)]
    table = spark.createDataFrame(rows, "transaction_id long, customer_id long, transaction_date string, total_amount double")
    table = table.withColumn("transaction_date", table.transaction_date.cast("timestamp"))
    history = v.purchase_history(table, "2001-03-01")
    assert sorted(map(tuple, history.collect())) == [(5, 1, 30, 59, 20.0), (7, 0, 0, 1, None)]
    assert v.fit_value_model(history.where("false")) is None
    assert v.customer_value_model(history, None).count() == 0
    # Nobody leaves and all buy alike: the likelihood has no maximum, the prior gives one.
    regular = spark.createDataFrame([(i, 12, 360, 365, 1.0) for i in range(50)], HISTORY)
    model = v.fit_value_model(regular)
    assert all(np.isfinite(model))
    got = v.customer_value_model(regular, model).first()
    assert got["alive"] > 0.9 and got["expected_orders"] == pytest.approx(12, rel=0.15)
    once = v.fit_value_model(spark.createDataFrame([(i, 0, 0, 0, 1.0) for i in range(3)], HISTORY))
    assert all(np.isfinite(once))
