"""Customer value as a model: how often customers buy, and whether they still do.

The beta-geometric / negative binomial model of Fader, Hardie and Lee (2005): a customer
buys at a rate drawn from a gamma distribution (r, alpha) and leaves after each purchase
with a probability drawn from a beta distribution (a, b). Its likelihood needs three numbers
of a customer, so customers with equal numbers are counted together; each round of the fit
is one pass over those counts that returns a few sums, however many customers there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from math import lgamma
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import timestamp
from ..plans.durable import written_once

#: Standard deviation of the weak prior on the logarithms of the parameters: it settles those
#: that the data say nothing of (nobody ever leaves, say) and does not move the others.
PRIOR = 10.0
_STEP, _ROUNDS, _DAMPING = 1e-3, 60, (0.0, 0.01, 0.1, 1.0, 10.0, 100.0)


class ValueModel(NamedTuple):
    r: float
    alpha: float
    a: float
    b: float


def purchase_history(transactions: DataFrame, as_of) -> DataFrame:
    """One row per customer who bought until ``as_of``: customer_id, repeats (days with
    purchases after the first), recency (days from the first to the last), age (days from the
    first to ``as_of``), average_order_value. Purchases of one day are one; rows without a
    customer or a date are left out."""
    bought = transactions.where(F.col("customer_id").isNotNull() & (F.col("transaction_date") <= timestamp(as_of)))
    days = bought.groupBy("customer_id", F.to_date("transaction_date").alias("day")).agg(
        F.sum(F.col("total_amount").cast("decimal(18,4)")).alias("spent"), F.count("total_amount").alias("orders"))
    return days.groupBy("customer_id").agg(
        (F.count(F.lit(1)) - 1).alias("repeats"),
        F.datediff(F.max("day"), F.min("day")).cast("long").alias("recency"),
        F.datediff(F.to_date(timestamp(as_of)), F.min("day")).cast("long").alias("age"),
        F.try_divide(F.sum("spent").cast("double"), F.sum("orders")).alias("average_order_value"))


def _lgamma(values: np.ndarray) -> np.ndarray:
    distinct, at = np.unique(values, return_inverse=True)
    return np.array([lgamma(v) for v in distinct])[at]


def _log_likelihood(model: Sequence[float], repeats: np.ndarray, recency: np.ndarray, age: np.ndarray) -> np.ndarray:
    r, alpha, a, b = model
    bought = _lgamma(r + repeats) - lgamma(r) + r * np.log(alpha)
    stayed = lgamma(a + b) - lgamma(b) + _lgamma(b + repeats) - _lgamma(a + b + repeats)
    alive = -(r + repeats) * np.log(alpha + age)
    gone = np.log(a) - np.log(b + np.maximum(repeats, 1) - 1) - (r + repeats) * np.log(alpha + recency)
    return bought + stayed + np.logaddexp(alive, np.where(repeats > 0, gone, -np.inf))


def _sums(batches: Iterator[pa.RecordBatch], models: list[tuple[float, ...]]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(models))
    for batch in batches:
        repeats, recency, age, customers = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
        total += [customers @ _log_likelihood(m, repeats, recency, age) for m in models]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int64()), pa.array(total)], ["model", "value"])


def history_counts(history: DataFrame) -> DataFrame:
    """(repeats, recency, age, customers): how many customers have the same three numbers."""
    return history.groupBy("repeats", "recency", "age").agg(F.count(F.lit(1)).alias("customers"))


def log_likelihoods(counts: DataFrame, models: Sequence[Sequence[float]]) -> DataFrame:
    """(model, log_likelihood) of all customers under each of ``models`` (r, alpha, a, b),
    numbered from 0; one pass."""
    parts = counts.select("repeats", "recency", "age", "customers").mapInArrow(
        partial(_sums, models=[tuple(map(float, m)) for m in models]), "model long, value double")
    return parts.groupBy("model").agg(F.sum("value").alias("log_likelihood"))


def _derivatives(evaluate, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and second derivatives by central differences, in one evaluation."""
    n, unit = len(at), np.eye(len(at)) * _STEP
    pairs = [(i, j) for i in range(n) for j in range(i)]
    points = [at, *(at + unit), *(at - unit)]
    points += [at + s * unit[i] + t * unit[j] for i, j in pairs for s in (1, -1) for t in (1, -1)]
    value = evaluate(points)
    up, down = value[1:n + 1], value[n + 1:2 * n + 1]
    second = np.diag((up - 2 * value[0] + down) / _STEP ** 2)
    for (i, j), (pp, pm, mp, mm) in zip(pairs, value[2 * n + 1:].reshape(-1, 4)):
        second[i, j] = second[j, i] = (pp - pm - mp + mm) / (4 * _STEP ** 2)
    return value[0], (up - down) / (2 * _STEP), second


def fit_value_model(history: DataFrame) -> ValueModel | None:
    """The parameters of highest likelihood over all customers; null of an empty history.

    Damped Newton steps in the logarithms of the parameters: a pass for the derivatives, one
    that tries the steps. Runs jobs when called."""
    counts = written_once(history_counts(history), "history")
    total, repeats, age = counts.agg(F.sum("customers"), F.sum(F.col("customers") * F.col("repeats")),
                                     F.sum(F.col("customers") * F.col("age"))).first()
    if not total:
        return None

    def evaluate(points: Sequence[np.ndarray]) -> np.ndarray:
        found = {r["model"]: r["log_likelihood"] for r in log_likelihoods(counts, [np.exp(p) for p in points]).collect()}
        return np.array([found[i] - (p @ p) / (2 * PRIOR ** 2) for i, p in enumerate(points)])

    at = np.log([1.0, max(age, 1) / (repeats + total), 1.0, 2.0])
    for _ in range(_ROUNDS):
        value, slope, second = _derivatives(evaluate, at)
        size, axes = np.linalg.eigh(-second)
        size = np.maximum(np.abs(size), 1e-9 * total)
        steps = [axes @ ((axes.T @ slope) / (size + damping * size.mean())) for damping in _DAMPING]
        steps = [s / max(1.0, np.abs(s).max()) for s in steps]
        tried = evaluate([at + s for s in steps])
        best = int(tried.argmax())
        if tried[best] <= value:
            break
        at = at + steps[best]
        if tried[best] - value <= 1e-9 * abs(value):
            break
    return ValueModel(*np.exp(at).tolist())


def _series(a: np.ndarray, b: float, c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Gauss's hypergeometric series at 0 <= z < 1."""
    term = total = np.ones(len(z))
    for k in range(100_000):
        term = term * (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        total = total + term
        if not len(z) or np.abs(term / np.maximum(np.abs(total), 1e-300)).max() < 1e-13:
            break
    return total


def _expected(batches: Iterator[pa.RecordBatch], model: ValueModel, days: float) -> Iterator[pa.RecordBatch]:
    r, alpha, a, b = model
    a = a if abs(a - 1) > 1e-6 else 1 + 1e-6  # the formula divides by a - 1
    for batch in batches:
        x, last, age, order = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, 5))
        odds = np.log(a) - np.log(b + np.maximum(x, 1) - 1) + (r + x) * (np.log(alpha + age) - np.log(alpha + last))
        alive = 1 / (1 + np.where(x > 0, np.exp(np.minimum(odds, 700)), 0))
        z = days / (alpha + age + days)
        # Euler's transformation: the series' parameters do not grow with x.
        rest = (1 - z) ** (a - 1) * _series(np.full(len(x), a + b - 1 - r), a - 1, a + b + x - 1, z)
        orders = (a + b + x - 1) / (a - 1) * (1 - rest) * alive
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(alive), pa.array(orders), pa.array(orders * order, from_pandas=True)],
            ["customer_id", "repeats", "recency", "age", "average_order_value", "alive", "expected_orders", "expected_value"])


def customer_value_model(history: DataFrame, model: ValueModel | None, days: float = 365.0) -> DataFrame:
    """``purchase_history`` with, of every customer, the probability of still being one
    (alive), the days with purchases expected in the next ``days`` days, and their value at
    the customer's average order (null where no amount is known). Empty without a model."""
    columns = ["customer_id", "repeats", "recency", "age", "average_order_value"]
    kind = history.schema["customer_id"].dataType.simpleString()
    schema = (f"customer_id {kind}, repeats long, recency long, age long, average_order_value double, alive double, "
              "expected_orders double, expected_value double")
    if model is None:
        return history.sparkSession.createDataFrame([], schema)
    return history.select(columns).mapInArrow(partial(_expected, model=model, days=float(days)), schema)
