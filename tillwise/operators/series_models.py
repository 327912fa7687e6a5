"""Forecast models of very many series, one row each.

The closed-form model of ``forecast.seasonal_trend_forecast``, for grains at which most
days have no sale. Only days with sales are rows: they are gathered by series, and the
days between them come from the calendar inside the task that fits the series. A model is
a line, three arrays of indices, the spread of its residuals and its errors on the test
days. Accuracy, patterns, advice and the days ahead are read off the models, so there is
never a row for a series and a day without a sale.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_quantile, timestamp
from .forecast import (
    MIN_DAYS, MONTHLY_FROM, SHORT_TEST, SHORT_TRAIN, TOO_SHORT, WEEKLY_FROM, YEARLY_FROM, advice_of, daily_sales,
)

#: Series times days that are fitted together.
_CELLS = 1 << 19
_EFFECTS = (("weekly", 7, WEEKLY_FROM), ("yearly", 12, YEARLY_FROM), ("monthly", 31, MONTHLY_FROM))
_SCHEMA = ("series_id string, first_day date, last_day date, train_days int, test_days int, level double, slope double, "
           "weekly array<double>, yearly array<double>, monthly array<double>, spread double, first_trend double, "
           "last_trend double, mae double, mape double, rmse double, r2 double")


class _Calendar:
    """The days of all series, and the weekday, month and day of month of each."""

    def __init__(self, first: np.datetime64, days: int):
        self.day = first + np.arange(days)
        month = self.day.astype("datetime64[M]")
        # 1970-01-01 was a Thursday; weekdays count from Sunday.
        self.slots = {"weekly": (self.day.astype(np.int64) + 4) % 7, "yearly": month.astype(np.int64) % 12,
                      "monthly": (self.day - month).astype(np.int64)}
        self.marks = {name: np.eye(size)[self.slots[name]] for name, size, _ in _EFFECTS}


def _sum(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    return np.where(where, values, 0.0).sum(1)


def _mean(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return _sum(values, where) / where.sum(1)


def _fitted(y: np.ndarray, calendar: _Calendar, periods: int, z: float, clip_outliers: bool) -> dict[str, np.ndarray]:
    """Models of some series (rows) from their sales by day; NaN is a day that is not known."""
    known = ~np.isnan(y)
    smallest = np.where(known & (y > 0), y, np.inf).min(1, keepdims=True)
    y = np.where(y == 0, np.where(np.isinf(smallest), 1.0, smallest) * 0.1, y)
    if clip_outliers:
        low, high = np.nanquantile(np.where(known.any(1, keepdims=True), y, 0.0), [0.25, 0.75], axis=1, keepdims=True)
        y = np.clip(y, low - 1.5 * (high - low), high + 1.5 * (high - low))
    n = known.sum(1)
    cut = np.floor(n * 0.8).astype(np.int64)
    cut = np.where(cut >= SHORT_TRAIN, cut, np.where(n > SHORT_TEST, n - SHORT_TEST, n))
    train = known & (known.cumsum(1) <= cut[:, None])
    test = known & ~train
    first, last = known.argmax(1), y.shape[1] - 1 - known[:, ::-1].argmax(1)

    t = np.arange(y.shape[1]) - first[:, None].astype(float)
    middle, mean = _mean(t, train), _mean(y, train)
    away = np.where(train, t - middle[:, None], 0.0)
    spread_t = (away * away).sum(1)
    slope = (away * np.where(train, y - mean[:, None], 0.0)).sum(1) / np.where(spread_t > 0, spread_t, 1.0)
    level = mean - slope * middle
    at = lambda days: np.maximum(level[:, None] + slope[:, None] * days, 1e-9)
    yhat = at(t)
    left = np.where(known, y, 0.0) / yhat
    found = {}
    for name, _, since in _EFFECTS:
        usable = train & np.isfinite(left)
        count = usable @ calendar.marks[name]
        total = np.where(usable, left, 0.0) @ calendar.marks[name]
        index = np.where((cut >= since)[:, None] & (count > 0), total / np.maximum(count, 1), 1.0)
        found[name] = index
        by_day = index[:, calendar.slots[name]]
        yhat = yhat * by_day
        with np.errstate(divide="ignore", invalid="ignore"):
            left = left / by_day
    error = np.where(known, y - yhat, 0.0)
    residual = _mean(error, train)
    squares = _sum((error - residual[:, None]) ** 2, train)
    spread = np.where(cut > 1, np.sqrt(squares / np.maximum(cut - 1, 1)), 0.0) * z

    with np.errstate(divide="ignore", invalid="ignore"):
        relative = np.abs(error / y)
    missed = _sum(error * error, test)
    # Equal test values have no spread, whatever their mean is rounded to.
    equal = np.where(test, y, -np.inf).max(1) == np.where(test, y, np.inf).min(1)
    varied = np.where(equal, 0.0, _sum((y - _mean(y, test)[:, None]) ** 2, test))
    r2 = np.where(varied > 0, 1 - missed / np.where(varied > 0, varied, 1.0), np.where(missed < 1e-18, 1.0, 0.0))
    return found | {
        "n": n, "train_days": cut, "test_days": test.sum(1), "first": first, "last": last, "level": level, "slope": slope,
        "spread": spread, "first_trend": at(0.0)[:, 0], "last_trend": at((last - first + periods)[:, None])[:, 0],
        "mae": _mean(np.abs(error), test), "mape": _mean(np.where(y == 0, 0.0, relative), test & (y != 0)) * 100,
        "rmse": np.sqrt(_mean(error * error, test)), "r2": r2}


def _models(batches: Iterator[pa.RecordBatch], periods: int, z: float, clip_outliers: bool) -> Iterator[pa.RecordBatch]:
    calendar = None
    for batch in batches:
        names, sold = batch.column(0), batch.column(3)
        if not len(names):
            continue
        if calendar is None:
            calendar = _Calendar(np.datetime64(batch.column(1)[0].as_py(), "D"), batch.column(2)[0].as_py())
        days = len(calendar.day)
        rows = max(1, _CELLS // days)
        at = np.concatenate(([0], np.cumsum(np.asarray(sold.value_lengths()))))
        flat = sold.flatten()
        day, value = np.asarray(flat.field("day")), np.asarray(flat.field("y").cast(pa.float64()).fill_null(np.nan))
        for low in range(0, len(names), rows):
            high = min(low + rows, len(names))
            y = np.zeros((high - low, days))
            some = slice(at[low], at[high])
            y[np.repeat(np.arange(high - low), np.diff(at[low:high + 1])), day[some]] = value[some]
            m = _fitted(y, calendar, periods, z, clip_outliers)
            short, untested = m["n"] < MIN_DAYS, m["test_days"] < 3
            number = lambda name, hidden: pa.array(m[name], pa.float64(), mask=hidden | ~np.isfinite(m[name]))
            indices = lambda name: pa.array([None if s else x for s, x in zip(short, m[name].tolist())], pa.list_(pa.float64()))
            none = short & (m["n"] == 0)
            date = lambda name: pa.array(calendar.day[m[name]], pa.date32(), mask=none)
            count = lambda name: pa.array(np.where(short, 0, m[name]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [names.slice(low, high - low).cast(pa.string()), date("first"), date("last"), count("train_days"), count("test_days"),
                 number("level", short), number("slope", short), *(indices(name) for name, _, _ in _EFFECTS),
                 number("spread", short), number("first_trend", short), number("last_trend", short),
                 *(number(name, short | untested) for name in ("mae", "mape", "rmse", "r2"))],
                [field.split()[0] for field in _SCHEMA.split(", ")])


def series_models(sales: DataFrame, start: Column, end: Column, periods: int = 30, interval: float = 0.95,
                  clip_outliers: bool = True) -> DataFrame:
    """``sales`` (series_id, ds, y), days with a sale -> one model per series sold between
    ``start`` and ``end``; other days of these count as 0.

    Conditioning, the split in training and test days and the model are those of
    ``seasonal_trend_forecast``. A series of under 7 known days has no model; one with
    under 3 test days no errors. A day whose y is null is not known and left out. What is
    shuffled and gathered is a row per series and day with a sale.
    """
    day = F.struct(F.datediff("ds", "first").alias("day"), F.col("y").cast("double").alias("y"))
    sold = sales.withColumns({"first": start, "last": end}).where(F.col("ds").between(F.col("first"), F.col("last")))
    sold = sold.groupBy("series_id").agg(
        F.first("first").alias("first"), (F.datediff(F.first("last"), F.first("first")) + 1).alias("days"),
        F.collect_list(day).alias("sold"))
    z = normal_quantile(0.5 + interval / 2)
    return sold.mapInArrow(partial(_models, periods=periods, z=z, clip_outliers=clip_outliers), _SCHEMA)


def demand_models(items: DataFrame, transactions: DataFrame, as_of, grain: str = "product", products: DataFrame | None = None,
                  periods: int = 30, interval: float = 0.95, clip_outliers: bool = True) -> DataFrame:
    """Models of the daily quantity from the first transaction of the whole table to ``as_of``."""
    start = transactions.agg(F.to_date(F.min("transaction_date"))).scalar()
    sales = daily_sales(items, transactions, grain, products)
    return series_models(sales, start, F.to_date(timestamp(as_of)), periods, interval, clip_outliers)


def _has_model() -> Column:
    return F.col("level").isNotNull()


def model_accuracy(models: DataFrame) -> DataFrame:
    """What ``forecast_accuracy`` says of each series."""
    return models.select("series_id", F.col("test_days").cast("long").alias("test_days"), "mae", "mape", "rmse", "r2",
                         F.when(~_has_model(), TOO_SHORT).alias("error"))


def model_advice(models: DataFrame) -> DataFrame:
    """What ``forecast_advice`` says of each series."""
    return advice_of(models.where(_has_model()).select(
        "series_id", F.try_divide("last_trend", "first_trend").alias("change"), F.col("weekly").alias("week"), "mape"))


def model_patterns(models: DataFrame) -> DataFrame:
    """What ``seasonal_patterns`` says of each series: (series_id, pattern, position, label,
    value) of the effects that its training days allow."""
    def slots(name: str, since: int, label) -> Column:
        rows = F.transform(name, lambda value, i: F.struct(
            F.lit(name).alias("pattern"), (i + 1).alias("position"), label(i).alias("label"), value.alias("value")))
        return F.when(F.col("train_days") >= since, rows).otherwise(F.slice(rows, 1, 0))

    # A year, and a week that begins on a Sunday.
    month = lambda i: F.date_format(F.make_date(F.lit(2023), i + 1, F.lit(1)), "MMMM")
    weekday = lambda i: F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), i), "EEEE")
    every = F.concat(slots("yearly", YEARLY_FROM, month), slots("weekly", WEEKLY_FROM, weekday),
                     slots("monthly", MONTHLY_FROM, lambda i: (i + 1).cast("string")))
    return models.where(_has_model()).select("series_id", F.inline(every))


def model_forecast(models: DataFrame, periods: int = 30) -> DataFrame:
    """The ``periods`` days after each series' last one: series_id, ds, trend, weekly,
    yearly, monthly, yhat and its bounds."""
    ahead = models.where(_has_model()).select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
    ahead = ahead.withColumn("ds", F.date_add("last_day", F.col("step"))).withColumn("t", F.datediff("ds", "first_day"))
    effect = lambda name, slot: F.get(name, slot - 1).alias(name)
    rows = ahead.select(
        "series_id", "ds", "spread", F.greatest(F.col("level") + F.col("slope") * F.col("t"), F.lit(1e-9)).alias("trend"),
        effect("weekly", F.dayofweek("ds")), effect("yearly", F.month("ds")), effect("monthly", F.dayofmonth("ds")))
    yhat = F.col("trend") * F.col("weekly") * F.col("yearly") * F.col("monthly")
    return rows.select("series_id", "ds", "trend", "weekly", "yearly", "monthly", yhat.alias("yhat"),
                       (yhat - F.col("spread")).alias("yhat_lower"), (yhat + F.col("spread")).alias("yhat_upper"))
