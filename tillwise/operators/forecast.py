"""Daily demand of many series at once: grid, conditioning, forecast, accuracy.

A series is a product, a category or everything (``grain``). Sales are reduced
to one row per series and day first; from there on all steps are partitioned by
``series_id``, whose groups hold one row per calendar day, so they stay small
however many lines were sold.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

import numpy as np
import pandas as pd
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import clip, days_before, normal_quantile, timestamp

# Shortest series, test days kept for short ones, and the numbers
# of training days from which weekly, monthly, holiday and yearly effects are used.
MIN_DAYS, SHORT_TRAIN, SHORT_TEST = 7, 14, 7
WEEKLY_FROM, MONTHLY_FROM, HOLIDAYS_FROM, YEARLY_FROM = 14, 60, 90, 365
TOO_SHORT = "Insufficient data for forecasting. Need at least 7 days of data."

def _by_day() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("ds")


def _all_days() -> WindowSpec:
    """The whole series. Ordered like the row-wise windows, so one sort serves
    them all."""
    return _by_day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)



# -- series ---------------------------------------------------------------------

def daily_sales(items: DataFrame, transactions: DataFrame, grain: str = "product",
                products: DataFrame | None = None) -> DataFrame:
    """``(series_id, ds, y)``: quantity sold per series and day with a sale.

    Lines are summed per product and day before the category is looked up.
    """
    days = transactions.select("transaction_id", F.to_date("transaction_date").alias("ds"))
    per_product = (
        items.select("transaction_id", "product_id", "quantity").join(days, "transaction_id")
        .groupBy("product_id", "ds").agg(F.sum("quantity").alias("y"))
    )
    if grain == "product":
        return per_product.select(F.col("product_id").cast("string").alias("series_id"), "ds", "y")
    if grain == "category":
        named = per_product.join(products.select("product_id", "category"), "product_id")
        label = F.col("category")
    elif grain == "total":
        named, label = per_product, F.lit("total")
    else:
        raise ValueError(f"unknown grain {grain!r}")
    return named.groupBy(label.alias("series_id"), "ds").agg(F.sum("y").alias("y"))


def fill_days(daily: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every day from ``start`` to ``end`` for every series, 0 where none sold.

    Each row brings the empty days up to the next one, so the grid is made in
    place after one shuffle of the days with sales; no calendar is joined.
    """
    daily = daily.withColumn("_start", start)
    start, first = F.col("_start"), F.row_number().over(_by_day()) == 1
    until = F.coalesce(F.date_sub(F.lead("ds").over(_by_day()), 1), end)
    return (
        daily.where(F.col("ds").between(start, end))
        .select("series_id", "y", F.col("ds").alias("sold_on"),
                F.when(first, start).otherwise(F.col("ds")).alias("since"), until.alias("until"))
        .select("series_id", F.explode(F.sequence("since", "until")).alias("ds"), "sold_on", "y")
        .select("series_id", "ds",
                F.when(F.col("ds") == F.col("sold_on"), F.col("y")).otherwise(0).cast("double").alias("y"))
    )


def daily_demand(items: DataFrame, transactions: DataFrame, as_of, days_back: int = 365,
                 grain: str = "product", products: DataFrame | None = None,
                 product_id: int | None = None) -> DataFrame:
    """Daily quantity of the last ``days_back`` days on a full grid of days for
    every series sold in them."""
    since = days_before(as_of, days_back)
    if product_id is not None:
        items = items.where(F.col("product_id") == product_id)
    recent = transactions.where(F.col("transaction_date") >= since)
    sales = daily_sales(items, recent, grain, products)
    return fill_days(sales, F.to_date(since), F.to_date(timestamp(as_of)))


def daily_demand_since_start(items: DataFrame, transactions: DataFrame, as_of, grain: str = "product",
                             products: DataFrame | None = None,
                             product_id: int | None = None) -> DataFrame:
    """Daily quantity from the first transaction of the whole table to ``as_of``."""
    start = transactions.agg(F.to_date(F.min("transaction_date"))).scalar()
    if product_id is not None:
        items = items.where(F.col("product_id") == product_id)
    sales = daily_sales(items, transactions, grain, products)
    return fill_days(sales, start, F.to_date(timestamp(as_of)))


def condition_series(series: DataFrame, clip_outliers: bool = True) -> DataFrame:
    """Zero days become a tenth of the smallest positive value (0.1 if there is
    none), then values are clipped to 1.5 interquartile ranges around the
    quartiles. A series that is mostly zero becomes nearly constant."""
    smallest = F.coalesce(F.min(F.when(F.col("y") > 0, F.col("y"))).over(_all_days()), F.lit(1.0))
    lifted = series.where(F.col("y").isNotNull()).withColumn(
        "y", F.when(F.col("y") == 0, smallest * 0.1).otherwise(F.col("y")))
    if not clip_outliers:
        return lifted
    q1 = F.percentile("y", F.lit(0.25)).over(_all_days())
    q3 = F.percentile("y", F.lit(0.75)).over(_all_days())
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return lifted.withColumns({"q1": q1, "q3": q3}).withColumn(
        "y", clip(F.col("y"), F.col("q1") - reach, F.col("q3") + reach)).drop("q1", "q3")


def train_test_split(series: DataFrame) -> DataFrame:
    """``part``: the first 80 % of a series' days train, the rest test.

    With fewer than 14 training days the last 7 days test if there are more than
    7. A series under 7 days is ``short`` and cannot be forecast.
    """
    n = F.count(F.lit(1)).over(_all_days())
    train = F.floor(F.col("n") * 0.8)
    train = F.when(train >= SHORT_TRAIN, train).when(
        F.col("n") > SHORT_TEST, F.col("n") - SHORT_TEST).otherwise(F.col("n"))
    part = F.when(F.col("n") < MIN_DAYS, "short").when(
        F.row_number().over(_by_day()) <= train, "train").otherwise("test")
    return series.where(F.col("y").isNotNull()).withColumn("n", n).withColumn("part", part).drop("n")


def _with_future(parts: DataFrame, periods: int) -> DataFrame:
    """Adds ``periods`` days after the last day of each series that is not short."""
    last = F.lead("ds").over(_by_day()).isNull()
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(periods)),
        lambda step: F.struct(F.date_add("ds", step).alias("ds"), F.lit(None).cast("double").alias("y"),
                              F.lit("future").alias("part")))
    own = F.array(F.struct("ds", "y", "part"))
    rows = F.when(F.col("_last") & (F.col("part") != "short"), F.concat(own, ahead)).otherwise(own)
    return parts.withColumn("_last", last).select("series_id", F.inline(rows))


# -- closed-form model ------------------------------------------------------------

@dataclass(frozen=True)
class Seasons:
    """From how many training days each effect is estimated; None for never."""

    weekly: int | None = WEEKLY_FROM
    yearly: int | None = YEARLY_FROM
    monthly: int | None = MONTHLY_FROM


def _fit(rows: DataFrame, mode: str, seasons: Seasons, interval: float) -> DataFrame:
    """Trend line, seasonal indices, forecast and bounds from the rows whose part
    is ``train``. One index after the other takes what the earlier ones leave."""
    product = mode == "multiplicative"
    neutral = F.lit(1.0 if product else 0.0)
    is_train = F.col("part") == "train"
    t = F.datediff("ds", F.col("_start")).cast("double")
    train = lambda c: F.when(is_train, c)
    line = rows.withColumn("_start", F.min("ds").over(_all_days())).withColumn("_t", t)
    line = line.withColumns({
        "_n": F.count(train(F.lit(1))).over(_all_days()),
        "_slope": F.regr_slope(train(F.col("y")), train(F.col("_t"))).over(_all_days()),
        "_level": F.regr_intercept(train(F.col("y")), train(F.col("_t"))).over(_all_days()),
        "_mean": F.avg(train(F.col("y"))).over(_all_days()),
    })
    trend = F.coalesce(F.col("_level") + F.col("_slope") * F.col("_t"), F.col("_mean"))
    line = line.withColumn("trend", F.greatest(trend, F.lit(1e-9)) if product else trend)
    without = (lambda a, b: F.try_divide(a, b)) if product else (lambda a, b: a - b)
    line = line.withColumn("_left", without(F.col("y"), F.col("trend")))

    def index(frame: DataFrame, name: str, slot: Column, from_days: int | None) -> DataFrame:
        if from_days is None:
            return frame.withColumn(name, neutral)
        mean = F.avg(train(F.col("_left"))).over(Window.partitionBy("series_id", "_slot"))
        value = F.when(F.col("_n") >= from_days, F.coalesce(mean, neutral)).otherwise(neutral)
        return (frame.withColumn("_slot", slot).withColumn(name, value).drop("_slot")
                .withColumn("_left", without(F.col("_left"), F.col(name))))

    line = index(line, "weekly", F.dayofweek("ds"), seasons.weekly)
    line = index(line, "yearly", F.month("ds"), seasons.yearly)
    line = index(line, "monthly", F.dayofmonth("ds"), seasons.monthly)
    combined = (F.col("trend") * F.col("weekly") * F.col("yearly") * F.col("monthly") if product
                else F.col("trend") + F.col("weekly") + F.col("yearly") + F.col("monthly"))
    gate = lambda days: (F.col("_n") >= days) if days is not None else F.lit(False)
    z = normal_quantile(0.5 + interval / 2)
    spread = F.coalesce(F.stddev_samp(train(F.col("y") - F.col("yhat"))).over(_all_days()), F.lit(0.0)) * z
    return (
        line.withColumn("yhat", combined).withColumn("_spread", spread)
        .select("series_id", "ds", "part", "y", "trend", "weekly", "yearly", "monthly", "yhat",
                (F.col("yhat") - F.col("_spread")).alias("yhat_lower"),
                (F.col("yhat") + F.col("_spread")).alias("yhat_upper"),
                F.filter(F.array(
                    F.when(gate(seasons.weekly), "weekly"), F.when(gate(seasons.yearly), "yearly"),
                    F.when(gate(seasons.monthly), "monthly")), lambda s: s.isNotNull()).alias("seasons"))
    )


_MODEL = ["trend", "weekly", "yearly", "monthly", "yhat", "yhat_lower", "yhat_upper"]


def seasonal_trend_forecast(series: DataFrame, periods: int = 30, interval: float = 0.95,
                            clip_outliers: bool = True) -> DataFrame:
    """Multiplicative forecast of every series over training, test and future days.

    Trend is a straight line by least squares; weekday, month and day-of-month
    indices are means of what the trend leaves, used when the training part is
    long enough. Bounds are the normal interval of the training residuals. Short
    series keep their rows, without a forecast.
    """
    rows = _with_future(train_test_split(condition_series(series, clip_outliers)), periods)
    fitted = _fit(rows, "multiplicative", Seasons(), interval)
    hidden = F.col("part") == "short"
    return fitted.withColumns({c: F.when(~hidden, F.col(c)) for c in _MODEL})


def forecast_additive(series: DataFrame, periods: int = 30, interval: float = 0.8) -> DataFrame:
    """The plain model: additive, weekly and yearly effects always on, trained on
    the whole series. Series with under two days or no sales at all are left out."""
    usable = series.withColumns({
        "_days": F.count(F.lit(1)).over(_all_days()), "_sold": F.sum("y").over(_all_days())})
    rows = usable.where((F.col("_days") >= 2) & (F.col("_sold") != 0)).select(
        "series_id", "ds", "y", F.lit("train").alias("part"))
    return _fit(_with_future(rows, periods), "additive", Seasons(1, 1, None), interval)


def forecast_view(forecast: DataFrame, as_of) -> DataFrame:
    """Forecast rows marked as history (up to ``as_of``) or forecast."""
    today = F.to_date(timestamp(as_of))
    return forecast.select(
        "series_id", "ds", "yhat", "yhat_lower", "yhat_upper", "trend", "part",
        F.when(F.col("ds") <= today, "Historical").otherwise("Forecast").alias("view"))


# -- accuracy -----------------------------------------------------------------------

def _metrics(error: Column, actual: Column) -> dict[str, Column]:
    return {
        "mae": F.avg(F.abs(error)),
        "mape": F.avg(F.abs(F.try_divide(error, actual))) * 100,
        "rmse": F.sqrt(F.avg(error * error)),
    }


def forecast_accuracy(forecast: DataFrame) -> DataFrame:
    """MAE, MAPE (percent), RMSE and R² per series on its test days.

    Null with fewer than three of them; a short series says so in ``error``.
    """
    tested = F.col("part") == "test"
    actual = F.when(tested, F.col("y"))
    error = F.when(tested, F.col("y") - F.col("yhat"))
    measures = _metrics(error, actual)
    missed, spread = F.sum(error * error), F.var_pop(actual) * F.count(actual)
    # Equal test values: 1 for a perfect forecast of them, otherwise 0.
    measures["r2"] = F.when(spread > 0, 1 - missed / spread).when(missed < 1e-18, 1.0).otherwise(0.0)
    enough = F.count(actual) >= 3
    return forecast.groupBy("series_id").agg(
        F.count(actual).alias("test_days"),
        *[F.when(enough, value).alias(name) for name, value in measures.items()],
        F.max(F.when(F.col("part") == "short", TOO_SHORT)).alias("error"))


def forecast_error_table(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """Forecast rows beside the actual values, with error, absolute error and
    percentage error (null where the actual value is 0)."""
    error = F.col("y") - F.col("yhat")
    return (
        forecast.select("series_id", "ds", "yhat", "yhat_lower", "yhat_upper")
        .join(actual.select("series_id", "ds", "y"), ["series_id", "ds"], "left")
        .withColumn("error", error)
        .withColumn("absolute_error", F.abs("error"))
        .withColumn("percentage_error", F.try_divide(F.col("error"), F.col("y")) * 100)
    )


def forecast_error_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("series_id").agg(
        *[value.alias(name) for name, value in _metrics(F.col("error"), F.col("y")).items()])


# -- patterns and advice ----------------------------------------------------------

def seasonal_patterns(forecast: DataFrame) -> DataFrame:
    """``(series_id, pattern, position, label, value)``: the yearly effect per
    month, the weekly one per weekday from Sunday, the monthly one per day."""
    slot = lambda name, position, label: F.struct(
        F.lit(name).alias("pattern"), position.alias("position"), label.alias("label"),
        F.col(name).alias("value"))
    slots = F.array(
        slot("yearly", F.month("ds"), F.date_format("ds", "MMMM")),
        slot("weekly", F.dayofweek("ds"), F.date_format("ds", "EEEE")),
        slot("monthly", F.dayofmonth("ds"), F.dayofmonth("ds").cast("string")))
    return (
        forecast.where(F.col("part") != "short").select("series_id", "seasons", F.inline(slots))
        .where(F.array_contains("seasons", F.col("pattern")))
        .groupBy("series_id", "pattern", "position", "label").agg(F.avg("value").alias("value"))
    )


def forecast_advice(forecast: DataFrame) -> DataFrame:
    """``(series_id, advice)``: what trend, weekly pattern and error suggest.

    The trend is the ratio of its last to its first value. Series with nothing to
    advise have no row.
    """
    tested = F.col("part") == "test"
    error = F.when(tested, F.abs(F.try_divide(F.col("y") - F.col("yhat"), F.col("y"))))
    weekdays = [F.max(F.when(F.dayofweek("ds") == day, F.col("weekly"))) for day in range(1, 8)]
    summary = forecast.where(F.col("part") != "short").groupBy("series_id").agg(
        F.try_divide(F.max_by("trend", "ds"), F.min_by("trend", "ds")).alias("change"),
        F.filter(F.array(*weekdays), lambda v: v.isNotNull()).alias("week"),
        F.when(F.count(error) >= 3, F.avg(error) * 100).alias("mape"))
    return advice_of(summary)


def advice_of(summary: DataFrame) -> DataFrame:
    """``summary`` (series_id, change, week, mape) -> ``(series_id, advice)``; ``week`` holds
    the weekdays' effects."""
    size = F.size("week")
    mean = F.aggregate("week", F.lit(0.0), lambda s, v: s + v) / size
    spread = F.aggregate("week", F.lit(0.0), lambda s, v: s + (v - F.col("week_mean")) * (v - F.col("week_mean")))
    # Thresholds and texts.
    advice = F.array(
        F.when(F.col("change") > 1.1, "Consider increasing inventory levels")
        .when(F.col("change") < 0.9, "Consider reducing inventory levels"),
        F.when(F.col("week_std") > 0.5, "Implement dynamic pricing based on weekly patterns"),
        F.when(F.col("mape") > 20, "Review and adjust forecasting model parameters"))
    return (
        summary.withColumn("week_mean", mean)
        .withColumn("week_std", F.sqrt(F.try_divide(spread, size - 1)))
        .select("series_id", F.explode(F.filter(advice, lambda a: a.isNotNull())).alias("advice"))
    )


# -- Fourier model ------------------------------------------------------------------

# Fourier orders and periods of the three seasonal effects, the number of
# bends and the scales of the priors.
_WAVES = (("yearly", 365.25, 10, YEARLY_FROM), ("weekly", 7.0, 3, WEEKLY_FROM),
          ("monthly", 30.5, 5, MONTHLY_FROM))
_CHANGEPOINTS, _CHANGEPOINT_PRIOR, _SEASON_PRIOR, _LINE_PRIOR = 25, 0.05, 10.0, 5.0
#: Rounds of fitting trend and seasons in turn, and proximal steps in each.
_ROUNDS, _STEPS = 400, 100


def _holidays(days: pd.Series) -> np.ndarray:
    found = USFederalHolidayCalendar().holidays(days.min(), days.max())
    return np.isin(days.to_numpy(), found.to_numpy()).astype(float)


def _sparse_fit(gram: np.ndarray, moment: np.ndarray, price: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The weights that minimise ``w gram w / 2 - moment w + price |w|``: accelerated
    proximal steps, then an exact solution for the signs they end with, if that is better."""
    size = np.sqrt(np.diag(gram))
    a, b, c, now = gram / np.outer(size, size), moment / size, price / size, start * size
    step, ahead, speed = 1 / np.linalg.eigvalsh(a)[-1], now, 1.0
    for _ in range(_STEPS):
        moved = ahead - step * (a @ ahead - b)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * c, 0)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, now, speed = new + (speed - 1) / faster * (new - now), new, faster
    # Exact for the signs found; a weight that would change its sign is let go.
    signs, some, exact = np.sign(now), (now != 0) | (price == 0), np.zeros_like(now)
    while True:
        exact[:] = 0
        exact[some] = np.linalg.solve(a[np.ix_(some, some)], b[some] - c[some] * signs[some])
        wrong = some & (price > 0) & (np.sign(exact) != signs)
        if not wrong.any():
            break
        some &= ~wrong
    cost = lambda w: w @ (a @ w) / 2 - b @ w + c @ np.abs(w)
    return min(exact, now, key=cost) / size


def _fourier_fit(frame: pd.DataFrame, z: float) -> pd.DataFrame:
    """One series: a trend with bends, times one plus seasonal waves and holidays."""
    frame = frame.sort_values("ds")
    days = pd.to_datetime(frame["ds"])
    t = (days - days.iloc[0]).dt.days.to_numpy(float)
    train = (frame["part"] == "train").to_numpy()
    n, span = int(train.sum()), max(t[train].max(), 1.0)
    bends = np.linspace(0, 0.8 * span, min(_CHANGEPOINTS, max(n // 3, 1)) + 1)[1:]
    line = np.column_stack([np.ones_like(t), t / span, *[np.maximum(t - b, 0) / span for b in bends]])
    waves = [f(2 * np.pi * k * t / period) for _, period, order, since in _WAVES if n >= since
             for k in range(1, order + 1) for f in (np.sin, np.cos)]
    if n >= HOLIDAYS_FROM:
        waves.append(_holidays(days))
    waves = np.column_stack(waves) if waves else np.zeros((len(t), 0))
    scale = max(np.abs(frame["y"].to_numpy(float)[train]).max(), 1e-9)
    y = frame["y"].to_numpy(float)[train] / scale

    bent, effect = np.zeros(line.shape[1]), np.zeros(waves.shape[1])
    noise, fitted = max(float(np.var(y)), 1e-10), np.full(len(y), np.inf)
    for _ in range(_ROUNDS):
        factor = 1 + waves @ effect
        a = line[train] * factor[train, None]
        ridge = np.r_[1.0, 1.0, np.zeros(len(bends))] * noise / _LINE_PRIOR ** 2
        price = np.r_[0.0, 0.0, np.full(len(bends), noise / _CHANGEPOINT_PRIOR)]
        bent = _sparse_fit(a.T @ a + np.diag(ridge + 1e-10), a.T @ y, price, bent)
        trend = line @ bent
        b = waves[train] * trend[train, None]
        effect = np.linalg.solve(b.T @ b + np.eye(b.shape[1]) * (noise / _SEASON_PRIOR ** 2 + 1e-12), b.T @ (y - trend[train]))
        before, fitted = fitted, trend[train] + b @ effect
        noise = max(float(np.mean((y - fitted) ** 2)), 1e-10)
        if np.abs(fitted - before).max() < 1e-9:
            break
    factor = 1 + waves @ effect
    # Beyond the training days the trend may go on bending as often and as much as in them.
    beyond, usual = np.maximum(t / span - 1, 0), np.abs(bent[2:]).mean()
    drift = 2 * len(bends) * usual ** 2 * beyond ** 3 / 3
    yhat, spread = trend * factor, z * np.sqrt(noise + factor ** 2 * drift)
    return frame.assign(trend=trend * scale, yhat=yhat * scale, yhat_lower=(yhat - spread) * scale,
                        yhat_upper=(yhat + spread) * scale)


def fourier_trend_forecast(series: DataFrame, periods: int = 30, interval: float = 0.95) -> DataFrame:
    """Forecast with a bending trend, multiplied by Fourier seasons and US holidays.

    The published model of Taylor and Letham (2018): few bends under a Laplace prior, wide
    normal priors on the rest, its most likely parameters found by fitting trend and seasons
    in turn. Bounds hold the noise and, beyond the training days, the variance of a trend
    that goes on bending; both in closed form, nothing is drawn. One call per series, which
    holds one row per day.
    """
    z = normal_quantile(0.5 + interval / 2)
    rows = _with_future(train_test_split(condition_series(series)), periods).where("part != 'short'")
    return rows.groupBy("series_id").applyInPandas(
        lambda frame: _fourier_fit(frame, z),
        "series_id string, ds date, y double, part string, trend double, yhat double, "
        "yhat_lower double, yhat_upper double")


def fourier_normal_equations(forecast: DataFrame) -> DataFrame:
    """Per series the training, test and future days, and ``residual``: the largest
    correlation that training residuals have with anything the model could still use, the
    line or a wave, each as it enters the forecast. 0 for the most likely parameters, but
    for their priors, and where the residuals are no more than rounding. Computed from the
    forecast's rows alone.
    """
    t = F.datediff("ds", F.min("ds").over(_all_days())).cast("double")
    train = F.count_if(F.col("part") == "train").over(_all_days())
    rows = forecast.withColumns({"t": t, "n": train, "factor": F.try_divide("yhat", "trend"), "error": F.col("y") - F.col("yhat")})
    terms = {"level": F.col("factor"), "slope": F.col("factor") * F.col("t")}
    for name, period, order, since in _WAVES:
        for k in range(1, order + 1):
            for wave in (F.sin, F.cos):
                value = F.col("trend") * wave(F.col("t") * (2 * pi * k / period))
                terms[f"{name}_{k}_{wave.__name__}"] = F.when(F.col("n") >= since, value)
    rows = rows.withColumns(terms)
    is_train = lambda value: F.when(F.col("part") == "train", value)
    total = lambda value: F.sum(is_train(value))
    error = F.col("error")
    part = lambda name: F.count_if(F.col("part") == name).alias(f"{name}_days")
    alike = [F.coalesce(F.try_divide(F.abs(total(F.col(c) * error)), F.sqrt(total(F.col(c) * F.col(c)) * total(error * error))), F.lit(0.0))
             for c in terms]
    exact = total(error * error) <= 1e-18 * total(F.col("y") * F.col("y"))
    return rows.groupBy("series_id").agg(
        part("train"), part("test"), part("future"), F.when(exact, 0.0).otherwise(F.greatest(*alike)).alias("residual"))
