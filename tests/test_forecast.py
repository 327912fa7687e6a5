from datetime import date, datetime, timedelta
from math import sin

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.operators import forecast as f
from tillwise.operators import series_models as m

SERIES = "series_id string, ds date, y double"
DAY0 = date(2023, 1, 1)  # a Sunday


def _frame(spark, **series):
    return spark.createDataFrame(
        [(name, DAY0 + timedelta(days=i), None if y is None else float(y))
         for name, values in series.items() for i, y in enumerate(values)], SERIES)


def _wave(n):
    return [10 + 3 * sin(i) for i in range(n)]


# -- series ------------------------------------------------------------------------

@pytest.fixture
def sold(spark):
    tx = spark.createDataFrame([
        (1, datetime(2024, 6, 27, 9)), (2, datetime(2024, 6, 27, 20)), (3, datetime(2024, 6, 30)),
        (4, datetime(2024, 6, 1))], "transaction_id long, transaction_date timestamp_ntz")
    items = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 2, 4), (4, 3, 9)],
                                  "transaction_id long, product_id long, quantity int")
    products = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "product_id long, category string")
    return items, tx, products


def test_grid_of_every_product_and_day(sold, rows):
    items, tx, _ = sold
    got = rows(f.daily_demand(items, tx, "2024-06-30", days_back=4).withColumn("d", F.dayofmonth("ds")), "series_id", "d", "y")
    assert got == [("1", 26, 0.0), ("1", 27, 5.0), ("1", 28, 0.0), ("1", 29, 0.0), ("1", 30, 0.0),
                   ("2", 26, 0.0), ("2", 27, 0.0), ("2", 28, 0.0), ("2", 29, 0.0), ("2", 30, 4.0)]
    one = f.daily_demand(items, tx, "2024-06-30", days_back=4, product_id=2)
    assert rows(one, "series_id", "y") == [("2", 0.0)] * 4 + [("2", 4.0)]


def test_grid_since_the_first_transaction_of_all(sold):
    items, tx, products = sold
    by_category = f.daily_demand_since_start(items, tx, "2024-06-30", "category", products).toPandas()
    assert by_category.groupby("series_id").size().to_dict() == {"x": 30, "y": 30}
    assert by_category.groupby("series_id")["y"].sum().to_dict() == {"x": 9.0, "y": 9.0}
    total = f.daily_demand_since_start(items, tx, "2024-06-30", "total").toPandas()
    assert len(total) == 30 and total["y"].sum() == 18
    with pytest.raises(ValueError):
        f.daily_sales(items, tx, "week")


def test_conditioning(spark):
    values = [0, 4, 5, 6, 5, 4, 6, 5, 500]
    got = f.condition_series(_frame(spark, a=values, zero=[0] * 8)).toPandas()
    a = got[got.series_id == "a"].sort_values("ds")["y"].to_numpy()
    lifted = pd.Series([0.4, *values[1:]], dtype=float)
    q1, q3 = lifted.quantile(0.25), lifted.quantile(0.75)
    assert a == pytest.approx(lifted.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)).to_numpy())
    assert set(got[got.series_id == "zero"]["y"]) == {0.1}
    kept = f.condition_series(_frame(spark, a=values), clip_outliers=False).toPandas()
    assert kept["y"].max() == 500


@pytest.mark.parametrize("n,train", [(6, 0), (7, 7), (13, 6), (14, 7), (17, 10), (18, 14), (60, 48), (365, 292)])
def test_split_lengths(spark, n, train):
    parts = f.train_test_split(_frame(spark, s=_wave(n))).toPandas().sort_values("ds")["part"].tolist()
    if n < 7:
        assert set(parts) == {"short"}
    else:
        assert parts == ["train"] * train + ["test"] * (n - train)


def test_split_drops_missing_days(spark):
    assert f.train_test_split(_frame(spark, s=[1, None, *_wave(8)])).count() == 9


# -- closed-form model -----------------------------------------------------------------

WEEK = [0.7, 1.0, 1.1, 1.2, 1.3, 0.9, 0.8]  # from Sunday


def test_line_times_weekdays_is_recovered(spark):
    """A flat line with weekday factors: the forecast must continue it."""
    values = [100 * WEEK[i % 7] for i in range(70)]
    got = f.seasonal_trend_forecast(_frame(spark, s=values), periods=14).toPandas().sort_values("ds")
    assert got["part"].tolist() == ["train"] * 56 + ["test"] * 14 + ["future"] * 14
    expected = [100 * WEEK[i % 7] for i in range(84)]
    assert got["yhat"].to_numpy() == pytest.approx(expected, rel=0.02)
    assert (got["yhat_lower"] <= got["yhat"]).all() and (got["yhat"] <= got["yhat_upper"]).all()
    assert got["ds"].iloc[-1] == DAY0 + timedelta(days=83)
    weekly = {r["position"]: (r["label"], r["value"]) for r in f.seasonal_patterns(
        f.seasonal_trend_forecast(_frame(spark, s=values))).where("pattern = 'weekly'").collect()}
    assert weekly[1][0] == "Sunday" and weekly[7][0] == "Saturday"
    assert [weekly[d][1] for d in range(1, 8)] == pytest.approx(WEEK, rel=0.02)


def test_effects_depend_on_the_training_length(spark):
    lengths = {"d7": 7, "d20": 20, "d70": 70, "d80": 80, "d500": 500}
    got = f.seasonal_trend_forecast(_frame(spark, short=_wave(6), **{k: _wave(n) for k, n in lengths.items()}))
    seasons = {r["series_id"]: r["seasons"] for r in got.select("series_id", "seasons").distinct().collect()}
    assert seasons == {"short": [], "d7": [], "d20": ["weekly"], "d70": ["weekly"],
                       "d80": ["weekly", "monthly"], "d500": ["weekly", "yearly", "monthly"]}
    short = got.where("series_id = 'short'").toPandas()
    assert len(short) == 6 and short["yhat"].isna().all()


def test_accuracy_and_error_rows(spark):
    forecast = f.seasonal_trend_forecast(_frame(spark, short=_wave(6), seven=_wave(7), a=_wave(100)), 5)
    got = {r["series_id"]: r for r in f.forecast_accuracy(forecast).collect()}
    assert got["short"]["error"] == f.TOO_SHORT and got["short"]["mae"] is None
    assert got["seven"]["error"] is None and got["seven"]["mae"] is None and got["seven"]["test_days"] == 0
    frame = forecast.where("series_id = 'a' and part = 'test'").toPandas()
    error = frame["y"] - frame["yhat"]
    assert got["a"]["mae"] == pytest.approx(error.abs().mean())
    assert got["a"]["rmse"] == pytest.approx(np.sqrt((error ** 2).mean()))
    assert got["a"]["mape"] == pytest.approx((error / frame["y"]).abs().mean() * 100)
    assert got["a"]["r2"] == pytest.approx(1 - (error ** 2).sum() / ((frame["y"] - frame["y"].mean()) ** 2).sum())


def test_constant_series(spark):
    forecast = f.seasonal_trend_forecast(_frame(spark, z=[0] * 60), 5)
    row = f.forecast_accuracy(forecast).first()
    assert row["mae"] == pytest.approx(0, abs=1e-9) and row["r2"] == 1.0


def test_error_table(spark):
    forecast = spark.createDataFrame([("s", DAY0, 4.0, 1.0, 6.0), ("s", DAY0 + timedelta(days=1), 1.0, 0.0, 2.0),
                                      ("s", DAY0 + timedelta(days=9), 1.0, 0.0, 2.0)],
                                     "series_id string, ds date, yhat double, yhat_lower double, yhat_upper double")
    table = f.forecast_error_table(forecast, _frame(spark, s=[5, 0]))
    got = [tuple(r) for r in table.orderBy("ds").select("error", "absolute_error", "percentage_error").collect()]
    assert got == [(1.0, 1.0, 20.0), (-1.0, 1.0, None), (None, None, None)]
    summary = f.forecast_error_summary(table).first()
    assert (summary["mae"], summary["mape"], summary["rmse"]) == (1.0, 20.0, 1.0)


def test_additive_continues_a_line(spark):
    values = [50 + 2 * i + (5 if i % 7 == 0 else 0) for i in range(730)]
    frame = _frame(spark, s=values, empty=[0, 0, 0], single=[4])
    got = f.forecast_additive(frame, periods=7).toPandas().sort_values("ds")
    assert set(got["series_id"]) == {"s"}
    assert got["part"].tolist() == ["train"] * 730 + ["future"] * 7
    expected = [50 + 2 * i + (5 if i % 7 == 0 else 0) for i in range(737)]
    assert np.abs(got["yhat"].to_numpy() - expected).max() < 15  # month means bend a steep line a little


def test_advice(spark):
    rising = [10 + 0.5 * i for i in range(70)]
    falling = [60 - 0.5 * i for i in range(70)]
    swing = [100 * (3.0 if i % 7 < 2 else 0.2) for i in range(70)]
    got = {}
    for r in f.forecast_advice(f.seasonal_trend_forecast(
            _frame(spark, up=rising, down=falling, week=swing, flat=[5] * 70, short=_wave(6)))).collect():
        got.setdefault(r["series_id"], []).append(r["advice"])
    assert "Consider increasing inventory levels" in got["up"]
    assert "Consider reducing inventory levels" in got["down"]
    assert "Implement dynamic pricing based on weekly patterns" in got["week"]
    assert "flat" not in got and "short" not in got


def test_view(spark):
    forecast = f.seasonal_trend_forecast(_frame(spark, s=_wave(30)), 3)
    views = f.forecast_view(forecast, "2023-01-30").groupBy("view").count().collect()
    assert {r["view"]: r["count"] for r in views} == {"Historical": 30, "Forecast": 3}


# -- models of many series -----------------------------------------------------------------

def _sold(spark, n, **series):
    """Days with sales only, and the same as a full grid."""
    sales = [(name, DAY0 + timedelta(days=d), None if y is None else float(y)) for name, found in series.items() for d, y in found.items()]
    grid = [(name, DAY0 + timedelta(days=d), 0.0 if d not in found else None if found[d] is None else float(found[d]))
            for name, found in series.items() for d in range(n)]
    return spark.createDataFrame(sales, SERIES), spark.createDataFrame(grid, SERIES)


def _sparse(seed, n, share):
    draw = np.random.default_rng(seed)
    return {int(d): int(draw.integers(1, 9)) for d in range(n) if draw.random() < share}


@pytest.mark.parametrize("n,clip", [(30, True), (120, False), (120, True), (800, False), (800, True)])
def test_models_say_what_the_grid_says(spark, n, clip):
    """Sparse series: one model row each, against the forecast over every day."""
    sales, grid = _sold(spark, n, rare=_sparse(1, n, 0.02) | {3: 2}, often=_sparse(2, n, 0.7), late={n - 1: 5},
                        all=_sparse(3, n, 1.1), gaps={0: None, 1: 4, 5: None, 9: 2, n - 1: None}, minus={2: -3, 8: 4, 9: 0})
    end = F.lit(DAY0 + timedelta(days=n - 1))
    models = m.series_models(sales, F.lit(DAY0), end, periods=20, clip_outliers=clip)
    forecast = f.seasonal_trend_forecast(grid, 20, clip_outliers=clip)

    def same(a, b, *keys):
        a, b = (x.toPandas().sort_values(list(keys)).reset_index(drop=True) for x in (a, b.select(*a.columns)))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-6, atol=1e-6)

    same(m.model_accuracy(models), f.forecast_accuracy(forecast), "series_id")
    same(m.model_forecast(models, 20), forecast.where("part = 'future'"), "series_id", "ds")
    same(m.model_advice(models), f.forecast_advice(forecast), "series_id", "advice")
    same(m.model_patterns(models), f.seasonal_patterns(forecast), "series_id", "pattern", "position")


def test_models_of_short_and_no_series(spark):
    sales, _ = _sold(spark, 6, a={0: 1, 5: 2})
    models = m.series_models(sales, F.lit(DAY0), F.lit(DAY0 + timedelta(days=5)))
    assert [tuple(r) for r in m.model_accuracy(models).collect()] == [("a", 0, None, None, None, None, f.TOO_SHORT)]
    assert m.model_forecast(models).count() == m.model_patterns(models).count() == m.model_advice(models).count() == 0
    assert m.series_models(sales.where("false"), F.lit(DAY0), F.lit(DAY0)).count() == 0
    # Sales outside the days asked for are left out.
    assert m.series_models(sales, F.lit(DAY0 + timedelta(days=1)), F.lit(DAY0 + timedelta(days=4))).count() == 0


# -- Fourier model ----------------------------------------------------------------------

def _planted(n, noise, seed=0):
    """A line that bends once, times a week and a year."""
    t = np.arange(n)
    trend = np.where(t < 300, 100 + 0.1 * t, 130 + 0.5 * (t - 300))
    season = 1 + 0.3 * np.sin(2 * np.pi * t / 7) + 0.2 * np.cos(2 * np.pi * t / 365.25)
    return trend, season, trend * season * (1 + noise * np.random.default_rng(seed).normal(size=n))


def test_fourier_recovers_a_multiplicative_series(spark):
    trend, season, y = _planted(800, 0.01)
    got = f.fourier_trend_forecast(_frame(spark, s=y.tolist()), 20).toPandas().sort_values("ds").iloc[:800]
    train = (got["part"] == "train").to_numpy()
    error = np.abs(got["yhat"].to_numpy() / (trend * season) - 1)
    assert error[train].mean() < 0.01 and error[~train].mean() < 0.02
    # The swing grows with the trend, which an additive model cannot do.
    found = (got["yhat"] / got["trend"]).to_numpy()
    assert np.corrcoef(found, season)[0, 1] > 0.995
    assert np.ptp(got["yhat"].to_numpy()[-14:]) > 1.5 * np.ptp(got["yhat"].to_numpy()[:14])


def test_fourier_bends_are_few(spark):
    """The Laplace prior leaves most of the 25 bends at exactly 0, all but those beside the
    planted one."""
    _, _, y = _planted(800, 0.05)
    got = f.fourier_trend_forecast(_frame(spark, s=y.tolist()), 1).toPandas().sort_values("ds")
    slopes = np.diff(got["trend"].to_numpy()[:600])
    bends = np.flatnonzero(np.abs(np.diff(slopes)) > 1e-9 * np.abs(slopes).max())
    assert len(bends) and np.abs(bends - 299).max() < 30


def test_fourier_bounds_widen_beyond_the_training_days(spark):
    _, _, y = _planted(500, 0.02)
    got = f.fourier_trend_forecast(_frame(spark, s=y.tolist()), 60).toPandas().sort_values("ds")
    width = (got["yhat_upper"] - got["yhat_lower"]).to_numpy()
    train = (got["part"] == "train").to_numpy()
    assert np.ptp(width[train]) < 1e-6 * width[0] and width[-1] > width[train][0] * 1.05
    assert (np.diff(width[~train]).mean()) > 0


def test_fourier_leaves_nothing_it_could_use(spark):
    _, _, y = _planted(700, 0.05)
    forecast = f.fourier_trend_forecast(_frame(spark, s=y.tolist(), flat=[5] * 80, short=_wave(6)), 10)
    got = {r["series_id"]: r for r in f.fourier_normal_equations(forecast).collect()}
    assert set(got) == {"s", "flat"} and (got["s"]["train_days"], got["s"]["test_days"], got["s"]["future_days"]) == (560, 140, 10)
    assert got["s"]["residual"] < 1e-4
    wrong = forecast.withColumn("yhat", F.col("yhat") * (1 + 0.02 * F.sin(F.dayofweek("ds") * 0.9)))
    assert f.fourier_normal_equations(wrong).where("series_id = 's'").first()["residual"] > 0.05


def test_sparse_fit_is_optimal():
    """Against the conditions of its minimum."""
    draw = np.random.default_rng(4)
    a = draw.normal(size=(60, 12)).cumsum(0)
    y = a[:, :3] @ [1, -2, 0.5] + draw.normal(size=60)
    price = np.r_[0, 0, np.full(10, 8.0)]
    w = np.zeros(12)
    for _ in range(30):
        w = f._sparse_fit(a.T @ a, a.T @ y, price, w)
    slope = a.T @ (a @ w - y)
    on = w != 0
    assert 0 < (~on).sum()
    assert slope[on] == pytest.approx(-price[on] * np.sign(w[on]), abs=1e-6) and (np.abs(slope[~on]) <= price[~on] + 1e-6).all()


def test_fourier_follows_trend_and_week(spark):
    values = [(100 + 0.2 * i) * WEEK[i % 7] for i in range(400)]
    got = f.fourier_trend_forecast(_frame(spark, s=values, short=_wave(6)), 14).toPandas().sort_values("ds")
    assert set(got["series_id"]) == {"s"} and len(got) == 414
    expected = np.array([(100 + 0.2 * i) * WEEK[i % 7] for i in range(414)])
    tested = (got["part"] != "train").to_numpy()
    assert np.abs(got["yhat"].to_numpy() - expected)[tested].mean() < 12
    assert (got["yhat_lower"] < got["yhat_upper"]).all()
