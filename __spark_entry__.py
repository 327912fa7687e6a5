
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle_queries import (
    ALL_DAYS, AS_OF, CATEGORY_RULES, INSIGHT, KPI_DAYS, ORACLES, PERIODS, PRODUCT_ID, RULES, STOCK_AS_OF,
    STORE_ID, VALUE_MODELS,
)
from tillwise.operators import customers as c
from tillwise.operators import daily_kpis as d
from tillwise.operators import forecast as f
from tillwise.operators import inventory as i
from tillwise.operators import loading as l
from tillwise.operators import recommend as r
from tillwise.operators import sales as s
from tillwise.operators import series_models as m
from tillwise.operators import value_model as v
from tillwise.plans.durable import new_path, written_once
from tillwise.sources.keyed import read_keyed
from tillwise.sources.tables import RetailTables

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Doubles that differ in their last bits between engines, made comparable."""
    return df.withColumns({name: F.round(name, digits) for name in columns})


# -- customers ---------------------------------------------------------------

def _rfm(t: RetailTables) -> DataFrame:
    return c.rfm_metrics(t.transaction_headers, AS_OF)


def _scored(t: RetailTables) -> DataFrame:
    return c.customer_rfm(t.customers, t.transaction_headers, AS_OF)


def _loaded_twice(spark: SparkSession, load: Callable, *tables: DataFrame) -> DataFrame:
    path = new_path(spark, "loaded")
    load(*tables, path)
    load(*tables, path)
    return spark.read.parquet(path)


def _loaded_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers loaded by key in two overlapping loads, and once more."""
    sales, path = RetailTables(spark, sf_dir).transaction_headers, new_path(spark, "keyed")
    for some in (sales.where("pmod(customer_id, 3) < 2"), sales.where("pmod(customer_id, 3) > 0"), sales):
        l.load_customer_metrics_keyed(some, path)
    return read_keyed(spark, path)


def _kpis_of_days(spark: SparkSession, t: RetailTables) -> DataFrame:
    """Days stored in three loads, one of them twice."""
    path = new_path(spark, "days")
    for first, last in (("1990-01-01", "2001-05-31"), ("2001-06-01", "2001-07-31"), ("2001-06-01", "2001-07-31"), (AS_OF, AS_OF)):
        d.store_months(t.transaction_headers, t.items, path, first, last)
    return _rounded(d.stored_kpis(spark, path, t.inventory, AS_OF, KPI_DAYS), 6, "value", "previous", "change")


def _history(t: RetailTables) -> DataFrame:
    return v.purchase_history(t.transaction_headers, AS_OF)


def _value_model(t: RetailTables) -> DataFrame:
    """A year ahead, by the model fitted to all customers."""
    history = written_once(_history(t), "history")
    return v.customer_value_model(history, v.fit_value_model(history))


CUSTOMERS = {
    "rfm_metrics": _rfm,
    "rfm_codes": lambda t: c.rfm_codes(_rfm(t)),
    "rfm_code_summary": lambda t: c.code_summary(c.rfm_codes(_rfm(t))),
    "segment_profile": lambda t: c.segment_profile(c.rfm_codes(_rfm(t))),
    "customer_rfm": _scored,
    "segment_summary": lambda t: c.segment_summary(_scored(t)),
    "segment_stats": lambda t: c.segment_stats(_scored(t)),
    "segment_actions": lambda t: c.segment_actions(_scored(t)),
    "customer_metrics": lambda t: c.customer_metrics(t.transaction_headers),
    "customer_summary": lambda t: c.customer_summary(t.customers, t.transaction_headers),
    "customer_kmeans": lambda t: c.customer_kmeans(_rfm(t)),
    "kmeans_summary": lambda t: c.kmeans_summary(c.customer_kmeans(_rfm(t))),
    "customer_value": lambda t: c.customer_value(t.transaction_headers, AS_OF),
    "purchase_history": _history,
    "customer_value_likelihood": lambda t: _rounded(
        v.log_likelihoods(v.history_counts(_history(t)), VALUE_MODELS), 4, "log_likelihood"),
    "customer_value_model": _value_model,
}

# -- sales and loading ----------------------------------------------------------

def _extracted(t: RetailTables) -> DataFrame:
    return s.extract_transactions(t.transactions, t.customers, t.stores, t.staff, None, AS_OF)


SALES = {
    "extract_transactions": _extracted,
    "calendar_features": lambda t: s.calendar_features(_extracted(t)),
    "transaction_lines": lambda t: s.transaction_lines(t.transactions, t.items),
    "product_catalog": lambda t: s.product_catalog(t.products),
    "product_list": lambda t: s.product_list(t.products),
    "daily_sales_trend": lambda t: s.daily_sales_trend(t.transaction_headers),
    "kpis": lambda t: _rounded(s.kpis(t.transaction_headers, t.items, t.inventory, AS_OF, KPI_DAYS),
                               6, "value", "previous", "change"),
    "store_performance": lambda t: _rounded(
        s.store_performance(t.transactions, t.stores, None, AS_OF), 6, "performance"),
    **{f"bundle_{name}": (lambda t, name=name: l.extract_bundle(t, STOCK_AS_OF)[name])
       for name in ("transaction_data", "inventory_data", "product_data", "customer_data")},
    "table_probe": lambda t: l.has_rows({"transactions": t.transactions, "items": t.items, "products": t.products,
                                         "none": t.products.where("product_id is null")}),
    "extract_bundle": lambda t: l.bundle_sizes(l.extract_bundle(t, STOCK_AS_OF)),
}

# -- inventory --------------------------------------------------------------------

def _metrics(t: RetailTables) -> DataFrame:
    return i.inventory_metrics(t.inventory, t.products)


def _classified(t: RetailTables) -> DataFrame:
    return i.inventory_abc(t.inventory, t.products)


def _optimized(t: RetailTables, basis: str = "line") -> DataFrame:
    sales = i.sales_history(t.items, t.transaction_headers, AS_OF)
    stock = i.extract_inventory(t.inventory, t.products)
    return i.optimize_inventory(stock, sales, demand_basis=basis)


def _transformed(t: RetailTables) -> DataFrame:
    return i.transform_inventory(i.extract_inventory(t.inventory, t.products), STOCK_AS_OF)


def _snapshot(t: RetailTables) -> DataFrame:
    return i.inventory_snapshot(t.inventory, t.products, STOCK_AS_OF)


_LEVELS = ("eoq", "safety_stock", "reorder_point")

INVENTORY = {
    "inventory_metrics": _metrics,
    "inventory_metrics_of_store": lambda t: i.inventory_metrics(t.inventory, t.products, store_id=STORE_ID),
    "abc_analysis": lambda t: _rounded(i.abc_analysis(_metrics(t)), 8, "cumulative_percentage"),
    "optimize_inventory": lambda t: _rounded(_optimized(t), 6, *_LEVELS),
    "optimize_inventory_by_day": lambda t: _rounded(_optimized(t, "calendar_day"), 6, *_LEVELS),
    "inventory_abc": _classified,
    "abc_summary": lambda t: i.abc_summary(_classified(t)),
    "sales_history": lambda t: i.sales_history(t.items, t.transaction_headers, AS_OF),
    "inventory_actions": lambda t: _rounded(
        i.inventory_actions(_optimized(t)), 6, "recommended_quantity", "reorder_point"),
    "extract_inventory": lambda t: i.extract_inventory(t.inventory, t.products),
    "transform_inventory": _transformed,
    "inventory_snapshot": _snapshot,
    "stock_by_category": lambda t: i.stock_by_category(i.stock_values(t.inventory, t.products)),
    "inventory_kpis": lambda t: i.inventory_kpis(i.stock_values(t.inventory, t.products)),
    "low_stock_alerts": lambda t: i.low_stock_alerts(_snapshot(t)),
    "product_metrics": lambda t: _rounded(l.product_metrics(_transformed(t)), 6, "turnover_rate"),
}

# -- recommendations ------------------------------------------------------------------

def _baskets(t: RetailTables, days: int | None = 90) -> DataFrame:
    return r.basket_lines(t.items, t.transaction_headers, t.products, AS_OF, days)


def _pair_rules(t: RetailTables) -> DataFrame:
    return r.pair_rules(_baskets(t, ALL_DAYS), **RULES)


def _category_rules(t: RetailTables) -> DataFrame:
    return r.association_rules(_baskets(t, ALL_DAYS), item="category", **CATEGORY_RULES)


def _category_scores(t: RetailTables) -> DataFrame:
    """Two categories that never meet correlate below 0, which may be above the threshold."""
    return r.category_correlation(_baskets(t, ALL_DAYS), full=INSIGHT["min_score"] < 0)


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.array_join(name, "|") for name in columns})


_RULE_MEASURES = ("support", "confidence", "lift")

RECOMMEND = {
    "basket_lines": _baskets,
    "pair_rules": lambda t: _rounded(_pair_rules(t), 8, *_RULE_MEASURES),
    "association_rules": lambda t: _rounded(
        _joined(_category_rules(t), "antecedents", "consequents"), 8,
        "antecedent_support", "consequent_support", *_RULE_MEASURES),
    "product_name_rules": lambda t: _rounded(
        _joined(r.association_rules(_baskets(t, ALL_DAYS), **RULES), "antecedents", "consequents"), 8,
        "antecedent_support", "consequent_support", *_RULE_MEASURES),
    "rule_edges": lambda t: _rounded(r.rule_edges(_category_rules(t)), 8, "value"),
    "item_cosine": lambda t: _rounded(r.item_cosine(_baskets(t)), 8, "score"),
    "similar_products": lambda t: _rounded(r.similar_products(_baskets(t)), 8, "score"),
    "similar_to": lambda t: _rounded(r.similar_to(_baskets(t), PRODUCT_ID), 8, "score"),
    "category_correlation": lambda t: _rounded(r.category_correlation(_baskets(t)), 8, "score"),
    "category_correlation_full": lambda t: _rounded(r.category_correlation(_baskets(t), full=True), 8, "score"),
    "product_lookup": lambda t: r.product_lookup(t.products, PRODUCT_ID),
    "bought_together": lambda t: r.bought_together(
        t.items, t.transaction_headers, t.products, PRODUCT_ID, AS_OF),
    "bought_together_all": lambda t: r.bought_together_all(t.items, t.transaction_headers, t.products, AS_OF),
    "shared_customers": lambda t: r.shared_customers(t.items, t.transaction_headers, t.products, PRODUCT_ID),
    "shared_customers_all": lambda t: r.shared_customers_all(t.items, t.transaction_headers, t.products),
    "category_performance": lambda t: r.category_performance(
        t.items, t.transaction_headers, t.products, AS_OF),
    "recommendation_insights": lambda t: r.recommendation_insights(
        _category_rules(t), _category_scores(t), **INSIGHT),
    "recommendation_strategies": lambda t: _rounded(r.recommendation_strategies(
        _category_rules(t), _category_scores(t), min_lift=INSIGHT["min_lift"],
        min_score=INSIGHT["min_score"]), 8, "score"),
}

# -- forecasts --------------------------------------------------------------------------

def _series(t: RetailTables) -> DataFrame:
    return f.daily_demand_since_start(t.items, t.transaction_headers, AS_OF, "category", t.products)


def _forecast(t: RetailTables) -> DataFrame:
    return f.seasonal_trend_forecast(_series(t), PERIODS)


_MODEL = ("y", "trend", "weekly", "yearly", "monthly", "yhat", "yhat_lower", "yhat_upper")
_ERRORS = ("error", "absolute_error", "percentage_error")
_BOUNDS = ("yhat", "yhat_lower", "yhat_upper")

FORECAST = {
    "daily_demand": lambda t: f.daily_demand(t.items, t.transaction_headers, AS_OF),
    "daily_demand_since_start": _series,
    "condition_series": lambda t: _rounded(f.condition_series(_series(t)), 6, "y"),
    "train_test_split": lambda t: _rounded(f.train_test_split(f.condition_series(_series(t))), 6, "y"),
    "seasonal_trend_forecast": lambda t: _rounded(_forecast(t).drop("seasons"), 4, *_MODEL),
    "fourier_trend_forecast": lambda t: f.fourier_trend_forecast(_series(t), PERIODS),
    "forecast_view": lambda t: _rounded(f.forecast_view(_forecast(t), AS_OF), 4, *_BOUNDS, "trend"),
    "forecast_additive": lambda t: _rounded(
        f.forecast_additive(_series(t), PERIODS).drop("seasons"), 4, *_MODEL),
    "forecast_accuracy": lambda t: _rounded(
        f.forecast_accuracy(_forecast(t)), 4, "mae", "mape", "rmse", "r2"),
    "forecast_error_table": lambda t: _rounded(
        f.forecast_error_table(_forecast(t), _series(t)), 4, *_BOUNDS, *_ERRORS),
    "forecast_error_summary": lambda t: _rounded(
        f.forecast_error_summary(f.forecast_error_table(_forecast(t), _series(t))), 4, "mae", "mape", "rmse"),
    "seasonal_patterns": lambda t: _rounded(f.seasonal_patterns(_forecast(t)), 6, "value"),
    "forecast_advice": lambda t: f.forecast_advice(_forecast(t)),
}


def _r2() -> Column:
    """Of a hopeless series R2 is so large that 4 decimals are beyond a double."""
    return F.when(F.abs("r2") > 1e6, F.round("r2", -4)).otherwise(F.round("r2", 4))


def _product_models(t: RetailTables) -> DataFrame:
    """Products sell on few days: clipping outliers would leave constants."""
    return m.demand_models(t.items, t.transaction_headers, AS_OF, periods=PERIODS, clip_outliers=False)


def _product_forecast(t: RetailTables, product_id: int) -> DataFrame:
    series = f.daily_demand_since_start(t.items, t.transaction_headers, AS_OF, product_id=product_id)
    return f.seasonal_trend_forecast(series, PERIODS, clip_outliers=False)


FORECAST |= {
    "daily_demand_product": lambda t: f.daily_demand_since_start(
        t.items, t.transaction_headers, AS_OF, product_id=PRODUCT_ID),
    "product_forecast": lambda t: _rounded(_product_forecast(t, PRODUCT_ID).drop("seasons"), 4, *_MODEL),
    "product_forecast_accuracy": lambda t: _rounded(
        m.model_accuracy(_product_models(t)), 4, "mae", "mape", "rmse").withColumn("r2", _r2()),
    "product_forecast_advice": lambda t: m.model_advice(_product_models(t)),
    "product_seasonal_patterns": lambda t: _rounded(m.model_patterns(_product_models(t)), 6, "value"),
    "product_future_forecast": lambda t: _rounded(
        m.model_forecast(_product_models(t), PERIODS), 4, *(c for c in _MODEL if c != "y")),
    "fourier_normal_equations": lambda t: _rounded(
        f.fourier_normal_equations(f.fourier_trend_forecast(_series(t), PERIODS)), 4, "residual"),
}

_BY_TABLES = {**CUSTOMERS, **SALES, **INVENTORY, **RECOMMEND, **FORECAST}


def _days_as_timestamps(df: DataFrame) -> DataFrame:
    """Engines hand plain dates to Python differently; timestamps agree."""
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name, kind in df.dtypes if kind == "date"})


def _over_tables(job: Callable[[RetailTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: _days_as_timestamps(job(RetailTables(spark, sf_dir)))


def _corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries over text corpora with their SQL, where those modules are there."""
    try:
        from tillwise.llm.queries import ORACLES as sql, QUERIES as found
        import corpus_pipeline
    except ModuleNotFoundError as error:
        if (error.name or "").startswith(("tillwise.llm", "corpus_pipeline")):
            return {}, {}
        raise
    sql = dict(sql)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**found, "pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Query]:
    """One entry per operator; each takes (spark, sf_dir) and returns a frame. Most are
    lazy; those that fit a model, mine itemsets or load a table run jobs when called."""
    found = {name: _over_tables(job) for name, job in _BY_TABLES.items()}
    found["kpis_of_days"] = lambda spark, sf_dir: _kpis_of_days(spark, RetailTables(spark, sf_dir))
    found["load_customer_metrics"] = lambda spark, sf_dir: _loaded_twice(
        spark, l.load_customer_metrics, RetailTables(spark, sf_dir).transaction_headers)
    found["load_customer_metrics_keyed"] = _loaded_in_parts
    found["load_product_metrics"] = lambda spark, sf_dir: _rounded(_loaded_twice(
        spark, l.load_product_metrics, _transformed(RetailTables(spark, sf_dir))), 6, "turnover_rate")
    return {**found, **_corpus()[0]}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every query that SQL can express exactly."""
    return {**ORACLES, **_corpus()[1]}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the customer segments of the smallest data set."""
    return queries()["segment_summary"](spark, "/root/testdata/sf0.001")
