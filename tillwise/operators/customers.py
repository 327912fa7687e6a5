"""Customer scoring: recency, frequency, monetary value, and what follows."""

from __future__ import annotations

from decimal import Decimal
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import (
    days_before, elapsed_days, exact, exact_avg, exact_sum, half_even, percent_of, timestamp,
)
from ..plans.durable import written_once
from ..plans.quantiles import exact_quantiles, quartile_score

RFM = ["recency", "frequency", "monetary"]
QUARTILES = [0.25, 0.5, 0.75]
# Recency given to a customer who never bought.
NEVER_BOUGHT_DAYS = 365


def rfm_metrics(transactions: DataFrame, as_of, days_back: int = 365) -> DataFrame:
    """Recency, frequency and monetary value of the customers who bought in the
    last ``days_back`` days. ``transaction_id`` is the table's key, so counting
    rows counts distinct transactions and needs one shuffle only."""
    return (
        transactions
        .where(F.col("transaction_date") >= days_before(as_of, days_back))
        .where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count("transaction_id").alias("frequency"),
             exact_sum("total_amount").alias("monetary"),
             F.max("transaction_date").alias("last_purchase"))
        .withColumn("recency", elapsed_days(timestamp(as_of), F.col("last_purchase")))
        .drop("last_purchase")
    )


def _with_scores(rfm: DataFrame, r: str, f: str, m: str, *, keep_few: bool) -> DataFrame:
    """Quartile scores 1-4; the most recent buyers score 4."""
    quartiles = exact_quantiles(rfm, RFM, QUARTILES).select(F.struct("*").alias("edges"))
    edges = F.col("_edges")

    def score(metric: str, descending: bool = False) -> Column:
        few = edges[f"{metric}_few"] if keep_few else F.lit(False)
        return quartile_score(F.col(metric), edges[f"{metric}_q"], few, descending=descending)

    return (
        rfm.withColumn("_edges", quartiles.scalar())
        .withColumns({r: score("recency", True), f: score("frequency"), m: score("monetary")})
        .drop("_edges")
    )


def rfm_codes(rfm: DataFrame) -> DataFrame:
    """Segments from the three-digit score code.

    Customers who have not bought for long (``r_score`` 1) are the lost ones.
    """
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    code = F.concat(r.cast("string"), f.cast("string"), m.cast("string"))
    # Codes of the best customers, and segment names.
    best = ["444", "434", "443", "433"]
    return (
        _with_scores(rfm, "r_score", "f_score", "m_score", keep_few=False)
        .withColumn("rfm_score", code)
        .withColumn(
            "segment",
            F.when(F.col("rfm_score").isin(best), "Best Customers")
            .when(r == 1, "Lost Customers")
            .when((f == 4) & (m == 4), "Loyal Customers")
            .when(m == 4, "Big Spenders")
            .when(f == 4, "Regular Customers")
            .otherwise("Average Customers"))
    )


def _share(count: str = "count") -> Column:
    """Percent of the total of ``count``. It is used on summaries with one row
    per segment, so the window spans a handful of rows."""
    return percent_of(F.col(count), F.sum(count).over(Window.partitionBy()))


def code_summary(coded: DataFrame) -> DataFrame:
    """Means, size and share of the code-based segments."""
    summary = coded.groupBy("segment").agg(
        half_even(F.avg("recency")).alias("avg_recency"),
        half_even(F.avg("frequency")).alias("avg_frequency"),
        half_even(exact_avg("monetary")).alias("avg_monetary"),
        F.count("customer_id").alias("count"))
    return summary.withColumn("percentage", _share())


def _spread(metric: str, rounded: bool) -> list[Column]:
    mean = exact_avg(metric) if metric == "monetary" else F.avg(metric)
    shape = (lambda c: half_even(c.cast("double"))) if rounded else (lambda c: c)
    return [shape(mean).alias(f"{metric}_mean"), shape(F.min(metric)).alias(f"{metric}_min"),
            shape(F.max(metric)).alias(f"{metric}_max")]


def segment_profile(coded: DataFrame) -> DataFrame:
    """Mean, smallest and largest metric of each code-based segment, unrounded."""
    spreads = [column for metric in RFM for column in _spread(metric, rounded=False)]
    profile = coded.groupBy("segment").agg(*spreads, F.count("customer_id").alias("customer_id_count"))
    return profile.withColumn("percentage", _share("customer_id_count"))


def segment_label(r: Column, f: Column, m: Column) -> Column:
    # Segment names.
    return (
        F.when((r == 4) & (f == 4) & (m == 4), "Best Customers")
        .when((f == 4) & (m == 4), "Loyal Customers")
        .when(m == 4, "Big Spenders")
        .when(r == 1, "Lost Customers")
        .when(r == 4, "Recent Customers")
        .otherwise("Average Customers")
    )


def customer_rfm(customers: DataFrame, transactions: DataFrame, as_of) -> DataFrame:
    """Scores and segment of every customer over all time.

    Transactions are reduced to one row per customer before they meet the
    customer table. A metric with fewer than four distinct values scores 2.
    """
    bought = (
        transactions.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count("transaction_id").alias("frequency"),
             exact_sum("total_amount").alias("monetary"),
             F.max("transaction_date").alias("last_purchase"))
    )
    rfm = (
        customers.select("customer_id", "first_name", "last_name")
        .join(bought, "customer_id", "left")
        .withColumns({
            "frequency": F.coalesce("frequency", F.lit(0).cast("long")),
            "monetary": F.coalesce("monetary", F.lit(0.0)),
            "recency": F.coalesce(elapsed_days(timestamp(as_of), F.col("last_purchase")),
                                  F.lit(NEVER_BOUGHT_DAYS)),
        })
    )
    r, f, m = F.col("R"), F.col("F"), F.col("M")
    return (
        _with_scores(rfm, "R", "F", "M", keep_few=True)
        .withColumn("RFM_Score", F.concat(r.cast("string"), f.cast("string"), m.cast("string")))
        .withColumn("Segment", segment_label(r, f, m))
    )


def segment_summary(scored: DataFrame) -> DataFrame:
    """Size, means, total value and share of each segment."""
    summary = scored.groupBy("Segment").agg(
        F.count("customer_id").alias("count"),
        half_even(F.avg("recency")).alias("avg_recency"),
        half_even(F.avg("frequency")).alias("avg_frequency"),
        half_even(exact_avg("monetary")).alias("avg_monetary"),
        half_even(exact_sum("monetary")).alias("total_monetary"))
    return summary.withColumn("percentage", _share())


def segment_stats(scored: DataFrame) -> DataFrame:
    """Mean, smallest and largest metric of each segment, rounded."""
    return scored.groupBy("Segment").agg(
        *[column for metric in RFM for column in _spread(metric, rounded=True)])


# Advised actions per segment name.
ACTIONS: dict[str, list[str]] = {
    "Lost Customers": [
        "Re-engagement campaigns",
        "Special win-back offers",
        "Personalized communication",
    ],
    "At Risk Customers": [
        "Loyalty program incentives",
        "Targeted promotions",
        "Customer feedback surveys",
    ],
    "Regular Customers": [
        "Cross-selling opportunities",
        "Upselling campaigns",
        "Referral program",
    ],
    "Loyal Customers": [
        "VIP treatment",
        "Exclusive offers",
        "Early access to new products",
    ],
    "Champions": [
        "Brand ambassador program",
        "Premium loyalty rewards",
        "Co-creation opportunities",
    ],
}


def action_table(spark: SparkSession) -> DataFrame:
    rows = [(segment, number, action) for segment, actions in ACTIONS.items()
            for number, action in enumerate(actions, start=1)]
    return spark.createDataFrame(rows, "Segment string, action_no int, action string")


def segment_actions(segments: DataFrame) -> DataFrame:
    """Advised actions of the segments present; null where none are given."""
    actions = F.broadcast(action_table(segments.sparkSession))
    return segments.select("Segment").distinct().join(actions, "Segment", "left")


def customer_metrics(transactions: DataFrame) -> DataFrame:
    """Count, total and mean of each customer's transactions."""
    return (
        transactions.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
        .agg(F.count("transaction_id").alias("transaction_count"),
             exact_sum("total_amount").alias("total_spent"),
             exact_avg("total_amount").alias("average_transaction"))
    )


def customer_summary(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every customer with number and sum of transactions (null when none)."""
    bought = transactions.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count("transaction_id").alias("total_transactions"),
        exact_sum("total_amount").alias("total_spent"))
    return (
        customers.select("customer_id", "first_name", "last_name", "email", "phone")
        .join(bought, "customer_id", "left")
        .withColumn("total_transactions", F.coalesce("total_transactions", F.lit(0).cast("long")))
    )


#: Customers, about, among whom centres are found first; and most rounds of moving the
#: centres and the move, in standard deviations, that ends them, among those and among all.
KMEANS_SAMPLE = 2048
KMEANS_FIRST, KMEANS_ALL = (300, 1e-3), (40, 1e-2)


def _scales(points: DataFrame) -> tuple[int, list[float], list[float]]:
    """The number of rows, means and sample standard deviations (to 6 digits) from exact sums."""
    whole = F.struct(F.count("*").alias("n"), *[F.sum(c).alias(f"{c}_sum") for c in RFM], *[
        F.sum((F.col(c) * F.col(c)).cast("decimal(38,8)")).alias(f"{c}_squares") for c in RFM])
    row = points.agg(whole.alias("w")).first()["w"]
    n = row["n"]
    if not n:
        return 0, [], []
    spread = [n * Decimal(row[f"{c}_squares"]) - Decimal(row[f"{c}_sum"]) ** 2 for c in RFM]
    return (n, [float(row[f"{c}_sum"]) / n for c in RFM],
            [round(sqrt(float(x) / (n * max(n - 1, 1))), 6) or 1.0 for x in spread])


def _distances(centres: list[list[float]], scale: list[float]) -> Column:
    """Squared distances to the centres, in standard deviations."""
    part = "(cast({0} as double) - {1!r}D) / {2!r}D * ((cast({0} as double) - {1!r}D) / {2!r}D)"
    return F.expr("array({})".format(", ".join(
        " + ".join(part.format(*x) for x in zip(RFM, centre, scale)) for centre in centres)))


def _nearest(centres: list[list[float]], scale: list[float]) -> Column:
    distances = _distances(centres, scale)
    return F.array_position(distances, F.array_min(distances)) - 1


def _settled(centres: list[list[float]], scale: list[float], limits: tuple[int, float], means) -> list[list[float]]:
    """Centres after moving to their customers' ``means`` until they move no more to speak of."""
    rounds, least = limits
    for _ in range(rounds):
        before, centres = centres, means(centres)
        if len(before) == len(centres) and all(
                sum(((x - y) / s) ** 2 for x, y, s in zip(a, b, scale)) <= least ** 2 for a, b in zip(before, centres)):
            break
    return centres


def _sample_centres(sample: np.ndarray, mean: list[float], scale: list[float], k: int) -> list[list[float]]:
    """Centres among a few customers, whose rows are in order of their ids."""
    def apart(centres: list[list[float]]) -> np.ndarray:
        parts = ((sample[:, None, :] - np.array(centres)) / scale) ** 2
        return parts[..., 0] + parts[..., 1] + parts[..., 2]

    centres = [mean]
    while len(centres) < k and len(sample):
        far = apart(centres).min(1)
        if far.max() == 0:
            break
        centres.append(sample[far.argmax()].tolist())
    whole = np.rint(sample * 10_000).astype(np.int64)  # exact sums, as among all

    def means(centres: list[list[float]]) -> list[list[float]]:
        near = apart(centres).argmin(1)
        return [(whole[near == j].sum(0) / 10_000 / (near == j).sum()).tolist() for j in range(len(centres)) if (near == j).any()]

    return _settled(centres, scale, KMEANS_FIRST, means) if len(sample) else centres


def customer_kmeans(rfm: DataFrame, k: int = 4) -> DataFrame:
    """K-means clusters on standardised recency, frequency and monetary value.

    Centres are first found among some 2,000 customers, drawn by a hash of their id: the mean
    of all, then whoever is farthest from the centres so far, the smallest id among equals;
    then they move to the means of their customers until they settle. The same follows among
    all customers, one job a round, and few rounds are left to do. A centre without customers
    is given up, so there are no more clusters than different customers.

    Sums are exact: the clusters depend on the rows, not on how they are spread. Clusters are
    numbered by their centres, the most recent buyers first. Runs jobs when called; the sample
    and a row per cluster are collected.
    """
    points = written_once(rfm.select("customer_id", F.col("recency").cast("decimal(18,4)").alias("recency"),
                                     F.col("frequency").cast("decimal(18,4)").alias("frequency"),
                                     exact("monetary").alias("monetary")), "points")
    n, mean, scale = _scales(points)
    if not n:
        return rfm.withColumn("cluster", F.lit(0))
    draw = F.conv(F.substring(F.md5(F.col("customer_id").cast("string")), 1, 13), 16, 10).cast("long") / F.lit(2.0 ** 52)
    sample = points.where(draw * n < KMEANS_SAMPLE).select("customer_id", *[F.col(c).cast("double").alias(c) for c in RFM])
    sample = np.array([tuple(r)[1:] for r in sorted(sample.collect())], float).reshape(-1, len(RFM))

    def means(centres: list[list[float]]) -> list[list[float]]:
        found = points.groupBy(_nearest(centres, scale).alias("cluster")).agg(
            F.count("*").alias("n"), *[F.sum(c).alias(c) for c in RFM]).collect()
        return [[float(r[c]) / r["n"] for c in RFM] for r in sorted(found, key=lambda r: r["cluster"])]

    centres = _settled(_sample_centres(sample, mean, scale, k), scale, KMEANS_ALL, means)
    return rfm.withColumn("cluster", _nearest(sorted(centres), scale).cast("int"))


def kmeans_summary(clustered: DataFrame) -> DataFrame:
    """One row: customers, clusters, how many customers are nearer to the mean of
    another cluster than to their own's by over 2 % of a standard deviation, the largest
    distance between means computed in two ways, and the mean recency and frequency."""
    scale = clustered.agg(*[F.stddev_samp(c).alias(f"{c}_s") for c in RFM])
    shared = clustered.crossJoin(F.broadcast(scale)).select("cluster", "recency", "frequency", *[
        F.try_divide(F.col(c).cast("double"), F.col(f"{c}_s")).alias(f"{c}_z") for c in RFM])
    z = [f"{c}_z" for c in RFM]
    means = shared.groupBy("cluster").agg(*[F.avg(c).alias(f"{c}_m") for c in z], *[
        (F.sum(c) / F.count(c)).alias(f"{c}_n") for c in z])
    all_means = F.broadcast(means.agg(F.collect_list(F.struct("*")).alias("means")))
    apart = lambda m: F.sqrt(sum(((F.col(c) - m[f"{c}_m"]) * (F.col(c) - m[f"{c}_m"]) for c in z), F.lit(0.0)))
    error = lambda m: sum((F.abs(m[f"{c}_m"] - m[f"{c}_n"]) for c in z), F.lit(0.0))
    own = F.array_min(F.transform(F.filter("means", lambda m: m["cluster"] == F.col("cluster")), apart))
    best = F.array_min(F.transform("means", apart))
    return shared.crossJoin(all_means).select(
        "cluster", "recency", "frequency", (own > best + 0.02).alias("off"),
        F.array_max(F.transform("means", error)).alias("error")).agg(
        F.count(F.lit(1)).alias("customers"), F.countDistinct("cluster").alias("clusters"),
        F.count_if("off").alias("nearer_to_another"), F.round(F.max("error"), 6).alias("centre_error"),
        F.round(F.avg("recency"), 6).alias("mean_recency"), F.round(F.avg("frequency"), 6).alias("mean_frequency"))


def customer_value(transactions: DataFrame, as_of) -> DataFrame:
    """Lifetime value: average order value x orders per year x expected years.

    A customer's years run from the first purchase to ``as_of`` (one day at
    least); the expected years are the mean over all customers.
    """
    per_customer = (
        transactions.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
        .agg(F.count("transaction_id").alias("orders"),
             exact_avg("total_amount").alias("average_order_value"),
             F.min("transaction_date").alias("first_purchase"))
        .withColumn("days", F.greatest(elapsed_days(timestamp(as_of), F.col("first_purchase")), F.lit(1)))
    )
    mean_days = per_customer.agg(F.avg("days")).scalar()
    per_year = F.col("orders") * 365.0 / F.col("days")
    return per_customer.select(
        "customer_id", "average_order_value",
        per_year.alias("orders_per_year"),
        (F.col("average_order_value") * per_year * (mean_days / 365.0)).alias("lifetime_value"))
