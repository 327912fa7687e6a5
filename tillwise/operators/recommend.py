"""Baskets: association rules, similar products, shared baskets and customers."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.scalars import days_before, exact
from ..plans.dealing import tasks_for
from ..plans.durable import written_once
from ..plans.pairs import item_pairs, mirrored, partners_of
from ..plans.partners import best_partners


def _recent(transactions: DataFrame, as_of, days_back: int | None, *columns: str) -> DataFrame:
    """Transactions of the last ``days_back`` days; of all time if that is None."""
    if days_back is not None:
        transactions = transactions.where(F.col("transaction_date") >= days_before(as_of, days_back))
    return transactions.select("transaction_id", *columns)


def basket_lines(items: DataFrame, transactions: DataFrame, products: DataFrame, as_of,
                 days_back: int | None = 90) -> DataFrame:
    """Lines of the recent transactions with product name and category.

    All of time is dealt by transaction to as many tasks as the rows need; they are
    counted when called. Products are joined before, so that what goes on by transaction
    stays in these tasks, however many products there are."""
    lines, recent = items.select("transaction_id", "product_id"), _recent(transactions, as_of, days_back)
    described = products.select("product_id", F.col("name").alias("product_name"), "category")
    if days_back is None:
        tasks = tasks_for(lines, recent)
        lines = lines.join(described, "product_id").repartition(tasks, "transaction_id")
        joined = lines.join(recent.repartition(tasks, "transaction_id"), "transaction_id")
    else:
        joined = lines.join(recent, "transaction_id").join(described, "product_id")
    return joined.select("transaction_id", "product_id", "product_name", "category")


# -- association rules -------------------------------------------------------

#: Support from which on the frequent items are sent to every task.
LEAST_SUPPORT = 1e-4


def _basket_items(baskets: DataFrame, item: str) -> DataFrame:
    return baskets.select(F.col("transaction_id").alias("basket"), F.col(item).alias("item")).distinct()


def _frequent(rows: DataFrame, n: Column, min_support: float) -> DataFrame:
    """``(item, support_count, n)`` of the frequent items. An itemset is frequent
    only if each of its items is, so the rest can go before anything is joined
    or gathered."""
    return (
        rows.groupBy("item").agg(F.count(F.lit(1)).alias("support_count"))
        .withColumn("n", n)
        .where(F.col("support_count") / F.col("n") >= min_support)
    )


def _only_frequent(rows: DataFrame, frequent: DataFrame, min_support: float) -> DataFrame:
    """Rows of the frequent items, left where they are. Of these there are at most (mean
    basket size / ``min_support``), few enough for every task unless that is tiny."""
    items = frequent.select("item")
    return rows.join(F.broadcast(items) if min_support >= LEAST_SUPPORT else items, "item", "left_semi")


def pair_rules(baskets: DataFrame, min_support: float = 0.01, min_confidence: float = 0.5,
               item: str = "product_name") -> DataFrame:
    """Association rules between two single items.

    Infrequent items are dropped first, which bounds a basket by the number of
    frequent items: at most the mean basket size over ``min_support``.
    """
    rows = _basket_items(baskets, item)
    frequent = _frequent(rows, rows.select(F.countDistinct("basket").alias("n")).scalar(), min_support)
    kept = _only_frequent(rows, frequent, min_support)
    both = mirrored(item_pairs(kept, "basket", "item").select("a", "b", "together"))
    support_of = lambda name: frequent.select(
        F.col("item").alias(name), F.col("support_count").alias(f"{name}_count"))
    n = F.col("n")
    return (
        both.join(frequent.select(F.col("item").alias("a"), F.col("support_count").alias("a_count"), "n"), "a")
        .join(support_of("b"), "b")
        .select(
            F.col("a").alias("antecedent"), F.col("b").alias("consequent"),
            (F.col("together") / n).alias("support"),
            (F.col("together") / F.col("a_count")).alias("confidence"),
            (F.col("together") * n / (F.col("a_count") * F.col("b_count"))).alias("lift"))
        .where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
    )


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.groupBy("basket").agg(F.collect_list("item").alias("items"))


def _with_partner(gathered: DataFrame, n: int, min_support: float) -> DataFrame:
    """``(item)`` of the frequent pairs; no other item is in an itemset of several. Pairs
    are counted in the tasks that hold the baskets, then their counts are shuffled."""
    later = F.filter("items", lambda other: F.col("a") < other)
    return (
        gathered.select("items", F.explode("items").alias("a")).select("a", F.explode(later).alias("b"))
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))
        .where(F.col("together") / F.lit(n) >= min_support)
        .select(F.explode(F.array("a", "b")).alias("item")).distinct()
    )


def _only_partners(gathered: DataFrame, partners: DataFrame, min_support: float) -> DataFrame:
    """Baskets of several items with a frequent partner, left where they are."""
    rows = gathered.select("basket", F.explode("items").alias("item"))
    return _gathered(_only_frequent(rows, partners, min_support)).where(F.size("items") > 1)


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.01,
                      item: str = "product_name") -> DataFrame:
    """``(items, freq, n)``: sorted itemsets in at least ``min_support`` of the
    baskets, found by distributed FP-growth.

    Only frequent items enter the gathered baskets, so a basket's array holds at
    most (mean basket size / ``min_support``) items. Only those of frequent pairs enter
    the trees, which are held on the heap: the others are itemsets of one. Mining runs
    when called; its result is written once, as the rules read it three times.
    """
    rows = _basket_items(baskets, item)
    n = rows.select(F.countDistinct("basket")).first()[0]
    frequent = _frequent(rows, F.lit(n), min_support)
    gathered = _gathered(_only_frequent(rows, frequent, min_support)).persist(StorageLevel.MEMORY_AND_DISK)
    kept = None
    try:
        found = gathered.select(F.explode("items").alias("item")).groupBy("item").agg(
            F.count(F.lit(1)).alias("freq")).select(F.array("item").alias("items"), "freq")
        gathered.count()
        partners = written_once(_with_partner(gathered, n, min_support), "partners")
        if not partners.isEmpty():
            kept = _only_partners(gathered, partners, min_support).select("items").persist(StorageLevel.MEMORY_AND_DISK)
            # Baskets without frequent pairs are gone, so the threshold is restated
            # against the rest, a hair low, and applied exactly afterwards.
            reduced = min(1.0, max(0.0, (min_support * n - 0.5) / kept.count()))
            mined = FPGrowth(itemsCol="items", minSupport=reduced, minConfidence=1.0).fit(kept).freqItemsets
            found = found.unionByName(
                mined.where(F.size("items") > 1).select(F.array_sort("items").alias("items"), "freq"))
        return written_once(
            found.select("items", "freq", F.lit(n).cast("long").alias("n"))
            .where(F.col("freq") / F.col("n") >= min_support))
    finally:
        gathered.unpersist()
        if kept is not None:
            kept.unpersist()


def association_rules(baskets: DataFrame, min_support: float = 0.01, min_confidence: float = 0.5,
                      item: str = "product_name") -> DataFrame:
    """Association rules with any number of items on both sides."""
    return rules_of_itemsets(frequent_itemsets(baskets, min_support, item), min_confidence)


def rules_of_itemsets(sets: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """The rules that split an itemset of ``sets`` (items in order, freq, n) in two parts
    which are among them too, with at least ``min_confidence``.

    Consequents grow by one item a round. Moving an item to the consequent can only lower
    the confidence, so a consequent is tried only if it is confident without its last item,
    and that item alone is. Rounds end with the longest confident consequent; work follows
    the rules there are, not the ways to split a set. Runs jobs when called.
    """
    support = lambda name: sets.select(F.col("items").alias(name), F.col("freq").alias(f"{name}_freq"))

    def confident(tried: DataFrame) -> DataFrame:
        known = tried.join(support("antecedents"), "antecedents")
        return known.where(F.col("freq") / F.col("antecedents_freq") >= min_confidence)

    single = sets.where(F.size("items") > 1).select("items", "freq", "n", F.explode("items").alias("last")).select(
        "items", "freq", "n", F.array_remove("items", F.col("last")).alias("antecedents"), F.array("last").alias("consequents"))
    single = written_once(confident(single), "rules")
    ends = single.groupBy("items").agg(F.flatten(F.collect_list("consequents")).alias("ends"))
    found, now = [single], single.where(F.size("antecedents") > 1).join(ends, "items")
    for _ in range(2, sets.agg(F.max(F.size("items"))).first()[0] or 0):
        later = F.filter("ends", lambda end: end > F.element_at("consequents", -1))
        grown = now.withColumn("last", F.explode(later)).select(
            "items", "freq", "n", "ends", F.array_remove("antecedents", F.col("last")).alias("antecedents"),
            F.array_append("consequents", F.col("last")).alias("consequents"))
        grown = written_once(confident(grown), "rules")
        if grown.isEmpty():
            break
        found.append(grown.drop("ends"))
        now = grown.where(F.size("antecedents") > 1).drop("antecedents_freq")
    return (
        reduce(DataFrame.unionByName, found).join(support("consequents"), "consequents")
        .select(
            "antecedents", "consequents",
            (F.col("antecedents_freq") / F.col("n")).alias("antecedent_support"),
            (F.col("consequents_freq") / F.col("n")).alias("consequent_support"),
            (F.col("freq") / F.col("n")).alias("support"),
            (F.col("freq") / F.col("antecedents_freq")).alias("confidence"),
            (F.col("freq") * F.col("n") / (F.col("antecedents_freq") * F.col("consequents_freq"))).alias("lift"))
    )


def rule_edges(rules: DataFrame) -> DataFrame:
    """One edge per antecedent item and consequent item, weighted by the lift."""
    return (
        rules.select(F.explode("antecedents").alias("source"), "consequents", "lift")
        .select("source", F.explode("consequents").alias("target"), F.col("lift").alias("value"))
    )


# -- similarity --------------------------------------------------------------

def _line_counts(baskets: DataFrame, item: str) -> DataFrame:
    return baskets.groupBy("transaction_id", item).agg(F.count(F.lit(1)).alias("lines"))


def item_cosine(baskets: DataFrame) -> DataFrame:
    """Cosine between the products' line counts per transaction, in both orders.

    Products that share no transaction have similarity 0 and no row.
    """
    counts = _line_counts(baskets, "product_id")
    norms = counts.groupBy("product_id").agg(F.sum(F.col("lines") * F.col("lines")).alias("squares"))
    norm = lambda name: norms.select(F.col("product_id").alias(name), F.col("squares").alias(f"{name}_squares"))
    pairs = item_pairs(counts, "transaction_id", "product_id", "lines")
    scored = pairs.join(norm("a"), "a").join(norm("b"), "b").select(
        "a", "b", (F.col("dot") / F.sqrt(F.col("a_squares").cast("double") * F.col("b_squares"))).alias("score"))
    return mirrored(scored)


def similar_products(baskets: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most similar other products of every product by ``item_cosine``, without
    a row for every pair."""
    return best_partners(_line_counts(baskets, "product_id"), "transaction_id", "product_id", n, "lines")


def similar_to(baskets: DataFrame, product_id: int, n: int = 5) -> DataFrame:
    """The ``n`` products most similar to one, without building any pairs."""
    counts = _line_counts(baskets, "product_id")
    anchor = counts.where(F.col("product_id") == product_id).select(
        "transaction_id", F.col("lines").alias("anchor_lines"))
    own = anchor.agg(F.sum(F.col("anchor_lines") * F.col("anchor_lines"))).scalar()
    scored = counts.join(anchor, "transaction_id", "left").groupBy("product_id").agg(
        F.sum(F.col("lines") * F.col("anchor_lines")).alias("dot"),
        F.sum(F.col("lines") * F.col("lines")).alias("squares"))
    return (
        scored.where(F.col("dot").isNotNull() & (F.col("product_id") != product_id))
        .select(F.lit(product_id).cast("long").alias("a"), F.col("product_id").alias("b"),
                (F.col("dot") / F.sqrt(own.cast("double") * F.col("squares"))).alias("score"))
        .orderBy(F.col("score").desc(), "b").limit(n)
    )


def category_correlation(baskets: DataFrame, full: bool = False) -> DataFrame:
    """Pearson correlation of the categories' line counts per transaction.

    Transactions without a category count as 0, which only enters through their
    number. Rows are the categories that meet in some transaction, in both orders,
    and the diagonal. Two that never meet have no row, their correlation being below
    0, unless the ``full`` matrix is asked for: every two categories are its rows.
    """
    counts = _line_counts(baskets, "category")
    baskets_seen = counts.select(F.countDistinct("transaction_id").cast("double").alias("n"))
    moments = counts.groupBy("category").agg(
        F.sum("lines").cast("double").alias("s"), F.sum(F.col("lines") * F.col("lines")).cast("double").alias("q"))
    side = lambda key: moments.select(
        F.col("category").alias(key), F.col("s").alias(f"s{key}"), F.col("q").alias(f"q{key}"))
    met = mirrored(item_pairs(counts, "transaction_id", "category", "lines").select("a", "b", "dot"))
    itself = moments.select(F.col("category").alias("a"), F.col("category").alias("b"), F.col("q").alias("dot"))
    met = met.unionByName(itself)
    if full:
        # Each left row goes to all join keys, each right row to one.
        keys = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left = moments.select(F.col("category").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(keys - 1))).alias("k"))
        right = moments.select(F.col("category").alias("b"), F.pmod(F.hash("category"), F.lit(keys)).alias("k"))
        met = left.join(right, "k").join(met, ["a", "b"], "left").select("a", "b", F.coalesce("dot", F.lit(0)).alias("dot"))
    n, dot = F.col("n"), F.col("dot")
    spread = lambda s, q: n * F.col(q) - F.col(s) * F.col(s)
    return (
        met.join(side("a"), "a").join(side("b"), "b")
        .withColumn("n", baskets_seen.scalar())
        .select("a", "b", F.try_divide(
            n * dot - F.col("sa") * F.col("sb"),
            F.sqrt(spread("sa", "qa") * spread("sb", "qb"))).alias("score"))
    )


# -- one product and its partners ----------------------------------------------

def product_lookup(products: DataFrame, product_id: int, strict: bool = False) -> DataFrame:
    """Name and category of a product. ``strict`` raises if it does not exist."""
    found = products.where(F.col("product_id") == product_id).select(
        "product_id", F.col("name").alias("product_name"), "category")
    if strict and found.isEmpty():
        raise ValueError(f"product {product_id} not found")
    return found


def _described(pairs: DataFrame, products: DataFrame, other: str, count: str) -> DataFrame:
    """Pairs ``(a, b, together)`` with names and categories of both products."""
    side = lambda key, prefix: products.select(
        F.col("product_id").alias(key), F.col("name").alias(f"{prefix}product_name"),
        F.col("category").alias(f"{prefix}category"))
    return pairs.join(side("a", ""), "a").join(side("b", f"{other}_"), "b").select(
        F.col("a").alias("product_id"), "product_name", "category",
        F.col("b").alias(f"{other}_product_id"), f"{other}_product_name",
        F.col(f"{other}_category"), F.col("together").alias(count))


def _together(rows: DataFrame, group: str, k: int) -> DataFrame:
    return best_partners(rows, group, "product_id", k).select("a", "b", F.col("score").cast("long").alias("together"))


def _best(partners: DataFrame, product_id: int, k: int) -> DataFrame:
    return (
        partners.select(F.lit(product_id).cast("long").alias("a"), F.col("product_id").alias("b"), "together")
        .orderBy(F.col("together").desc(), "b").limit(k)
    )


def _recent_rows(items: DataFrame, transactions: DataFrame, products: DataFrame, as_of, days_back: int):
    return (
        items.select("transaction_id", "product_id")
        .join(_recent(transactions, as_of, days_back), "transaction_id", "left_semi")
        .join(products.select("product_id"), "product_id", "left_semi").distinct()
    )


def bought_together(items: DataFrame, transactions: DataFrame, products: DataFrame, product_id: int,
                    as_of, k: int = 5, days_back: int = 90) -> DataFrame:
    """The ``k`` products sharing most recent transactions with one product.

    Only lines of the product's own transactions get past the first join."""
    own = items.where(F.col("product_id") == product_id).select("transaction_id").distinct()
    near = items.join(own, "transaction_id", "left_semi")
    rows = _recent_rows(near, transactions, products, as_of, days_back)
    best = _best(partners_of(rows, "transaction_id", "product_id", product_id), product_id, k)
    return _described(best, products, "related", "co_purchase_count")


def bought_together_all(items: DataFrame, transactions: DataFrame, products: DataFrame, as_of,
                        k: int = 5, days_back: int = 90) -> DataFrame:
    """``bought_together`` for every product in one job."""
    rows = _recent_rows(items, transactions, products, as_of, days_back)
    return _described(_together(rows, "transaction_id", k), products, "related", "co_purchase_count")


def _customer_products(items: DataFrame, transactions: DataFrame, products: DataFrame) -> DataFrame:
    buyers = transactions.where(F.col("customer_id").isNotNull()).select("transaction_id", "customer_id")
    return (
        items.select("transaction_id", "product_id").join(buyers, "transaction_id")
        .select("customer_id", "product_id").distinct()
        .join(products.select("product_id"), "product_id", "left_semi")
    )


def shared_customers(items: DataFrame, transactions: DataFrame, products: DataFrame, product_id: int,
                     k: int = 10) -> DataFrame:
    """The ``k`` products sharing most customers with one product.

    Goes from the product's lines to its customers, then to their lines only."""
    own = items.where(F.col("product_id") == product_id).select("transaction_id").distinct()
    buyers = transactions.where(F.col("customer_id").isNotNull())
    customers = buyers.join(own, "transaction_id", "left_semi").select("customer_id").distinct()
    rows = _customer_products(items, buyers.join(customers, "customer_id", "left_semi"), products)
    best = _best(partners_of(rows, "customer_id", "product_id", product_id), product_id, k)
    return _described(best, products, "similar", "common_customers")


def shared_customers_all(items: DataFrame, transactions: DataFrame, products: DataFrame,
                         k: int = 10) -> DataFrame:
    """``shared_customers`` for every product in one job."""
    rows = _customer_products(items, transactions, products)
    return _described(_together(rows, "customer_id", k), products, "similar", "common_customers")


# -- categories and advice -------------------------------------------------------

def category_performance(items: DataFrame, transactions: DataFrame, products: DataFrame, as_of,
                         days_back: int = 90) -> DataFrame:
    """Transactions, units, revenue and sold products of each category lately."""
    return (
        items.select("transaction_id", "product_id", "quantity", "unit_price")
        .join(_recent(transactions, as_of, days_back), "transaction_id")
        .join(products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(F.countDistinct("transaction_id").alias("transaction_count"),
             F.sum("quantity").alias("total_quantity"),
             F.sum(exact(F.col("quantity") * F.col("unit_price"))).cast("double").alias("total_revenue"),
             F.countDistinct("product_id").alias("product_count"))
        .withColumn("avg_revenue_per_transaction", F.col("total_revenue") / F.col("transaction_count"))
        .orderBy(F.col("total_revenue").desc(), "category")
    )


def _strong_pairs(correlation: DataFrame, threshold: float) -> DataFrame:
    return correlation.where((F.col("a") < F.col("b")) & (F.col("score") > threshold))


def recommendation_insights(rules: DataFrame, correlation: DataFrame, min_lift: float = 2.0,
                            min_confidence: float = 0.7, min_score: float = 0.5) -> DataFrame:
    """Number of strong rules and of strong category pairs, with their texts
    (null when there are none). Rules have any number of items. A pair counts
    once, the diagonal not at all."""
    strong = rules.where((F.col("lift") > min_lift) & (F.col("confidence") > min_confidence)).agg(
        F.count(F.lit(1)).alias("strong_rules"))
    text = lambda count, template: F.when(F.col(count) > 0, F.format_string(template, F.col(count)))
    # The two message texts.
    return (
        strong.withColumn("strong_category_pairs",
                          _strong_pairs(correlation, min_score).agg(F.count(F.lit(1)).alias("n")).scalar())
        .withColumn("rule_insight", text(
            "strong_rules", "Found %d strong product associations for cross-selling"))
        .withColumn("category_insight", text(
            "strong_category_pairs", "Identified %d strong category relationships"))
    )


def recommendation_strategies(rules: DataFrame, correlation: DataFrame, k: int = 5, min_lift: float = 2.0,
                              min_score: float = 0.5) -> DataFrame:
    """The first ``k`` rules with a lift over ``min_lift`` and category pairs over
    ``min_score``."""
    # The two strategy names and descriptions.
    cross = (
        rules.where(F.col("lift") > min_lift)
        .select(F.lit("Cross-selling").alias("type"),
                F.lit("Bundle frequently co-purchased products").alias("description"),
                F.array_join("antecedents", ", ").alias("a"), F.array_join("consequents", ", ").alias("b"),
                F.col("lift").alias("score"))
        .orderBy(F.col("score").desc(), "a", "b").limit(k)
    )
    category = (
        _strong_pairs(correlation, min_score)
        .select(F.lit("Category-based").alias("type"),
                F.lit("Promote complementary categories together").alias("description"),
                "a", "b", "score")
        .orderBy(F.col("score").desc(), "a", "b").limit(k)
    )
    return cross.unionByName(category)


def product_report(items: DataFrame, transactions: DataFrame, products: DataFrame, product_id: int,
                   as_of) -> dict[str, DataFrame]:
    """What is shown for one product: shared customers, shared baskets, categories."""
    product_lookup(products, product_id, strict=True)
    return {
        "similar_products": shared_customers(items, transactions, products, product_id),
        "frequently_bought_together": bought_together(items, transactions, products, product_id, as_of),
        "category_analysis": category_performance(items, transactions, products, as_of),
    }
