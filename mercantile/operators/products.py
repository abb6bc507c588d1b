"""Category, seller and state reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercantile.functions.expressions import ratio, round_to, row_count
from mercantile.operators.cleaning import orders_clean
from mercantile.operators.revenue import share_pct
from mercantile.sources.scratch import Scratch


def translate_category(df: DataFrame, translation: DataFrame, column: str = "category") -> DataFrame:
    """Adds the English category name, falling back to the source name.

    ``df`` holds one row per category here, so both sides are small aggregates.
    """
    names = translation.select(
        F.col("product_category_name").alias(column), F.col("product_category_name_english").alias("_english")
    )
    return (
        df.join(names, column, "left")
        .withColumn(f"{column}_english", F.coalesce("_english", column))
        .drop("_english")
    )


def _category(products: DataFrame) -> DataFrame:
    return products.select("product_id", F.coalesce("product_category_name", F.lit("Unknown")).alias("category"))


def category_revenue_rank(items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Item revenue, share and rank of every category.

    Items are summed per product before the join, so a best-seller joins as one row.
    """
    per_product = items.groupBy("product_id").agg(F.sum("price").alias("price"))
    per_category = (
        per_product.join(_category(products), "product_id").groupBy("category").agg(F.sum("price").alias("revenue"))
    )
    return (
        translate_category(per_category, translation)
        .select(
            F.col("category_english").alias("category"),
            F.col("revenue").cast("double").alias("product_revenue"),
            share_pct(F.col("revenue"), F.sum("revenue").over(Window.partitionBy())).alias("revenue_pct"),
            F.rank().over(Window.orderBy(F.desc("revenue"))).alias("rank"),
        )
        .orderBy("rank", "category")
    )


def category_performance(orders: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Orders, revenue, freight, profit and margin per category over the clean orders.

    Counting distinct orders per category needs the category on every item. The item-to-product
    join is followed by a shuffle on (category, order), so adaptive execution is free to split the
    partition of a product that holds a large share of the items. Amounts are folded to
    (category, order) before that shuffle.
    """
    clean = orders_clean(orders).select("order_id")
    lines = items.select("order_id", "product_id", "price", "freight_value").join(clean, "order_id", "left_semi")
    per_order = (
        lines.join(_category(products), "product_id")
        .groupBy("category", "order_id")
        .agg(F.sum("price").alias("price"), F.sum("freight_value").alias("freight"))
    )
    return _category_report(per_order, translation)


def category_performance_by_layout(orders: DataFrame, lines: DataFrame, translation: DataFrame) -> DataFrame:
    """The same off a layout by order: ``lines`` (order_id, category, price, freight). Nothing but the sums per category is shuffled."""
    clean = orders_clean(orders).select("order_id")
    per_order = (
        lines.where("category IS NOT NULL")
        .join(clean, "order_id", "left_semi")
        .groupBy("category", "order_id")
        .agg(F.sum("price").alias("price"), F.sum("freight").alias("freight"))
    )
    return _category_report(per_order, translation)


def _category_report(per_order: DataFrame, translation: DataFrame) -> DataFrame:
    """From sums per category and order."""
    per_category = per_order.groupBy("category").agg(
        row_count().alias("order_count"), F.sum("price").alias("revenue"), F.sum("freight").alias("freight_cost")
    )
    profit = F.col("revenue") - F.col("freight_cost")
    return translate_category(per_category, translation).select(
        F.col("category_english").alias("product_category_name_english"),
        "order_count",
        F.col("revenue").cast("double").alias("revenue"),
        F.col("freight_cost").cast("double").alias("freight_cost"),
        profit.cast("double").alias("profit"),
        share_pct(profit, F.col("revenue")).alias("margin_pct"),
        share_pct(F.col("revenue"), F.sum("revenue").over(Window.partitionBy())).alias("revenue_pct"),
    )


def top_categories(performance: DataFrame, n: int = 20) -> DataFrame:
    """The n most profitable categories."""
    return performance.orderBy(F.desc("profit"), "product_category_name_english").limit(n)


def seller_performance(order_facts: DataFrame, items: DataFrame, sellers: DataFrame, scratch: Scratch) -> DataFrame:
    """Orders, revenue and mean review per seller over the clean orders.

    Items are folded to (seller, order) first. An order then meets its review once per seller,
    and nothing fans out. There may be very many sellers, so the overall total is a second read of
    the stored seller rows and not a window over all of them.
    """
    scored = orders_clean(order_facts).select(
        "order_id", ratio(F.col("review_sum"), F.col("review_count")).alias("review")
    )
    per_order = items.groupBy("order_id", "seller_id").agg(F.sum("price").alias("price"))
    per_seller = (
        per_order.join(scored, "order_id")
        .groupBy("seller_id")
        .agg(
            row_count().alias("order_count"),
            F.sum("price").alias("revenue"),
            round_to(ratio(F.sum("review"), F.count("review")), 2).alias("avg_review"),
        )
    )
    per_seller = scratch.store(per_seller, "sellers")
    total = per_seller.agg(F.sum("revenue").alias("all_revenue"))
    return (
        per_seller.join(sellers.select("seller_id", "seller_state"), "seller_id")
        .crossJoin(F.broadcast(total))
        .select(
            "seller_id",
            "seller_state",
            "order_count",
            F.col("revenue").cast("double").alias("revenue"),
            "avg_review",
            share_pct(F.col("revenue"), F.col("all_revenue")).alias("revenue_pct"),
        )
    )


def top_sellers(performance: DataFrame, n: int = 20) -> DataFrame:
    return performance.orderBy(F.desc("revenue"), "seller_id").limit(n)


def state_performance(order_facts: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders, buyers and revenue per customer state over the clean orders with a payment."""
    accounts = (
        orders_clean(order_facts)
        .where(F.col("payment_rows").isNotNull())
        .groupBy("customer_id")
        .agg(row_count().alias("orders"), F.sum("payment_total").alias("paid"))
    )
    people = (
        accounts.join(customers.select("customer_id", "customer_unique_id", "customer_state"), "customer_id")
        .groupBy("customer_state", "customer_unique_id")
        .agg(F.sum("orders").alias("orders"), F.sum("paid").alias("paid"))
    )
    return (
        people.groupBy("customer_state")
        .agg(
            F.sum("orders").alias("order_count"),
            F.count("customer_unique_id").alias("unique_buyers"),
            F.sum("paid").alias("revenue"),
        )
        .select(
            "customer_state",
            "order_count",
            "unique_buyers",
            F.col("revenue").cast("double").alias("total_revenue"),
            share_pct(F.col("revenue"), F.sum("revenue").over(Window.partitionBy())).alias("revenue_pct"),
        )
    )


def top_states(performance: DataFrame, n: int | None = None) -> DataFrame:
    ranked = performance.orderBy(F.desc("total_revenue"), "customer_state")
    return ranked if n is None else ranked.limit(n)


def category_insights(top: DataFrame, order_by: str = "profit") -> DataFrame:
    """One row about the categories of ``top``, which has one row per category, so its quartile is taken directly."""
    name, margin = F.col("product_category_name_english"), F.col("margin_pct")
    figures = top.agg(
        row_count().alias("total_categories"),
        F.max_by(F.struct(name.alias("n"), F.col("revenue").alias("r"), margin.alias("m")), F.col(order_by)).alias("best"),
        F.try_divide(F.sum(margin.cast("decimal(9,2)")).cast("double"), row_count().cast("double")).alias(
            "avg_margin_all_categories"
        ),
        F.percentile(margin, F.lit(0.75)).alias("p75"),
    )
    listed = (
        top.crossJoin(F.broadcast(figures.select("p75")))
        .where(margin > F.col("p75"))
        .orderBy(F.desc(order_by), name)
        .limit(5)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order_by).alias("o"), name.alias("n"))), asc=False).alias("five"))
    )
    return figures.crossJoin(F.broadcast(listed)).select(
        "total_categories",
        F.col("best.n").alias("top_category"),
        F.col("best.r").alias("top_category_revenue"),
        F.col("best.m").alias("top_category_margin"),
        "avg_margin_all_categories",
        F.array_join(F.transform("five", lambda x: x["n"]), ", ").alias("high_margin_categories"),
    )


def seller_insights(top: DataFrame) -> DataFrame:
    """One row about the top sellers; the most frequent state is the first by name on a tie."""
    best = F.max_by(F.struct(F.col("seller_id").alias("s"), F.col("revenue").alias("r")), F.col("revenue"))
    review = F.col("avg_review").cast("decimal(9,2)")
    return top.agg(
        row_count().alias("total_top_sellers"),
        best.alias("best"),
        round_to(F.try_divide(F.sum(review).cast("double"), F.count(review).cast("double")), 6).alias(
            "avg_review_top_sellers"
        ),
        F.mode("seller_state", True).alias("top_state"),
    ).select(
        "total_top_sellers",
        F.concat(F.substring(F.col("best.s").cast("string"), 1, 8), F.lit("...")).alias("top_seller"),
        F.col("best.r").alias("top_seller_revenue"),
        "avg_review_top_sellers",
        "top_state",
    )
