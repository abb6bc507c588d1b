"""The customer mart and the two churn rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercantile.functions.dates import shift, whole_days
from mercantile.functions.expressions import percent, ratio, round_to, row_count
from mercantile.operators.cleaning import orders_clean


def customer_base(order_facts: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per person over the clean orders.

    Orders are folded to account grain before they meet the customers, so an account with a very
    large share of all orders is summed map-side and joins as a single row. Averages travel as
    sums and counts.
    """
    delivered_on, promised = "order_delivered_customer_date", "order_estimated_delivery_date"
    late = F.to_date(delivered_on) > F.to_date(promised)
    review = ratio(F.col("review_sum"), F.col("review_count"))
    orders = orders_clean(order_facts).select(
        "customer_id",
        "order_id",
        F.col("order_purchase_timestamp").alias("placed"),
        "payment_total",
        review.alias("review"),
        whole_days(delivered_on, promised).cast("long").alias("delay"),
        F.when(late, 1).otherwise(0).cast("long").alias("late"),
    )
    accounts = orders.groupBy("customer_id").agg(
        F.min("placed").alias("first_placed"),
        F.max("placed").alias("last_placed"),
        F.countDistinct("order_id").alias("orders"),
        row_count().alias("order_rows"),
        F.sum("payment_total").alias("paid"),
        F.count("payment_total").alias("paid_rows"),
        F.sum("review").alias("review"),
        F.count("review").alias("review_rows"),
        F.sum("delay").alias("delay"),
        F.count("delay").alias("delay_rows"),
        F.sum("late").alias("late"),
    )
    return (
        accounts.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            F.min("first_placed").alias("first_order_date"),
            F.max("last_placed").alias("last_order_date"),
            F.sum("orders").alias("total_orders"),
            F.coalesce(F.sum("paid"), F.lit(0)).cast("decimal(28,2)").alias("total_revenue"),
            ratio(F.sum("paid"), F.sum("paid_rows")).alias("avg_order_value"),
            ratio(F.sum("review"), F.sum("review_rows")).alias("avg_review_score"),
            ratio(F.sum("delay"), F.sum("delay_rows")).alias("avg_delivery_difference_days"),
            ratio(F.sum("late"), F.sum("order_rows")).alias("late_delivery_rate"),
        )
    )


def label_churn(base: DataFrame, as_of: str | None = None, window_days: int = 90) -> DataFrame:
    """Adds recency in days and the churn label.

    The reference date is the last purchase of all customers unless ``as_of`` names one. It is a
    one-row aggregate; pass a stored ``base`` so that it is not computed twice.
    """
    if as_of is None:
        day = base.agg(F.to_date(F.max("last_order_date")).alias("as_of"))
        dated = base.crossJoin(F.broadcast(day))
    else:
        dated = base.withColumn("as_of", F.lit(as_of).cast("date"))
    gone = shift("last_order_date", f"{window_days} days") < F.col("as_of").cast("timestamp_ntz")
    return (
        dated.withColumn("recency_days", F.datediff("as_of", F.to_date("last_order_date")))
        .withColumn("churn_label", F.when(gone, 1).otherwise(0))
        .drop("as_of")
    )


def churn_summary(retention_base: DataFrame) -> DataFrame:
    """Customers and revenue per churn label."""
    return retention_base.groupBy("churn_label").agg(
        row_count().alias("count"), F.sum("total_revenue").alias("revenue")
    )


def churn_metrics(summary: DataFrame) -> DataFrame:
    """One row of totals, rates and per-head revenue from the churn summary."""
    gone, active = F.col("churn_label") == 1, F.col("churn_label") == 0

    def total(column: str, keep) -> Column:
        return F.coalesce(F.sum(F.when(keep, F.col(column))), F.lit(0))

    sums = summary.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_customers"),
        total("count", gone).alias("churned_customers"),
        total("count", active).alias("active_customers"),
        total("revenue", gone).cast("double").alias("churned_revenue"),
        total("revenue", active).cast("double").alias("active_revenue"),
    )
    per_head = {
        "avg_revenue_per_churned": ("churned_revenue", "churned_customers"),
        "avg_revenue_per_active": ("active_revenue", "active_customers"),
    }
    return (
        sums.withColumn("churn_rate_pct", percent(F.col("churned_customers"), F.col("total_customers")))
        .withColumn("retention_rate_pct", percent(F.col("active_customers"), F.col("total_customers")))
        .withColumn("revenue_at_risk", F.col("churned_revenue"))
        .withColumns({k: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0)) for k, (a, b) in per_head.items()})
    )


def one_time_buyer_pct(base: DataFrame) -> DataFrame:
    return base.agg(percent(F.count_if(F.col("total_orders") == 1), row_count()).alias("one_time_pct"))


def churn_by_segment(rfm: DataFrame, retention_base: DataFrame | None = None) -> DataFrame:
    """Churned customers per segment; the label is joined only if ``rfm`` does not carry it."""
    labelled = rfm
    if retention_base is not None:
        labels = retention_base.select("customer_unique_id", "churn_label")
        labelled = rfm.select("customer_unique_id", "rfm_segment").join(labels, "customer_unique_id")
    return (
        labelled.groupBy("rfm_segment")
        .agg(
            row_count().alias("total_customers"),
            F.count_if(F.col("churn_label") == 1).alias("churned_customers"),
        )
        .withColumn(
            "churn_rate_pct", round_to(percent(F.col("churned_customers"), F.col("total_customers")), 2)
        )
        .orderBy(F.desc("churn_rate_pct"), "rfm_segment")
    )


def delay_vs_review(base: DataFrame) -> DataFrame:
    """Mean review score and customers per day of mean delivery delay."""
    bucket = F.round("avg_delivery_difference_days").cast("int")
    return (
        base.groupBy(bucket.alias("delay_bucket"))
        .agg(
            round_to(ratio(F.sum(F.col("avg_review_score").cast("decimal(20,10)")), F.count("avg_review_score")), 2).alias(
                "avg_review_score"
            ),
            row_count().alias("customer_count"),
        )
        .orderBy("delay_bucket")
    )


def review_vs_repeat(base: DataFrame) -> DataFrame:
    """Repeat customers per rounded review score (no score: NULL bucket, last)."""
    bucket = F.round("avg_review_score").cast("int")
    return (
        base.where(F.col("total_orders") > 1)
        .groupBy(bucket.alias("review_bucket"))
        .agg(
            row_count().alias("repeat_customer_count"),
            round_to(ratio(F.sum("total_orders"), row_count()), 2).alias("avg_orders_per_repeat_customer"),
            F.max("total_orders").alias("max_orders_in_bucket"),
        )
        .orderBy(F.asc_nulls_last("review_bucket"))
    )
