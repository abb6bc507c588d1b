"""Behavioural churn features for a fixed reference date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercantile.functions.dates import floor_days
from mercantile.functions.expressions import ratio, row_count
from mercantile.operators.cleaning import delivered
from mercantile.operators.ordering import quantile_values
from mercantile.sources.scratch import Scratch


def churn_raw_features(
    order_facts: DataFrame, customers: DataFrame, as_of: str = "2018-06-30", window_days: int = 180
) -> DataFrame:
    """Features per person over delivered orders, before missing values are filled.

    Orders after the reference date stay in, so recency can be negative. Review, card and
    installment means run over review and payment rows. All facts reach the account as additive
    totals in one aggregation.
    """
    late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    placed = F.col("order_purchase_timestamp")
    accounts = (
        delivered(order_facts)
        .groupBy("customer_id")
        .agg(
            F.min(placed).alias("first_placed"),
            F.max(placed).alias("last_placed"),
            F.count("order_id").alias("orders"),
            row_count().alias("order_rows"),
            F.count_if(late).alias("late"),
            *[
                F.sum(c).alias(c)
                for c in (
                    "payment_total",
                    "payment_rows",
                    "card_rows",
                    "installment_sum",
                    "installment_count",
                    "review_sum",
                    "review_count",
                )
            ],
        )
    )
    people = (
        accounts.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            F.min("first_placed").alias("first_order_date"),
            F.max("last_placed").alias("last_order_date"),
            *[F.sum(c).alias(c) for c in accounts.columns if c not in ("customer_id", "first_placed", "last_placed")],
        )
    )
    day = F.lit(as_of).cast("timestamp_ntz")
    cutoff = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{window_days} days'")
    return people.select(
        "customer_unique_id",
        F.when(F.col("last_order_date") < cutoff, 1).otherwise(0).alias("churn_label"),
        floor_days(day, "last_order_date").alias("recency_days"),
        F.col("orders").alias("frequency"),
        F.coalesce("payment_total", F.lit(0)).cast("double").alias("monetary"),
        floor_days(day, "first_order_date").alias("tenure_days"),
        ratio(F.col("review_sum"), F.col("review_count")).alias("avg_review_score"),
        ratio(F.col("late"), F.col("order_rows")).alias("late_delivery_rate"),
        ratio(F.col("card_rows"), F.col("payment_rows")).alias("credit_card_rate"),
        ratio(F.col("installment_sum"), F.col("installment_count")).alias("avg_installments"),
    )


def fill_features(raw: DataFrame, scratch: Scratch) -> DataFrame:
    """Missing review scores become the median, card rates 0, installments 1, late rates 0.

    Pass a stored ``raw``: the median is a second read of it.
    """
    median = quantile_values(raw, {"review": ("avg_review_score", 0.5)}, scratch)["review"]
    return raw.withColumn("avg_review_score", F.coalesce("avg_review_score", F.lit(median).cast("double"))).fillna(
        {"credit_card_rate": 0.0, "avg_installments": 1.0, "late_delivery_rate": 0.0}
    )


def class_distribution(features: DataFrame, label: str = "churn_label") -> DataFrame:
    """Customers and share per label (a missing label counts as 0)."""
    everyone = F.sum("customers").over(Window.partitionBy())
    return (
        features.groupBy(F.coalesce(label, F.lit(0)).alias(label))
        .agg(row_count().alias("customers"))
        .withColumn("share", ratio(F.col("customers"), everyone))
    )
