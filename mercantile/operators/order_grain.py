"""Payments and reviews folded to one row per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercantile.functions.expressions import row_count


def payment_totals(payments: DataFrame, *more: Column) -> DataFrame:
    """Everything later steps need to know about an order's payments, in additive form."""
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_total"),
        row_count().alias("payment_rows"),
        F.count_if(F.col("payment_type") == "credit_card").alias("card_rows"),
        F.sum("payment_installments").alias("installment_sum"),
        F.count("payment_installments").alias("installment_count"),
        *more,
    )


def review_totals(reviews: DataFrame) -> DataFrame:
    """Scored reviews per order: sum, count and latest date (rows without a score are left out)."""
    return (
        reviews.where(F.col("review_score").isNotNull())
        .groupBy("order_id")
        .agg(
            F.sum(F.col("review_score").cast("long")).alias("review_sum"),
            row_count().alias("review_count"),
            F.max("review_creation_date").alias("latest_review_date"),
        )
    )


def order_revenue(payments: DataFrame) -> DataFrame:
    """Total payment per order."""
    return payments.groupBy("order_id").agg(F.sum("payment_value").alias("total_order_payment"))


def order_review_agg(reviews: DataFrame) -> DataFrame:
    """Mean score, number of scored reviews and latest review date per order."""
    return review_totals(reviews).select(
        "order_id",
        F.try_divide("review_sum", "review_count").alias("avg_review_score_per_order"),
        F.col("review_count").alias("review_count_per_order"),
        "latest_review_date",
    )
