"""Row repair and filtering of the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.functions.dates import shift
from mercantile.functions.expressions import row_count


#: The status of orders that have arrived. Fixed value.
DELIVERED = "delivered"


def products_clean(
    products: DataFrame,
    columns: tuple[str, ...] = (
        "product_id",
        "product_category_name",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    ),
) -> DataFrame:
    """Known columns only, with a missing category named Unknown."""
    named = F.coalesce("product_category_name", F.lit("Unknown")).alias("product_category_name")
    kept = [c for c in columns if c in products.columns]
    return products.select(*[named if c == "product_category_name" else F.col(c) for c in kept])


def standardize_text(
    df: DataFrame,
    column: str,
    patterns: tuple[str, ...] = ("%sao paulo%", "%são paulo%"),
    old: str = "ã",
    new: str = "a",
) -> DataFrame:
    """Rows that match a pattern (any case) get ``old`` replaced, trimmed and lower-cased.

    The replacement is case-sensitive and comes before lower-casing.
    """
    value = F.col(column)
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | value.ilike(pattern)
    cleaned = F.lower(F.trim(F.replace(value, F.lit(old), F.lit(new))))
    return df.withColumn(column, F.when(hit, cleaned).otherwise(value))


def count_matching(df: DataFrame, column: str, pattern: str = "%sao paulo%", limit: int = 10) -> DataFrame:
    """Rows per value among the values that match, most frequent first."""
    return (
        df.where(F.col(column).ilike(pattern))
        .groupBy(column)
        .agg(row_count().alias("count"))
        .orderBy(F.desc("count"), F.asc(column))
        .limit(limit)
    )


def delivered(orders: DataFrame) -> DataFrame:
    """Delivered orders, with or without a delivery date."""
    return orders.where(F.col("order_status") == DELIVERED)


def orders_clean(orders: DataFrame) -> DataFrame:
    """Delivered orders that have a delivery date, with a missing approval set to a day after purchase.

    An approval before the purchase is left as it is: only a missing one is filled.
    """
    placed, approved = F.col("order_purchase_timestamp"), F.col("order_approved_at")
    filled = F.when(
        placed.isNotNull() & (approved.isNull() | (approved < placed)),
        F.coalesce(approved, shift("order_purchase_timestamp", "1 day")),
    ).otherwise(approved)
    return (
        delivered(orders)
        .where(F.col("order_delivered_customer_date").isNotNull())
        .withColumn("order_approved_at", filled)
    )


def reviews_clean(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("review_score").isNotNull())
