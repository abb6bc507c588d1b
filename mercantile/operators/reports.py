"""One-row bundles for reports and summaries.

Every frame joined here has exactly one row, so the cross joins are between single rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.functions import dimensions as dim
from mercantile.functions.expressions import by_segment, ratio, row_count


def churn_share(churn: DataFrame) -> DataFrame:
    """Share of customers counted as churned, by the best evidence the frame has.

    A model probability of at least .6, else the mean label, else a segment risk of at least .6.
    """
    if "churn_probability" in churn.columns:
        part = F.count_if(F.col("churn_probability") >= dim.HIGH_RISK)
    elif "churn_label" in churn.columns:
        part = F.count_if(F.col("churn_label") == 1)
    elif "rfm_segment" in churn.columns:
        part = F.count_if(by_segment("rfm_segment", dim.BASE_RISK, dim.DEFAULT_RISK) >= dim.HIGH_RISK)
    else:
        part = F.lit(0)
    return churn.agg(
        F.coalesce(ratio(part, row_count()), F.lit(0.0)).alias("churn_rate"),
        part.cast("long").alias("churned_customers"),
        row_count().alias("scored_customers"),
    )


def report_kpis(monthly: DataFrame, rfm: DataFrame, churn: DataFrame, growth: DataFrame) -> DataFrame:
    """Revenue, customers, revenue per customer, churn and growth in one row."""
    revenue = monthly.agg(
        F.sum("revenue").cast("double").alias("total_revenue"), ratio(F.sum("revenue"), row_count()).alias("avg_monthly_revenue")
    )
    customers = rfm.agg(row_count().alias("total_customers"))
    per_head = F.coalesce(ratio(F.col("total_revenue"), F.col("total_customers")), F.lit(0.0))
    return (
        revenue.crossJoin(F.broadcast(customers))
        .crossJoin(F.broadcast(churn_share(churn)))
        .crossJoin(F.broadcast(growth.select(F.col("filtered_growth_pct").alias("growth_rate"))))
        .withColumn("avg_order_value", per_head)
    )


def executive_summary(
    revenue: DataFrame, customers: DataFrame, churn: DataFrame, retention: DataFrame, categories: DataFrame
) -> DataFrame:
    """Revenue, customer, churn, retention and category bundles side by side."""
    return (
        revenue.crossJoin(F.broadcast(customers))
        .crossJoin(F.broadcast(churn.select("churn_rate_pct", "revenue_at_risk", "churned_customers", "active_customers")))
        .crossJoin(F.broadcast(retention.select("avg_retention_rate", "total_cohorts")))
        .crossJoin(F.broadcast(categories.select("top_category", "top_category_revenue", "top_category_margin")))
    )
