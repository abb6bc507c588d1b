"""Recency, frequency and monetary scores, segments and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercantile.functions import dimensions as dim
from mercantile.functions.expressions import by_segment, dollars, percent, ratio, rfm_segment, round_to, row_count
from mercantile.operators.ordering import add_tiles, quantile_values, quantiles
from mercantile.sources.scratch import Scratch


def paying_customers(retention_base: DataFrame, *carried: str) -> DataFrame:
    """The three measures of customers who paid something. Figures over all of them need no scores."""
    return retention_base.where(F.col("total_revenue") > 0).select(
        "customer_unique_id",
        "recency_days",
        F.col("total_orders").alias("frequency"),
        F.col("total_revenue").alias("monetary"),
        *carried,
    )


def customer_rfm(retention_base: DataFrame, scratch: Scratch, *carried: str) -> DataFrame:
    """Scores 1..5 for customers who paid something; the id breaks ties.

    ``carried`` columns of the base come along, which saves a later join back to it.
    """
    paying = paying_customers(retention_base, *carried)
    keys = {"r_score": -F.col("recency_days"), "f_score": F.col("frequency"), "m_score": F.col("monetary")}
    return add_tiles(paying, keys, "customer_unique_id", 5, scratch)


def with_segment(rfm: DataFrame) -> DataFrame:
    return rfm.withColumn("rfm_segment", rfm_segment())


def rfm_validation(rfm: DataFrame) -> DataFrame:
    """Customers and mean recency per segment."""
    return (
        rfm.groupBy("rfm_segment")
        .agg(row_count().alias("customers"), round_to(ratio(F.sum("recency_days"), row_count()), 1).alias("avg_recency"))
        .orderBy("avg_recency", "rfm_segment")
    )


def segment_distribution(rfm: DataFrame) -> DataFrame:
    """Customers, share, revenue and revenue per head of every segment, in one pass."""
    everyone = F.sum("customer_count").over(Window.partitionBy())
    return (
        rfm.where(F.col("rfm_segment").isNotNull())
        .groupBy(F.col("rfm_segment").alias("segment"))
        .agg(row_count().alias("customer_count"), F.sum("monetary").alias("total_revenue"))
        .withColumn("percentage", round_to(percent(F.col("customer_count"), everyone), 2))
        .withColumn("avg_revenue_per_customer", round_to(ratio(F.col("total_revenue"), F.col("customer_count")), 2))
        .withColumn("total_revenue", F.col("total_revenue").cast("double"))
        .orderBy(F.desc("total_revenue"), "segment")
    )


def segment_metrics(rfm: DataFrame) -> DataFrame:
    """Count, revenue and means per segment, to two decimals."""
    return (
        rfm.groupBy("rfm_segment")
        .agg(
            F.count("monetary").alias("customer_count"),
            round_to(F.sum("monetary").cast("double"), 2).alias("total_revenue"),
            round_to(ratio(F.sum("monetary"), F.count("monetary")), 2).alias("avg_revenue"),
            round_to(ratio(F.sum("frequency"), F.count("frequency")), 2).alias("avg_frequency"),
            round_to(ratio(F.sum("recency_days"), F.count("recency_days")), 2).alias("avg_recency"),
        )
        .orderBy(F.desc("total_revenue"), "rfm_segment")
    )


def segment_characteristics(rfm: DataFrame) -> DataFrame:
    """Means and revenue share per segment."""
    everything = F.sum("revenue").over(Window.partitionBy())
    return (
        rfm.groupBy("rfm_segment")
        .agg(
            row_count().alias("customer_count"),
            F.sum("monetary").alias("revenue"),
            ratio(F.sum("recency_days"), row_count()).alias("avg_recency"),
            ratio(F.sum("frequency"), row_count()).alias("avg_frequency"),
        )
        .select(
            "rfm_segment",
            "customer_count",
            F.col("revenue").cast("double").alias("total_revenue"),
            ratio(F.col("revenue"), F.col("customer_count")).alias("avg_revenue"),
            "avg_recency",
            "avg_frequency",
            percent(F.col("revenue"), everything).alias("revenue_share"),
        )
    )


def score_stats(rfm: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of location and spread figures for the three measures."""
    medians = quantiles(
        rfm,
        {
            "recency_median": ("recency_days", 0.5),
            "frequency_median": ("frequency", 0.5),
            "monetary_median": ("monetary", 0.5),
        },
        scratch,
    )
    rest = rfm.agg(
        ratio(F.sum("recency_days"), row_count()).alias("recency_mean"),
        F.min("recency_days").alias("recency_min"),
        F.max("recency_days").alias("recency_max"),
        round_to(F.stddev_samp("recency_days"), 6).alias("recency_std"),
        ratio(F.sum("frequency"), row_count()).alias("frequency_mean"),
        F.max("frequency").alias("frequency_max"),
        F.sum("frequency").alias("frequency_total_orders"),
        ratio(F.sum("monetary"), row_count()).alias("monetary_mean"),
        F.min("monetary").cast("double").alias("monetary_min"),
        F.max("monetary").cast("double").alias("monetary_max"),
        F.sum("monetary").cast("double").alias("monetary_total"),
    )
    return rest.crossJoin(F.broadcast(medians))


def score_histogram(rfm: DataFrame) -> DataFrame:
    """Customers per score value for each of the three scores."""
    scores = ("r_score", "f_score", "m_score")
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).alias("score")) for s in scores]))
    return (
        rfm.select(pairs.alias("p"))
        .groupBy("p.score_name", "p.score")
        .agg(row_count().alias("customers"))
        .orderBy("score_name", "score")
    )


def high_value_customers(rfm: DataFrame, scratch: Scratch, top_share: float = 0.1) -> DataFrame:
    """Customers at or above the (1 - top_share) quantile of spending, best first."""
    threshold = quantile_values(rfm, {"threshold": ("monetary", 1 - top_share)}, scratch)["threshold"]
    return rfm.where(F.col("monetary").cast("double") >= F.lit(threshold)).orderBy(
        F.desc("monetary"), "customer_unique_id"
    )


def churn_risk_summary(rfm: DataFrame, scratch: Scratch) -> DataFrame:
    """One-order customers beyond the third quartile of recency: count, revenue and share."""
    limit = quantile_values(rfm, {"limit": ("recency_days", 0.75)}, scratch)["limit"]
    risky = (F.col("recency_days") > F.lit(limit)) & (F.col("frequency") == 1)
    return rfm.agg(
        F.count_if(risky).alias("high_risk_count"),
        F.coalesce(F.sum(F.when(risky, F.col("monetary"))), F.lit(0)).cast("double").alias("high_risk_revenue"),
        percent(F.count_if(risky), row_count()).alias("risk_percentage"),
    )


def marketing_segments(rfm: DataFrame) -> DataFrame:
    """Customers with the audience their segment routes to; unrouted segments are left out."""
    audience = by_segment("rfm_segment", dim.MARKETING_AUDIENCE)
    return rfm.select("customer_unique_id", audience.alias("marketing_segment")).where("marketing_segment IS NOT NULL")


def churn_label_from_segment(rfm: DataFrame) -> DataFrame:
    """Stand-in churn features when only segment labels exist."""
    return rfm.select(
        "customer_unique_id",
        "recency_days",
        "frequency",
        "monetary",
        F.when(F.col("rfm_segment").isin(dim.CHURNED_SEGMENTS), 1).otherwise(0).alias("churn_label"),
        F.lit(dim.FALLBACK_REVIEW).alias("avg_review_score"),
        F.lit(dim.FALLBACK_LATE_RATE).alias("late_delivery_rate"),
    )


def report_segments(rfm: DataFrame) -> DataFrame:
    """Segment table of the printed report."""
    return (
        rfm.groupBy(F.col("rfm_segment").alias("name"))
        .agg(F.count("monetary").alias("count"), F.sum("monetary").alias("revenue"))
        .select(
            "name",
            "count",
            dollars(F.col("revenue").cast("double")).alias("revenue"),
            dollars(ratio(F.col("revenue"), F.col("count"))).alias("avg"),
        )
        .orderBy("name")
    )
