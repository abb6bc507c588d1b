"""Risk, lifetime value and churn scores per customer, and what is reported from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.functions import dimensions as dim
from mercantile.functions.expressions import (
    by_segment,
    churn_score,
    failed_checks,
    round_to,
    row_count,
    score_confidence,
    score_segment,
    segment_risk,
    simple_ltv,
)


def customer_list(rfm: DataFrame, segment: str | None = None) -> DataFrame:
    """Customers with segment risk (three decimals) and a simple lifetime value."""
    kept = rfm if segment is None else rfm.where(F.col("rfm_segment") == segment)
    return kept.select(
        "customer_unique_id",
        "rfm_segment",
        round_to(segment_risk("rfm_segment", "recency_days"), 3).alias("churn_risk"),
        simple_ltv("monetary", "frequency").alias("ltv_estimate"),
        F.col("monetary").cast("double").alias("monetary"),
        "frequency",
    )


def page(df: DataFrame, key: str, limit: int = 100, offset: int = 0, tier: str | None = None) -> DataFrame:
    """One page of ``df`` in key order; some tiers get smaller pages than they ask for.

    For the first pages. Deep ones, and many of one table, are read off a ``paging.PageIndex``.
    """
    size = min(limit, dim.TIER_PAGE.get(tier, limit))
    return df.orderBy(key).offset(offset).limit(size)


def customer_detail(
    rfm: DataFrame, ids: DataFrame, churn: DataFrame | None = None, key: str = "customer_unique_id"
) -> DataFrame:
    """Everything known about the customers named in ``ids``, as a batch of point lookups."""
    found = rfm.join(ids.select(key), key, "left_semi")
    if churn is not None:
        # A known customer without a model probability counts as risk 0.
        probability = F.col("churn_probability") if "churn_probability" in churn.columns else F.lit(0.0)
        known = churn.select(
            key,
            F.coalesce(probability, F.lit(0.0)).alias("model_risk"),
            F.coalesce("churn_label", F.lit(0)).alias("churn_label"),
        )
        found = found.join(known, key, "left")
    else:
        found = found.withColumns({"model_risk": F.lit(None).cast("double"), "churn_label": F.lit(None).cast("int")})
    return found.select(
        key,
        F.col("rfm_segment").alias("segment"),
        "r_score",
        "f_score",
        "m_score",
        F.col("monetary").cast("double").alias("total_spent"),
        F.col("frequency").alias("order_count"),
        F.col("recency_days").alias("days_since_last_purchase"),
        round_to(segment_risk("rfm_segment", "recency_days", kept=False), 3).alias("churn_risk"),
        simple_ltv("monetary", "frequency").alias("ltv_estimate"),
        "model_risk",
        "churn_label",
        by_segment("rfm_segment", dim.RECOMMENDED_ACTION, dim.DEFAULT_ACTION).alias("recommended_action"),
    )


def valid_requests(requests: DataFrame) -> DataFrame:
    return requests.where(F.size(failed_checks()) == 0)


def rejected_requests(requests: DataFrame) -> DataFrame:
    """Requests that fail a check, with the names of the failing fields."""
    return requests.withColumn("failed_fields", F.array_join(failed_checks(), ",")).where("failed_fields <> ''")


def score_requests(requests: DataFrame, *carried: str) -> DataFrame:
    """Churn score, segment, discounted lifetime value, action and confidence of valid requests.

    Row-wise only, so the same function scores a batch and a stream.
    """
    scored = valid_requests(requests).withColumn("_score", churn_score())
    segment = score_segment("_score")
    return scored.select(
        *carried,
        round_to("_score", 3).alias("churn_risk_score"),
        segment.alias("segment"),
        round_to(simple_ltv("monetary", "frequency") * (F.lit(1.0) - F.col("_score")), 2).alias("ltv_estimate"),
        by_segment(segment, dim.RECOMMENDED_ACTION, dim.DEFAULT_ACTION).alias("recommended_action"),
        score_confidence().alias("confidence"),
    )


def segment_probability(rfm: DataFrame) -> DataFrame:
    """Churn probability from the segment when no model has scored the customers."""
    return rfm.withColumn("churn_probability", segment_risk("rfm_segment", "recency_days"))


def in_risk_band(scored: DataFrame, band: str | None) -> DataFrame:
    p = F.col("churn_probability")
    bands = {
        "high": p >= dim.HIGH_RISK,
        "medium": (p >= dim.MEDIUM_RISK) & (p < dim.HIGH_RISK),
        "low": p < dim.MEDIUM_RISK,
    }
    return scored if band is None else scored.where(bands[band])


def riskiest(scored: DataFrame, limit: int = 100, band: str | None = None, key: str = "customer_unique_id") -> DataFrame:
    """The customers most likely to churn, optionally within a band."""
    return (
        in_risk_band(scored, band)
        .select(key, "churn_probability")
        .orderBy(F.desc("churn_probability"), key)
        .limit(limit)
    )


def risk_band_totals(scored: DataFrame) -> DataFrame:
    """Customers, smallest and largest probability per risk band."""
    p = F.col("churn_probability")
    band = F.when(p >= dim.HIGH_RISK, "high").when(p >= dim.MEDIUM_RISK, "medium").otherwise("low")
    return scored.groupBy(band.alias("risk_band")).agg(
        row_count().alias("customers"),
        round_to(F.min(p), 6).alias("min_probability"),
        round_to(F.max(p), 6).alias("max_probability"),
    )


def churn_risk_split(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Customers above and at or below a probability."""
    high = F.count_if(F.col("churn_probability") > threshold)
    return scored.agg(high.alias("high_risk_customers"), (row_count() - high).alias("low_risk_customers"))


def high_risk_list(scored: DataFrame, limit: int | None = None, key: str = "customer_unique_id") -> DataFrame:
    """Hand-off list of all high-risk customers with segment and action, or of the ``limit`` likeliest."""
    listed = in_risk_band(scored, "high").select(
        key,
        round_to("churn_probability", 6).alias("churn_probability"),
        F.col("rfm_segment").alias("segment"),
        by_segment("rfm_segment", dim.RECOMMENDED_ACTION, dim.DEFAULT_ACTION).alias("action"),
    )
    return listed if limit is None else listed.orderBy(F.desc("churn_probability"), key).limit(limit)
