"""Campaign plans, retention scenarios and recommendations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercantile.functions import dimensions as dim
from mercantile.functions.expressions import by_segment, ratio, round_to, row_count


def campaign_plan(
    rfm: DataFrame, budget: float = 1000.0, channels: Mapping[str, float | None] | None = None
) -> DataFrame:
    """Reach, buyers, revenue and return for every segment and channel.

    A channel without a known reach rate gets the default one. The segment table is a handful of
    rows by the time the channels are exploded.
    """
    channels = channels or dim.CHANNEL_REACH
    rates = [
        F.struct(F.lit(c).alias("channel"), F.lit(dim.DEFAULT_REACH if r is None else r).alias("rate"))
        for c, r in channels.items()
    ]
    sizes = (
        rfm.groupBy(F.col("rfm_segment").alias("target_segment"))
        .agg(row_count().alias("segment_size"), ratio(F.sum("monetary"), row_count()).alias("avg_order_value"))
        .select("*", F.explode(F.array(*rates)).alias("c"))
    )
    conversion = by_segment("target_segment", dim.CONVERSION_RATE, dim.DEFAULT_CONVERSION)
    reach = (F.col("segment_size").cast("double") * F.col("c.rate")).cast("long")
    revenue = F.col("buyers") * F.col("avg_order_value") * 2.0
    roi = (F.col("revenue") - budget) / budget * 100.0 if budget > 0 else F.lit(0.0)
    return (
        sizes.withColumn("estimated_reach", reach)
        .withColumn("buyers", F.col("estimated_reach").cast("double") * conversion)
        .withColumn("revenue", revenue)
        .select(
            "target_segment",
            F.col("c.channel").alias("channel"),
            "segment_size",
            F.lit(float(budget)).alias("budget"),
            "estimated_reach",
            F.round("buyers", 0).alias("estimated_conversion"),
            round_to("revenue", 2).alias("expected_revenue"),
            round_to(roi, 1).alias("roi"),
        )
    )


def retention_scenarios(
    churn: DataFrame,
    by: Sequence[str] = (),
    scenarios: Sequence[tuple[str, float]] = tuple(dim.RETENTION_SCENARIOS),
    cost_per_customer: float = dim.RETENTION_COST,
) -> DataFrame:
    """Customers won back, revenue, cost and return per scenario, over all customers or per group.

    ``churn`` has ``churn_label`` and ``monetary``.
    """
    money = F.col("monetary").cast("decimal(28,2)")
    cases = [F.struct(F.lit(n).alias("name"), F.lit(r).alias("rate")) for n, r in scenarios]
    totals = (
        churn.groupBy(*by)
        .agg(
            row_count().alias("total_customers"),
            F.count_if(F.col("churn_label") == 1).alias("churned_customers"),
            ratio(F.sum(money), row_count()).alias("avg_revenue"),
        )
        .select("*", F.explode(F.array(*cases)).alias("c"))
    )
    retained = (F.col("churned_customers").cast("double") * F.col("c.rate")).cast("long")
    cost = F.col("customers_retained").cast("double") * float(cost_per_customer)
    recovered = F.col("customers_retained").cast("double") * F.col("avg_revenue")
    roi = F.coalesce(F.try_divide(F.col("recovered") - F.col("cost"), F.col("cost")) * 100.0, F.lit(0.0))
    return (
        totals.withColumn("customers_retained", retained)
        .withColumn("recovered", recovered)
        .withColumn("cost", cost)
        .select(
            *by,
            F.col("c.name").alias("scenario"),
            F.col("c.rate").alias("churn_reduction"),
            "total_customers",
            "churned_customers",
            round_to(F.col("churned_customers").cast("double") * F.col("avg_revenue"), 2).alias("revenue_at_risk"),
            "customers_retained",
            round_to("recovered", 2).alias("revenue_recovered"),
            "cost",
            round_to(roi, 2).alias("roi_pct"),
        )
    )


def marketing_recommendations(distribution: DataFrame, metrics: DataFrame) -> DataFrame:
    """Recommendations whose text occurs in a segment label, and one when churn is above half.

    Both inputs are small: one row per segment, and one row.
    """
    label = F.col("segment")
    found = distribution.agg(
        *[F.max(F.when(label.ilike(f"%{text}%"), 1)).alias(f"rule_{i}") for i, (text, *_) in enumerate(dim.RECOMMENDATION_RULES)]
    )

    def entry(values: Sequence[str]) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("segment", "action", "priority"), values)])

    rules = [F.when(F.col(f"rule_{i}") == 1, entry(rest)) for i, (_, *rest) in enumerate(dim.RECOMMENDATION_RULES)]
    rules.append(F.when(F.col("churn_rate_pct") > dim.CHURN_ALERT_PCT, entry(dim.CHURN_RECOMMENDATION)))
    return (
        found.crossJoin(F.broadcast(metrics.select("churn_rate_pct")))
        .select(F.explode(F.array_compact(F.array(*rules))).alias("r"))
        .select("r.segment", "r.action", "r.priority")
    )
