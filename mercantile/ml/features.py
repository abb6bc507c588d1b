"""Model inputs: which columns, filled and scaled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.operators.ordering import quantile_values
from mercantile.sources.scratch import Scratch

# Feature names and their order.
CHURN_FEATURES = [
    "recency_days",
    "frequency",
    "monetary",
    "tenure_days",
    "avg_review_score",
    "late_delivery_rate",
    "credit_card_rate",
    "avg_installments",
]
CHURN_FEATURES_WITHOUT_TENURE = ["recency_days", "frequency", "monetary", "avg_review_score", "late_delivery_rate"]
TIME_FEATURES = ["recency_days", "tenure_days"]
CLV_FEATURES = ["frequency", "monetary", "avg_order_value", "customer_tenure_days", "total_orders"]
CLV_FALLBACK = ["frequency", "monetary"]


def churn_feature_names(columns: Sequence[str], exclude_time: bool = False) -> list[str]:
    """Churn features that a frame offers, optionally without those that restate the label."""
    wanted = CHURN_FEATURES if "tenure_days" in columns else CHURN_FEATURES_WITHOUT_TENURE
    dropped = TIME_FEATURES if exclude_time else []
    return [f for f in wanted if f in columns and f not in dropped]


def clv_feature_names(columns: Sequence[str]) -> list[str]:
    found = [f for f in CLV_FEATURES if f in columns]
    return found if len(found) >= 3 else CLV_FALLBACK


def impute_median(df: DataFrame, features: Sequence[str], scratch: Scratch) -> DataFrame:
    """NULL features become the exact median of their column. Pass a stored ``df``: columns with NULLs are read again."""
    holes = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    medians = quantile_values(df, {f: (f, 0.5) for f in features if holes[f]}, scratch)
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(medians.get(f))) for f in features})


def prepare_churn(df: DataFrame, features: Sequence[str], scratch: Scratch, label: str = "churn_label") -> DataFrame:
    """Features filled with medians, missing labels with 0."""
    return impute_median(df, features, scratch).withColumn(label, F.coalesce(F.col(label), F.lit(0)).cast("double"))


def standardize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features minus mean, over population deviation; a constant feature becomes 0."""
    stats = df.agg(
        *[F.avg(f).alias(f"{f}__mean") for f in features], *[F.stddev_pop(f).alias(f"{f}__std") for f in features]
    )
    scaled = {
        f: (F.col(f).cast("double") - F.col(f"{f}__mean"))
        / F.when(F.col(f"{f}__std") > 0, F.col(f"{f}__std")).otherwise(1.0)
        for f in features
    }
    extra = [f"{f}__{s}" for f in features for s in ("mean", "std")]
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*extra)


def clv_training_set(
    df: DataFrame, features: Sequence[str], scratch: Scratch, target: str = "total_revenue", top: float = 0.99
) -> DataFrame:
    """Filled features and target, without the rows at or above the ``top`` quantile of the target."""
    columns = list(dict.fromkeys([*features, target]))
    filled = impute_median(df, columns, scratch)
    # The quantile is taken over the filled target.
    limit = quantile_values(filled, {"limit": (target, top)}, scratch)["limit"]
    return filled.where(F.col(target) < F.lit(limit))
