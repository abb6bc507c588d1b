"""Revenue forecast by a regression forest over all series at once."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercantile.ml import metrics
from mercantile.ml.importances import feature_importances
from mercantile.ml.parallel import FIT_PARTITIONS, FOREST, spread
from mercantile.ml.store import ModelStore
from mercantile.operators.revenue import rolling, rolling_mean
from mercantile.sources.scratch import Scratch

# The features the forest uses, in order.
FEATURES = ["lag_1", "lag_2", "lag_3", "rolling_mean_3", "rolling_mean_6", "month_sin", "month_cos", "trend"]
TARGET = "revenue"


def season(month_number: Column) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * month_number / F.lit(12.0)
    return F.sin(angle), F.cos(angle)


def forecast_features(monthly: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Lags, rolling figures, season and trend per month.

    The rolling figures include the month itself, so they know part of the target. Lag 6 and
    the rolling deviation are computed but not used by the forest.
    """
    ordered = Window.partitionBy(*series).orderBy("month")
    value = F.col("revenue").cast("double")
    sine, cosine = season(F.month("month"))
    deviation = rolling(lambda frame: F.stddev_samp(value).over(frame), "revenue", 3, ordered)
    return monthly.select(
        *series,
        "month",
        value.alias("revenue"),
        *[F.lag(value, n).over(ordered).alias(f"lag_{n}") for n in (1, 2, 3, 6)],
        rolling_mean("revenue", 3, ordered).alias("rolling_mean_3"),
        rolling_mean("revenue", 6, ordered).alias("rolling_mean_6"),
        deviation.alias("rolling_std_3"),
        F.month("month").alias("month_num"),
        sine.alias("month_sin"),
        cosine.alias("month_cos"),
        (F.row_number().over(ordered) - 1).alias("trend"),
    )


@dataclass
class ForecastModel:
    pipeline: PipelineModel
    last: DataFrame
    series: tuple[str, ...]

    def importances(self, df: DataFrame) -> DataFrame:
        """Importance per feature, largest first."""
        return feature_importances(df.sparkSession, self.pipeline, FEATURES)

    def forecast(self, months_ahead: int = 6) -> DataFrame:
        """Recursive forecast: each step scores all series once and feeds its result into the lags.

        The first step scores the features of the last known month. Dates follow that month. The
        values found so far travel along as columns, so the whole forecast is one chain of steps.
        """
        state, known = self.last, []
        for step in range(1, months_ahead + 1):
            value = f"value_{step}"
            scored = self.pipeline.transform(state).withColumnRenamed("prediction", value)
            known.append(value)
            sine, cosine = season(F.month(F.add_months("last_month", step + 1)))
            mean_3 = (F.col("last_revenue") + F.col("lag_1") + F.col(value)) / 3.0
            state = scored.select(
                *self.series,
                "last_month",
                *known,
                F.col("last_revenue").alias("lag_1"),
                F.col("lag_1").alias("lag_2"),
                F.col("lag_2").alias("lag_3"),
                mean_3.alias("rolling_mean_3"),
                ((mean_3 + F.col("lag_1") + F.col("lag_2")) / 3.0).alias("rolling_mean_6"),
                sine.alias("month_sin"),
                cosine.alias("month_cos"),
                (F.col("trend") + 1).alias("trend"),
                F.col(value).alias("last_revenue"),
            )
        steps = F.posexplode(F.array(*[F.col(v) for v in known])).alias("at", "forecasted_revenue")
        return state.select(*self.series, "last_month", steps).select(
            *self.series,
            F.add_months("last_month", F.col("at") + 1).alias("month"),
            (F.col("at") + 1).alias("forecast_horizon"),
            "forecasted_revenue",
        )


def train(
    monthly: DataFrame,
    scratch: Scratch,
    series: Sequence[str] = (),
    test_share: float = 0.2,
    trees: int = 100,
    partitions: int = FIT_PARTITIONS,
    store: ModelStore | None = None,
) -> tuple[ForecastModel, DataFrame]:
    """Fit on the first part of every series; the second result holds metrics for the rest."""
    whole = Window.partitionBy(*series)
    rows = (
        forecast_features(monthly, series)
        .fillna(0.0, subset=[*FEATURES, TARGET])
        .withColumn("months", F.count(F.lit(1)).over(whole))
        .withColumn("is_test", F.col("trend") >= F.floor(F.col("months").cast("double") * (1 - test_share)))
    )
    rows = scratch.store(rows, "forecast_rows")
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=TARGET, numTrees=trees, maxDepth=10, seed=42, maxMemoryInMB=512, **FOREST
    )
    stages = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest])
    known = rows.where("NOT is_test")

    def fit() -> PipelineModel:
        return stages.fit(spread(known, *series, "month", partitions=partitions))

    columns, settings = [*series, "month", *FEATURES, TARGET], {"trees": trees, "partitions": partitions}
    pipeline = fit() if store is None else store.fitted("forecast", known, columns, settings, fit)
    quality = metrics.regression_metrics(pipeline.transform(rows.where("is_test")), TARGET, "prediction")
    last = (
        rows.where(F.col("trend") == F.col("months") - 1)
        .withColumn("last_month", F.col("month"))
        .withColumn("last_revenue", F.col(TARGET))
        .select(*series, "last_month", "last_revenue", *FEATURES)
    )
    return ForecastModel(pipeline, last, tuple(series)), metrics.as_rows(quality)
