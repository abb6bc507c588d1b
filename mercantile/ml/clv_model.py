"""Lifetime-value regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.functions.expressions import ltv_level
from mercantile.ml import metrics, split
from mercantile.ml.features import clv_feature_names, clv_training_set, impute_median
from mercantile.ml.importances import feature_importances
from mercantile.ml.parallel import FIT_PARTITIONS, FOREST, spread
from mercantile.ml.store import ModelStore
from mercantile.sources.scratch import Scratch

TARGET = "total_revenue"
KEY = "customer_unique_id"


def clv_customers(retention_base: DataFrame) -> DataFrame:
    """Customer columns under the names the model looks for; tenure runs to the last known recency day."""
    tenure = F.datediff(F.to_date("last_order_date"), F.to_date("first_order_date")) + F.col("recency_days")
    return retention_base.select(
        KEY,
        F.col("total_orders").cast("double").alias("frequency"),
        F.col("total_revenue").cast("double").alias("monetary"),
        "avg_order_value",
        tenure.cast("double").alias("customer_tenure_days"),
        F.col("total_orders").cast("double").alias("total_orders"),
        F.col("total_revenue").cast("double").alias(TARGET),
    )


@dataclass
class ClvModel:
    features: list[str]
    pipeline: PipelineModel

    def score(self, customers: DataFrame, scratch: Scratch) -> DataFrame:
        """Predicted lifetime value and its level per customer."""
        filled = impute_median(customers, self.features, scratch)
        predicted = self.pipeline.transform(filled).select(KEY, F.col("prediction").alias("predicted_ltv"))
        return predicted.withColumn("ltv_segment", ltv_level("predicted_ltv"))

    def importances(self, df: DataFrame) -> DataFrame:
        """Importance per feature, largest first."""
        return feature_importances(df.sparkSession, self.pipeline, self.features)


def fitted(
    customers: DataFrame,
    scratch: Scratch,
    test_share: float = 0.2,
    trees: int = 100,
    partitions: int = FIT_PARTITIONS,
    store: ModelStore | None = None,
) -> tuple[ClvModel, DataFrame]:
    """The model fitted without the largest customers and the test part, and the customers with their part."""
    features = clv_feature_names(customers.columns)
    kept = scratch.store(clv_training_set(customers, features, scratch, TARGET), "clv_rows")
    marked = split.stratified(kept.withColumn("one_class", F.lit(0)), KEY, "one_class", scratch, test_share)
    marked = scratch.store(marked, "clv_split")
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=TARGET, numTrees=trees, maxDepth=8, seed=42, maxMemoryInMB=512, **FOREST
    )
    stages = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest])
    rows = marked.where("split = 'train'")

    def fit() -> PipelineModel:
        return stages.fit(spread(rows, KEY, partitions=partitions))

    columns, settings = list(dict.fromkeys([KEY, *features, TARGET])), {"trees": trees, "partitions": partitions}
    return ClvModel(features, fit() if store is None else store.fitted("clv", rows, columns, settings, fit)), marked


def train(
    customers: DataFrame,
    scratch: Scratch,
    test_share: float = 0.2,
    trees: int = 100,
    partitions: int = FIT_PARTITIONS,
    store: ModelStore | None = None,
) -> tuple[ClvModel, DataFrame]:
    """Fit without the largest customers; the second result holds metrics for the test part."""
    model, marked = fitted(customers, scratch, test_share, trees, partitions, store)
    tested = model.pipeline.transform(marked.where("split = 'test'"))
    quality = metrics.as_rows(metrics.regression_metrics(tested, TARGET, "prediction"))
    return model, quality.where("metric <> 'mape'")
