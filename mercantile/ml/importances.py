"""Importances of a fitted forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feature_importances(spark: SparkSession, pipeline: PipelineModel | None, features: Sequence[str]) -> DataFrame:
    """(feature, importance), largest first; a row per feature. Without a model all are 0."""
    values = [0.0] * len(features)
    if pipeline is not None:
        values = pipeline.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(features, values, strict=True))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
