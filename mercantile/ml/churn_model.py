"""Churn classifier: weights, fit, score, evaluation, cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.functions.expressions import risk_level
from mercantile.ml import metrics, split
from mercantile.ml.features import churn_feature_names, prepare_churn
from mercantile.ml.importances import feature_importances
from mercantile.ml.parallel import FIT_PARTITIONS, FOREST, spread, together
from mercantile.ml.store import ModelStore
from mercantile.sources.scratch import Scratch

LABEL = "churn_label"
KEY = "customer_unique_id"


@dataclass
class ChurnModel:
    """A fitted classifier with its feature list; ``pipeline`` is None when only one class was seen."""

    features: list[str]
    pipeline: PipelineModel | None
    only_class: float = 0.0

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, ``churn_probability`` and ``risk_level``."""
        if self.pipeline is None:
            scored = df.withColumn("prediction", F.lit(self.only_class)).withColumn("churn_probability", F.lit(0.5))
        else:
            scored = (
                self.pipeline.transform(df)
                .withColumn("churn_probability", vector_to_array("probability")[1])
                .drop("features", "rawPrediction", "probability")
            )
        return scored.withColumn("risk_level", risk_level("churn_probability"))

    def importances(self, df: DataFrame) -> DataFrame:
        """Importance per feature, largest first."""
        return feature_importances(df.sparkSession, self.pipeline, self.features)


def balanced(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Adds the balanced class weight to every row; there is one weight per class."""
    weights = metrics.class_weights(train, label).select(label, "class_weight")
    return train.join(F.broadcast(weights), label)


def fit(
    train: DataFrame,
    features: Sequence[str],
    handle_imbalance: bool = True,
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
    partitions: int = FIT_PARTITIONS,
    store: ModelStore | None = None,
) -> ChurnModel:
    """Random forest over the assembled features; a stored one if ``store`` knows it. Trees need no scaling."""
    classes = [r[0] for r in train.select(LABEL).distinct().limit(2).collect()]
    if len(classes) < 2:
        return ChurnModel(list(features), None, float(classes[0]) if classes else 0.0)
    dealt = spread(train, KEY, partitions=partitions)
    rows = balanced(dealt) if handle_imbalance else dealt.withColumn("class_weight", F.lit(1.0))
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol=LABEL,
        weightCol="class_weight",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=2,
        maxMemoryInMB=512,
        seed=seed,
        **FOREST,
    )
    stages = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest])
    if store is None:
        return ChurnModel(list(features), stages.fit(rows))
    settings = {"imbalance": handle_imbalance, "trees": trees, "depth": depth, "seed": seed, "partitions": partitions}
    return ChurnModel(list(features), store.fitted("churn", train, [KEY, LABEL, *features], settings, lambda: stages.fit(rows)))


def prepared_split(
    customers: DataFrame,
    scratch: Scratch,
    exclude_time: bool = False,
    use_time_split: bool = False,
    test_share: float = 0.2,
) -> tuple[DataFrame, list[str]]:
    """Filled features with a train/test mark, stored: the fit reads them several times. Pass stored ``customers``."""
    features = churn_feature_names(customers.columns, exclude_time)
    filled = prepare_churn(customers, features, scratch)
    if use_time_split and "recency_days" in customers.columns:
        marked = split.by_recency(filled, KEY, scratch, test_share)
    else:
        marked = split.stratified(filled, KEY, LABEL, scratch, test_share)
    return scratch.store(marked, "churn_split"), features


def fitted(
    customers: DataFrame,
    scratch: Scratch,
    exclude_time: bool = False,
    use_time_split: bool = False,
    handle_imbalance: bool = True,
    test_share: float = 0.2,
    trees: int = 100,
    partitions: int = FIT_PARTITIONS,
    store: ModelStore | None = None,
) -> tuple[ChurnModel, DataFrame]:
    """The model of the train part, and the customers with their part. Nothing is evaluated."""
    marked, features = prepared_split(customers, scratch, exclude_time, use_time_split, test_share)
    return fit(marked.where("split = 'train'"), features, handle_imbalance, trees, partitions=partitions, store=store), marked


def train(
    customers: DataFrame,
    scratch: Scratch,
    exclude_time: bool = False,
    use_time_split: bool = False,
    handle_imbalance: bool = True,
    test_share: float = 0.2,
    trees: int = 100,
    partitions: int = FIT_PARTITIONS,
    store: ModelStore | None = None,
) -> tuple[ChurnModel, DataFrame]:
    """Fit on the train part; the second result holds (metric, value) rows for the test part."""
    model, marked = fitted(customers, scratch, exclude_time, use_time_split, handle_imbalance, test_share, trees, partitions, store)
    tested = scratch.store(model.score(marked.where("split = 'test'")), "churn_tested")
    sizes = marked.agg(
        F.count_if(F.col("split") == "train").alias("train_samples"),
        F.count_if(F.col("split") == "test").alias("test_samples"),
    )
    quality = (
        metrics.binary_metrics(tested)
        .crossJoin(F.broadcast(metrics.ranking_metrics(tested, scratch, score="churn_probability")))
        .crossJoin(F.broadcast(sizes))
    )
    return model, metrics.as_rows(quality)


def cross_validate(
    customers: DataFrame,
    scratch: Scratch,
    folds: int = 5,
    exclude_time: bool = False,
    trees: int = 100,
    partitions: int = FIT_PARTITIONS,
    store: ModelStore | None = None,
) -> DataFrame:
    """F1 per fold, folds stratified by class, with its mean and population deviation."""
    features = churn_feature_names(customers.columns, exclude_time)
    filled = split.stratified_folds(prepare_churn(customers, features, scratch), KEY, LABEL, scratch, folds)
    stored = scratch.store(filled, "churn_folds")

    def score(fold: int) -> DataFrame:
        held_out = F.col("fold") == fold
        model = fit(stored.where(~held_out), features, trees=trees, partitions=partitions, store=store)
        return metrics.binary_metrics(model.score(stored.where(held_out))).select(F.lit(fold).alias("fold"), "f1_score")

    found = together(customers.sparkSession, [partial(score, fold) for fold in range(folds)])
    scores = scratch.store(reduce(DataFrame.unionByName, found), "churn_scores")
    overall = scores.agg(F.avg("f1_score").alias("cv_f1_mean"), F.stddev_pop("f1_score").alias("cv_f1_std"))
    return scores.crossJoin(F.broadcast(overall))


def ablation(
    customers: DataFrame,
    scratch: Scratch,
    use_time_split: bool = False,
    trees: int = 100,
    partitions: int = FIT_PARTITIONS,
    store: ModelStore | None = None,
) -> DataFrame:
    """Metrics of the full model beside those of the model without time features."""
    parts = []
    for name, exclude in (("full", False), ("without_time", True)):
        _, rows = train(customers, scratch, exclude, use_time_split, trees=trees, partitions=partitions, store=store)
        parts.append(rows.select(F.lit(name).alias("model"), "metric", "value"))
    return parts[0].unionByName(parts[1])
