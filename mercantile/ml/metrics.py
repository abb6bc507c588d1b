"""Model quality as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercantile.functions.expressions import ratio, row_count
from mercantile.operators.ordering import running_totals
from mercantile.sources.scratch import Scratch


def class_weights(df: DataFrame, label: str = "churn_label") -> DataFrame:
    """Balanced weight per class: rows over (classes x rows of the class)."""
    everything = Window.partitionBy()
    return (
        df.groupBy(label)
        .agg(row_count().alias("rows"))
        .withColumn(
            "class_weight",
            F.sum("rows").over(everything).cast("double")
            / (F.count(F.lit(1)).over(everything) * F.col("rows")).cast("double"),
        )
    )


def _or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str = "churn_label", prediction: str = "prediction") -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 in one row; a zero division gives 0."""
    truth, said = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(truth & said).alias("tp"),
        F.count_if(~truth & said).alias("fp"),
        F.count_if(truth & ~said).alias("fn"),
        F.count_if(~truth & ~said).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp",
        "fp",
        "fn",
        "tn",
        _or_zero(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _or_zero(tp, tp + fp).alias("precision"),
        _or_zero(tp, tp + fn).alias("recall"),
        _or_zero(tp * 2, tp * 2 + fp + fn).alias("f1_score"),
    )


def ranking_metrics(df: DataFrame, scratch: Scratch, label: str = "churn_label", score: str = "probability") -> DataFrame:
    """ROC-AUC by rank sum (ties count half) and step-wise average precision, in one row.

    Rows are folded to one per score first. Cumulative counts then come from range-wise running
    totals, because distinct scores may be as many as customers. Both are NULL for a single class.
    """
    truth = F.col(label) == 1
    groups = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg")
    )
    totals = running_totals(groups, "score", ["pos", "neg"], scratch)
    pos, neg = F.col("pos"), F.col("neg")
    wide = "decimal(38,0)"
    # Twice the rank sum in whole numbers, so that its value does not depend on the order of summation.
    neg_below_twice = ((F.col("neg_upto") - neg) * 2 + neg).cast("decimal(19,0)")
    pos_from = F.col("pos_all") - F.col("pos_upto") + pos
    all_from = pos_from + F.col("neg_all") - F.col("neg_upto") + neg
    sums = totals.agg(
        F.sum((neg_below_twice * pos.cast("decimal(19,0)")).cast(wide)).alias("rank_sum"),
        F.sum(F.when(pos > 0, pos.cast("double") * ratio(pos_from, all_from))).alias("steps"),
        F.max("pos_all").alias("p"),
        F.max("neg_all").alias("n"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(
        F.when(
            both,
            F.try_divide(
                F.col("rank_sum").cast("double"), F.col("p").cast("double") * F.col("n").cast("double") * 2.0
            ),
        ).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("steps"), F.col("p").cast("double"))).alias("average_precision"),
    )


def regression_metrics(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """MAE, RMSE, MAPE (rows with target 0 left out) and R2 in one row."""
    y, error = F.col(target).cast("double"), F.col(target).cast("double") - F.col(prediction).cast("double")
    sums = df.agg(
        row_count().alias("rows"),
        F.sum(F.abs(error)).alias("abs_error"),
        F.sum(error * error).alias("square_error"),
        F.avg(F.when(y != 0, F.abs(error / F.when(y != 0, y)))).alias("relative_error"),
        F.var_pop(y).alias("variance"),
    )
    n = F.col("rows")
    return sums.select(
        "rows",
        ratio(F.col("abs_error"), n).alias("mae"),
        F.sqrt(ratio(F.col("square_error"), n)).alias("rmse"),
        (F.col("relative_error") * 100.0).alias("mape"),
        (F.lit(1.0) - ratio(F.col("square_error"), F.col("variance") * n)).alias("r2"),
    )


def as_rows(metrics: DataFrame) -> DataFrame:
    """A one-row bundle turned into (metric, value) rows."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics.columns]
    return metrics.select(F.explode(F.array(*pairs)).alias("p")).select("p.metric", "p.value")
