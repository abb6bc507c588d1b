"""Quantiles by refinement, positions and stratified folds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mercantile.ml import churn_model, features, split
from mercantile.operators import ordering
from mercantile.operators.ordering import add_positions, quantile_values, values_at_ranks

KINDS = {
    "even": lambda pick: pick.uniform(-500, 500),
    "sizes": lambda pick: pick.choice([-1, 1]) * 10.0 ** pick.randint(-300, 300),
    "ties": lambda pick: float(pick.choice([0, 0, 0, 1, 7])),
    "close": lambda pick: 1e9 + pick.randint(0, 5) * 1e-7,
    "tiny": lambda pick: pick.randint(0, 3) * 5e-324,
    "endless": lambda pick: pick.choice([float("inf"), float("-inf"), 1.7e308, -1.7e308, 0.0, 3.0]),
    "one": lambda pick: 4.25,
}


@pytest.mark.parametrize("kind", KINDS)
def test_every_rank_is_exact(spark, scratch, kind):
    pick = random.Random(7)
    data = [KINDS[kind](pick) for _ in range(700)]
    df = scratch.store(spark.createDataFrame([(x,) for x in data] + [(None,), (float("nan"),)], "x double"), "rows")
    wanted = [0, 1, 13, 350, 349, 698, 699]
    got = values_at_ranks(df, {"x": F.col("x")}, lambda _, n: wanted if n == 700 else [])
    assert got["x"] == {r: sorted(data)[r] for r in wanted}


def test_two_or_three_passes_for_most_columns(spark, scratch, monkeypatch):
    pick = random.Random(1)
    df = scratch.store(spark.createDataFrame([(pick.uniform(0, 1e6), pick.randint(0, 50)) for _ in range(5000)], "a double, b long"), "rows")
    passes, plain = [], ordering._bucket
    monkeypatch.setattr(ordering, "_bucket", lambda v, lo, hi, log: passes.append((lo, hi, log)) or plain(v, lo, hi, log))
    got = quantile_values(df, {"m": ("a", 0.5), "n": ("b", 0.25)})
    pdf = df.toPandas()
    assert got == {"m": pytest.approx(pdf.a.quantile(0.5)), "n": pdf.b.quantile(0.25)}
    assert len({log for *_, log in passes}) <= 2 and len(passes) <= 7  # intervals of all passes: 2 + 2 ranks at first


def test_no_values_are_shuffled(spark, scratch, monkeypatch):
    """What tasks send is at most a row per bucket and interval, whatever the number of values."""
    df = scratch.store(spark.range(200_000).select((F.rand(3) * 1e6).alias("x")), "rows")
    seen, plain = [], type(df).groupBy

    def spied(self, *columns):
        if columns:
            seen.append((self, columns))
        return plain(self, *columns)

    monkeypatch.setattr(type(df), "groupBy", spied)
    quantile_values(df, {"q": ("x", 0.9)})
    assert seen and all(columns == ("i", "bucket") for _, columns in seen)
    first = plain(seen[0][0], "i", "bucket").count()
    assert first.count() <= ordering.QUANTILE_BUCKETS
    assert "partial_count" in first._jdf.queryExecution().executedPlan().toString()


def test_columns_without_nulls_are_not_read_again(spark, scratch, monkeypatch):
    df = scratch.store(spark.createDataFrame([(1.0, 2), (3.0, None), (8.0, 4)], "a double, b int"), "rows")
    asked, plain = [], features.quantile_values
    monkeypatch.setattr(features, "quantile_values", lambda d, wanted, s: asked.append(set(wanted)) or plain(d, wanted, s))
    got = features.impute_median(df, ["a", "b"], scratch).orderBy("a").collect()
    assert asked == [{"b"}] and [tuple(r) for r in got] == [(1.0, 2.0), (3.0, 3.0), (8.0, 4.0)]


@pytest.mark.parametrize("within", [None, "kind"])
def test_positions_equal_a_window(spark, scratch, within):
    pick = random.Random(2)
    df = spark.createDataFrame([(k, pick.randint(0, 9), pick.choice(["a", "b", None])) for k in range(500)], "id long, score int, kind string")
    got = add_positions(df, F.col("score"), "id", scratch, within, "int")
    order = (Window.partitionBy("kind") if within else Window.partitionBy(F.lit(1))).orderBy("score", "id")
    want = df.withColumn("want", F.row_number().over(order) - 1)
    assert got.columns == [*df.columns, "position"]
    assert got.join(want.select("id", "want"), "id").where("position <> want").count() == 0 and got.count() == 500
    assert add_positions(df.limit(0), F.col("score"), "id", scratch).count() == 0


def test_folds_are_stratified(spark, scratch):
    df = spark.range(997).select(F.col("id"), F.when(F.col("id") % 90 == 0, 1).otherwise(0).alias("label"))
    counts = split.stratified_folds(df, "id", "label", scratch, 5).groupBy("label").pivot("fold", list(range(5))).count().collect()
    for row in counts:
        sizes = row[1:]
        assert max(sizes) - min(sizes) <= 1 and min(sizes) >= 2


def test_cross_validation_has_a_rare_class_in_every_fold(spark, scratch):
    rows = [(k, 1 if k % 24 == 0 else 0, float(k % 24 == 0) + k % 3 * 0.1, float(k), 0.0, 0.0, 0.0) for k in range(120)]
    df = spark.createDataFrame(rows, "customer_unique_id long, churn_label int, frequency double, monetary double, avg_review_score double, late_delivery_rate double, recency_days double")
    got = churn_model.cross_validate(df, scratch, folds=5, trees=5).collect()
    assert len(got) == 5 and all(r["f1_score"] == 1.0 for r in got)
    assert math.isclose(got[0]["cv_f1_mean"], np.mean([r["f1_score"] for r in got]))
