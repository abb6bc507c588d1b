"""Steps around a fit that grow with the customers: splits, weights, and fits that run at once."""

import glob
import random
import threading

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mercantile.ml import churn_model, parallel, split
from mercantile.operators.ordering import split_at_position
from mercantile.plans import registry
from mercantile.sources.retail import StarSchemaRetail
from test_models import customers


def stored_rows(spark, scratch, name):
    folders = glob.glob(f"{scratch.folder}/{name}-*")
    return sum(spark.read.parquet(f).count() for f in folders), len(folders)


def labelled(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))


def test_a_stratified_split_lays_out_few_rows(spark, scratch):
    df = labelled(spark, 6000)
    got = split.stratified(df, "k", "y", scratch)
    held, layouts = stored_rows(spark, scratch, "split")
    assert layouts == 1 and 0 < held < 60
    counts = {(r["y"], r["split"]): r["n"] for r in got.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, "test"): 800, (0, "train"): 3200, (1, "test"): 400, (1, "train"): 1600}


def test_a_stratified_split_is_that_of_all_rows_in_order(spark, scratch):
    df = labelled(spark, 1500).withColumn("y", F.when(F.col("k") % 50 == 0, None).otherwise(F.col("y")))
    df = df.unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS k, 1 AS y FROM range(2)"))
    whole = split_at_position(
        df, split.shuffled_key("k", 42), "k", lambda n: int(n * 0.2 + 0.5), scratch, ("test", "train"), "y", "string"
    )
    assert rows(split.stratified(df, "k", "y", scratch)) == rows(whole)


@pytest.mark.parametrize("days", ["ties", "missing", "one", "none"])
def test_a_split_by_recency_is_that_of_all_rows_in_order(spark, scratch, days):
    pick = random.Random(3)
    made = {
        "ties": [pick.randint(-90, 400) // 7 * 7 for _ in range(700)],
        "missing": [None if pick.random() < 0.9 else pick.randint(-40, 40) for _ in range(300)],
        "one": [31] * 100,
        "none": [],
    }[days]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(made)], "k long, recency_days int")
    for share in (0.2, 1.0):
        whole = split_at_position(df, F.col("recency_days"), "k", lambda n: int(n * (1 - share)), scratch)
        assert rows(split.by_recency(df, "k", scratch, share)) == rows(whole)


def test_filled_customers_are_not_stored_twice(spark, scratch):
    churn_model.prepared_split(customers(spark), scratch, exclude_time=True)
    assert stored_rows(spark, scratch, "churn_split") == (300, 1)
    assert stored_rows(spark, scratch, "churn_filled") == (0, 0)


def test_jobs_together_overlap_and_keep_their_order(spark):
    meet = threading.Barrier(2, timeout=60)

    def job(k):
        meet.wait()
        return spark.range(k).count()

    assert parallel.together(spark, [lambda k=k: job(k) for k in range(4)]) == [0, 1, 2, 3]


def test_two_folds_are_fitted_at_once_with_the_same_scores(spark, scratch, monkeypatch):
    meet, plain, together = threading.Barrier(2, timeout=120), churn_model.fit, churn_model.together

    def fit(*args, **kwargs):
        meet.wait()
        return plain(*args, **kwargs)

    df = scratch.store(customers(spark, 200), "people")
    monkeypatch.setattr(churn_model, "together", lambda spark, jobs: [job() for job in jobs])
    one_by_one = rows(churn_model.cross_validate(df, scratch, folds=2, trees=3))
    monkeypatch.setattr(churn_model, "together", together)
    monkeypatch.setattr(churn_model, "fit", fit)
    assert rows(churn_model.cross_validate(df, scratch, folds=2, trees=3)) == one_by_one


def test_importance_totals_take_the_order_facts_once(spark, monkeypatch):
    asked, plain = [], StarSchemaRetail.order_facts
    monkeypatch.setattr(StarSchemaRetail, "order_facts", lambda self, *a, **k: asked.append(a) or plain(self, *a, **k))
    got = rows(registry.all_queries()["ml_importance_totals"](spark, "/root/testdata/sf0.001"))
    assert got == [("churn", 6, 1.0, 0), ("clv", 5, 1.0, 0), ("forecast", 8, 1.0, 0)]
    assert len(asked) == 1
