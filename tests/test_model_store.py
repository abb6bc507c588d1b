"""Fitted models are stored under what they were fitted on, and loaded by later queries."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from mercantile.functions.fingerprint import fingerprint
from mercantile.ml import churn_model, clv_model, features, forecast_model
from mercantile.ml.store import ModelStore
from mercantile.plans import registry
from mercantile.plans.warehouse import Warehouse

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def fits(monkeypatch):
    made, plain = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, *a, **k: made.append(1) or plain(self, *a, **k))
    return made


def customers(spark, n=200):
    return spark.range(n).select(
        F.col("id").alias("customer_unique_id"),
        (F.col("id") % 3 == 0).cast("int").alias("churn_label"),
        *[((F.col("id") * k) % 17).cast("double").alias(f) for k, f in enumerate(features.CHURN_FEATURES, 1)],
    )


def test_ten_queries_fit_one_model(spark, tmp_path, fits, monkeypatch):
    monkeypatch.setattr(Warehouse, "models", property(lambda w: ModelStore(spark, str(tmp_path)), lambda w, v: None), raising=False)
    plans, found = registry._models(), {}
    names = [n for n in plans if n.startswith("ml_churn_predictions") or n in {"ml_churn_score", "ml_churn_riskiest", "ml_churn_risk_split", "ml_risk_band_totals", "ml_high_risk_list", "ml_customer_detail"}]
    assert len(names) == 10
    for name in names:
        found[name] = plans[name](registry.warehouse(spark, FOLDER)).count()  # a warehouse of its own for each
    assert len(fits) == 1 and all(found[n] for n in ("ml_churn_score", "ml_customer_detail"))


def test_a_loaded_model_scores_alike(spark, scratch, tmp_path, fits):
    store, df = ModelStore(spark, str(tmp_path)), scratch.store(customers(spark), "customers")
    scores = []
    for rows in (df, scratch.store(df.repartition(7), "again")):
        model, _ = churn_model.fitted(rows, scratch, trees=5, store=store)
        scores.append({r["customer_unique_id"]: r["churn_probability"] for r in model.score(df).collect()})
    assert scores[0] == scores[1] and len(fits) == 1
    # Other rows, columns or settings are other models.
    churn_model.fitted(scratch.store(df.where("customer_unique_id > 40"), "fewer"), scratch, trees=5, store=store)
    churn_model.fitted(df, scratch, trees=6, store=store)
    churn_model.fitted(df, scratch, exclude_time=True, trees=5, store=store)
    churn_model.fitted(df, scratch, trees=5, partitions=3, store=store)
    assert len(fits) == 5


def test_a_half_written_model_is_not_loaded(spark, scratch, tmp_path, fits):
    store, df = ModelStore(spark, str(tmp_path)), scratch.store(customers(spark), "customers")
    churn_model.fitted(df, scratch, trees=3, store=store)
    (model,) = [p for p in tmp_path.iterdir() if p.name.startswith("churn-")]
    model.rename(f"{model}.draft")  # as a fit that was lost before its last step
    churn_model.fitted(df, scratch, trees=3, store=store)
    assert len(fits) == 2 and model.exists()


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 1)], "a int, b int")
    own = fingerprint(df, ["a", "b"])
    assert own == fingerprint(df.orderBy(F.desc("b")).repartition(3), ["a", "b"])
    assert own != fingerprint(df.limit(3), ["a", "b"])
    swapped = spark.createDataFrame([(1, None), (1, None), (1, 1), (1, 1)], "a int, b int")
    assert own != fingerprint(swapped, ["a", "b"])


def test_importances_of_every_forest(spark, scratch):
    people = spark.range(200).select(
        F.col("id").alias("customer_unique_id"), *[((F.col("id") * k) % 13).cast("double").alias(c) for k, c in enumerate(features.CLV_FEATURES, 1)], F.col("id").cast("double").alias("total_revenue")
    )
    model, _ = clv_model.train(people, scratch, trees=5)
    got = model.importances(people).collect()
    assert sorted(r["feature"] for r in got) == sorted(model.features) and sum(r["importance"] for r in got) == pytest.approx(1.0)
    monthly = spark.sql("SELECT add_months(DATE '2015-01-01', CAST(id AS INT)) AS month, CAST(100 + id % 12 AS DECIMAL(18,2)) AS revenue FROM range(40)")
    model, _ = forecast_model.train(monthly, scratch, trees=5)
    got = model.importances(monthly).collect()
    assert [r["feature"] for r in got] != [] and sum(r["importance"] for r in got) == pytest.approx(1.0)
    assert sorted(r["feature"] for r in got) == sorted(forecast_model.FEATURES)
