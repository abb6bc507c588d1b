"""Customer-facing outputs from the fitted model's probability."""

import glob

import pyarrow.parquet as pq
import pytest

from conftest import rows
from mercantile.ml.features import prepare_churn
from mercantile.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    w, plans = registry.warehouse(spark, FOLDER), registry._models()
    return lambda name: plans[name](w).collect()


def test_model_outputs(found):
    assert {n for n in registry.all_queries()} >= {"ml_churn_riskiest", "ml_churn_predictions", "ml_churn_predictions_high", "ml_customer_detail"}
    scores = {r["customer_unique_id"]: r["churn_probability"] for r in found("ml_churn_score")}
    assert len(set(scores.values())) > 20
    split = found("ml_churn_risk_split")[0]
    assert split["high_risk_customers"] == sum(p > 0.5 for p in scores.values())
    assert split["low_risk_customers"] == sum(p <= 0.5 for p in scores.values())

    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in found("ml_churn_riskiest")] == ranked[:5]
    assert [tuple(r) for r in found("ml_churn_predictions")] == ranked[:100]
    bands = {"high": lambda p: p >= 0.6, "medium": lambda p: 0.3 <= p < 0.6, "low": lambda p: p < 0.3}
    for band, holds in bands.items():
        assert [tuple(r) for r in found(f"ml_churn_predictions_{band}")] == [x for x in ranked if holds(x[1])][:100]
    totals = {r["risk_band"]: r["customers"] for r in found("ml_risk_band_totals")}
    assert totals == {b: n for b, holds in bands.items() if (n := sum(map(holds, scores.values())))}
    listed = {r["customer_unique_id"]: r["churn_probability"] for r in found("ml_high_risk_list")}
    assert listed == {i: pytest.approx(p, abs=1e-6) for i, p in scores.items() if p >= 0.6}

    detail = {r["customer_unique_id"]: r["model_risk"] for r in found("ml_customer_detail")}
    assert detail and any(detail.values())
    assert detail == {i: scores.get(i) for i in detail}


def test_customers_are_scored_in_the_order_of_their_features(spark):
    w = registry.warehouse(spark, FOLDER)
    got, model = w.model_probability, w.churn_model
    plain = model.score(prepare_churn(w.churn_raw, model.features, w.scratch))
    assert rows(got, *sorted(got.columns)) == rows(plain, *sorted(got.columns))
    for path in glob.glob(f"{w.scratch.folder.removeprefix('file:')}/model_probability-*/*.parquet"):
        held = [tuple(r.values()) for r in pq.read_table(path, columns=model.features).select(model.features).to_pylist()]
        assert len(held) > 20 and held == sorted(held)
        assert held != [tuple(r[f] for f in model.features) for r in plain.collect()]
