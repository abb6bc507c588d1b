import pytest
from conftest import rows
from pyspark.sql import functions as F

from mercantile.functions import expressions as X
from mercantile.operators import campaigns, rfm, scoring

FIELDS = "monetary double, frequency int, avg_review_score double, avg_installments double, credit_card_rate double, late_delivery_rate double"


def values(spark, expression, *inputs):
    return [spark.range(1).select(expression(F.lit(x))).first()[0] for x in inputs]


def test_bins_are_right_closed(spark):
    assert values(spark, X.risk_level, 0.0, 0.2, 0.4, 0.6, 0.61, 1.0) == ["Low", "Low", "Medium", "High", "Critical", "Critical"]
    assert values(spark, X.ltv_level, -5.0, 100.0, 500.0, 1000.0, 1000.01) == ["Low", "Low", "Medium", "High", "Premium"]
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) p").select(X.risk_level("p")).first()[0] is None


def test_score_bands_are_left_closed(spark):
    got = values(spark, X.score_segment, 0.09, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85)
    assert got == ["Champions", "Loyal Customers", "Potential Loyalist", "New Customers", "At Risk", "Cant Lose Them", "Lost"]


@pytest.mark.parametrize(
    "scores,segment",
    [
        ((5, 4, 4), "Champions"),
        ((5, 4, 3), "Loyal Customers"),
        ((4, 5, 5), "Loyal Customers"),
        ((5, 2, 5), "New Customers"),
        ((5, 3, 1), "Potential Loyalists"),
        ((4, 4, 2), "Potential Loyalists"),
        ((3, 3, 1), "Need Attention"),
        ((2, 4, 4), "Lost High Value"),
        ((2, 4, 3), "Hibernating"),
        ((1, 1, 1), "Hibernating"),
        ((4, 2, 5), "Others"),
        ((3, 2, 5), "Others"),
    ],
)
def test_first_segment_rule_wins(spark, scores, segment):
    assert spark.createDataFrame([scores], "r int, f int, m int").select(X.rfm_segment("r", "f", "m")).first()[0] == segment


def people(spark):
    return spark.createDataFrame(
        [
            ("a", 0, 5, 100.0, "Champions"),
            ("b", 90, 1, 50.0, "Potential Loyalists"),
            ("c", 400, 2, 10.0, "Lost"),
            ("d", 180, 1, 10.0, "Unheard Of"),
            ("e", 10, 1, 30.0, None),
        ],
        "customer_unique_id string, recency_days int, frequency long, monetary double, rfm_segment string",
    )


def test_risk_by_segment(spark):
    got = {r["customer_unique_id"]: r for r in scoring.customer_list(people(spark)).collect()}
    # Risk is capped at 1; an unknown segment starts from one half; the plural label is an alias.
    assert [got[c]["churn_risk"] for c in "abcde"] == [0.05, 0.22, 1.0, 0.6, 0.506]
    assert got["a"]["ltv_estimate"] == pytest.approx(150.0)
    assert [r[0] for r in scoring.customer_list(people(spark), "Lost").collect()] == ["c"]


def test_pages(spark):
    listed = scoring.customer_list(people(spark))
    assert [r[0] for r in scoring.page(listed, "customer_unique_id", 2, 1).collect()] == ["b", "c"]
    wide = spark.range(30)
    assert scoring.page(wide, "id", 20, 0, "starter").count() == 10
    assert scoring.page(wide, "id", 20, 0, "growth").count() == 20


def test_detail_by_ids(spark):
    ids = spark.createDataFrame([("b",), ("zz",), ("b",)], "customer_unique_id string")
    scored = people(spark).withColumns({s: F.lit(3) for s in ("r_score", "f_score", "m_score")})
    churned = spark.createDataFrame([("b", 1, 0.7)], "customer_unique_id string, churn_label int, churn_probability double")
    (got,) = scoring.customer_detail(scored, ids, churned).collect()
    assert (got["model_risk"], got["churn_label"], got["churn_risk"]) == (0.7, 1, 0.22)
    assert got["recommended_action"].startswith("Personalized")
    (bare,) = scoring.customer_detail(scored, ids).collect()
    assert bare["model_risk"] is None and bare["churn_label"] is None


def score(spark, *request):
    return scoring.score_requests(spark.createDataFrame([request], FIELDS)).collect()


def test_score_of_a_request(spark):
    (got,) = score(spark, 600.0, 5, 4.0, 3.0, 0.5, 0.1)
    p = ((1 - 0.6) + 0.25 + (1 - 0.8) + 0.5 + 0.1 + 0.5) / 6
    assert got["churn_risk_score"] == round(p, 3) and got["segment"] == "Potential Loyalist"
    assert got["ltv_estimate"] == pytest.approx(600 * 1.5 * (1 - p), abs=0.006)
    # The "bonus" lowers a full confidence to its cap.
    assert got["confidence"] == 0.95


def test_confidence(spark):
    assert score(spark, 500.0, 5, 4.0, 3.0, 0.5, 0.3)[0]["confidence"] == 1.0
    assert score(spark, 500.0, 5, 4.0, 3.0, 0.5, 0.31)[0]["confidence"] == 0.9
    assert score(spark, 501.0, 4, 4.0, 3.0, 0.5, 0.31)[0]["confidence"] == 0.85


def test_score_is_at_most_one(spark):
    assert score(spark, 1.0, 1, 0.0, 60.0, 0.0, 1.0)[0]["churn_risk_score"] == 1.0


@pytest.mark.parametrize(
    "field,request_",
    [
        ("monetary", (0.0, 1, 3.0, 1.0, 0.5, 0.5)),
        ("frequency", (1.0, 0, 3.0, 1.0, 0.5, 0.5)),
        ("avg_review_score", (1.0, 1, 5.1, 1.0, 0.5, 0.5)),
        ("avg_review_score", (1.0, 1, None, 1.0, 0.5, 0.5)),
        ("avg_installments", (1.0, 1, 3.0, 0.9, 0.5, 0.5)),
        ("credit_card_rate", (1.0, 1, 3.0, 1.0, 1.1, 0.5)),
        ("late_delivery_rate", (1.0, 1, 3.0, 1.0, 0.5, -0.1)),
    ],
)
def test_invalid_requests_are_set_aside(spark, field, request_):
    frame = spark.createDataFrame([request_], FIELDS)
    assert scoring.score_requests(frame).count() == 0
    assert scoring.rejected_requests(frame).first()["failed_fields"] == field


def test_bands_and_lists(spark):
    scored = scoring.segment_probability(people(spark))
    assert [r[0] for r in scoring.riskiest(scored, 2).collect()] == ["c", "d"]
    assert [r[0] for r in scoring.riskiest(scored, 9, "low").collect()] == ["b", "a"]
    assert [r[0] for r in scoring.riskiest(scored, 9, "medium").collect()] == ["e"]
    assert scoring.churn_risk_split(scored).first().asDict() == {"high_risk_customers": 3, "low_risk_customers": 2}
    assert rows(scoring.high_risk_list(scored), "customer_unique_id", "action")[1] == ("d", "General nurturing")


def test_campaign_defaults(spark):
    plan = campaigns.campaign_plan(people(spark).where("rfm_segment = 'Unheard Of'"), 100.0, {"radio": None, "sms": 0.95})
    got = {r["channel"]: r for r in plan.collect()}
    # One customer: seven tenths of one person is nobody.
    assert got["radio"]["estimated_reach"] == 0 and got["radio"]["roi"] == -100.0
    assert campaigns.campaign_plan(people(spark), 0.0).where("roi <> 0").count() == 0


def test_campaign_figures(spark):
    crowd = spark.range(10).select(F.lit("At Risk").alias("rfm_segment"), F.lit(100.0).alias("monetary"))
    got = campaigns.campaign_plan(crowd, 50.0, {"push": 0.7}).first()
    assert (got["segment_size"], got["estimated_reach"]) == (10, 7)
    assert got["expected_revenue"] == pytest.approx(7 * 0.05 * 100 * 2) and got["roi"] == 40.0


def test_scenarios(spark):
    crowd = spark.range(101).select((F.col("id") < 33).cast("int").alias("churn_label"), F.lit(50.0).alias("monetary"))
    got = {r["scenario"]: r for r in campaigns.retention_scenarios(crowd).collect()}
    assert [got[s]["customers_retained"] for s in ("Conservative", "Moderate", "Aggressive", "Targeted")] == [1, 3, 6, 9]
    assert (got["Moderate"]["revenue_recovered"], got["Moderate"]["cost"], got["Moderate"]["roi_pct"]) == (150.0, 75.0, 100.0)
    nobody = crowd.withColumn("churn_label", F.lit(0))
    assert {r["roi_pct"] for r in campaigns.retention_scenarios(nobody).collect()} == {0.0}


def test_recommendations(spark):
    segments = spark.createDataFrame([("champions of all",), ("Hibernating",), (None,)], "segment string")
    calm = spark.createDataFrame([(50.0,)], "churn_rate_pct double")
    alarm = spark.createDataFrame([(50.1,)], "churn_rate_pct double")
    assert rows(campaigns.marketing_recommendations(segments, calm), "segment") == [("Champions",), ("Hibernating",)]
    assert ("Churned Revenue",) in rows(campaigns.marketing_recommendations(segments, alarm), "segment")


def test_marketing_audiences(spark):
    assert rows(rfm.marketing_segments(people(spark))) == [("a", "champions"), ("b", "potential_loyalists"), ("c", "lost")]


def test_labels_from_segments(spark):
    crowd = spark.createDataFrame(
        [("a", 1, 1, 1.0, "Hibernating"), ("b", 1, 1, 1.0, "Lost High Value"), ("c", 1, 1, 1.0, "Champions")],
        "customer_unique_id string, recency_days int, frequency int, monetary double, rfm_segment string",
    )
    got = rows(rfm.churn_label_from_segment(crowd), "customer_unique_id", "churn_label", "avg_review_score", "late_delivery_rate")
    assert got == [("a", 1, 4.0, 0.1), ("b", 1, 4.0, 0.1), ("c", 0, 4.0, 0.1)]


def test_detail_risk_is_not_kept_below_one(spark):
    from mercantile.functions.expressions import segment_risk

    people = spark.createDataFrame([("Lost Low Value", 180), ("Lost Low Value", 0)], "s string, d int")
    open_, kept = (people.select(segment_risk("s", "d", kept=k).alias("r")).collect() for k in (False, True))
    assert open_[0]["r"] == pytest.approx(open_[1]["r"] * 1.2) and kept[0]["r"] == min(open_[0]["r"], 1.0)


def test_scored_and_rejected_requests_are_a_partition(spark):
    import __spark_entry__ as registry

    folder = "/root/testdata/sf0.001"
    found = [registry.queries()[n](spark, folder).select("customer_unique_id") for n in ("score_customers", "score_rejects", "churn_features")]
    scored, rejected, everyone = ({r[0] for r in f.collect()} for f in found)
    assert not scored & rejected and scored | rejected == everyone


def test_whole_pivot_has_every_offset(spark):
    from mercantile.operators.cohorts import cohort_pivot_by_label

    rows_ = [("2017-01-01", 1, 0, 100.0), ("2017-01-01", 1, 100, 5.0), ("2017-02-01", 0, 7, 1.0)]
    frame = spark.createDataFrame(rows_, "cohort_month string, churn_label int, month_offset int, retention_rate_pct double")
    assert cohort_pivot_by_label(frame, 1).columns == ["cohort_month", "month_0", "month_100"]
