from datetime import date
from datetime import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F
from shop import shop

from mercantile.operators import audits, churn, cleaning, cohorts, customers, order_grain, products, revenue
from mercantile.plans.warehouse import Warehouse


@pytest.fixture(scope="module")
def warehouse(spark):
    return Warehouse(spark, shop(spark))


def by_key(df, key="customer_unique_id"):
    return {r[key]: r for r in df.collect()}


def test_base_folds_accounts_of_a_person(warehouse):
    ann = by_key(warehouse.customer_base)["ann"]
    assert (ann["total_orders"], float(ann["total_revenue"])) == (2, 150.30)
    assert ann["avg_order_value"] == pytest.approx(75.15)
    assert ann["avg_review_score"] == pytest.approx((3.5 + 4) / 2)
    # 2018-01-09 minus 2018-01-20 is -11 days; 2018-04-01 12:00 minus 2018-03-20 is 12 days.
    assert ann["avg_delivery_difference_days"] == pytest.approx(0.5)
    assert ann["late_delivery_rate"] == pytest.approx(0.5)


def test_base_keeps_orders_without_payment_and_without_promise(warehouse):
    base = by_key(warehouse.customer_base)
    assert set(base) == {"ann", "bob", "cat", "dan"}
    assert float(base["cat"]["total_revenue"]) == 0 and base["cat"]["avg_order_value"] is None
    assert base["cat"]["avg_review_score"] is None
    assert base["bob"]["late_delivery_rate"] == 0 and base["bob"]["avg_delivery_difference_days"] is None


def test_label_turns_after_exactly_ninety_days(warehouse):
    base = by_key(warehouse.retention_base)
    assert (base["bob"]["recency_days"], base["bob"]["churn_label"]) == (90, 0)
    assert (base["cat"]["recency_days"], base["cat"]["churn_label"]) == (91, 1)


def test_rfm_leaves_out_customers_who_paid_nothing(warehouse):
    scores = by_key(warehouse.rfm)
    assert set(scores) == {"ann", "dan"}
    assert [(scores[c]["r_score"], scores[c]["m_score"]) for c in ("ann", "dan")] == [(1, 2), (2, 1)]


def test_churn_features(warehouse):
    raw = by_key(warehouse.churn_raw)
    assert set(raw) == {"ann", "bob", "cat", "dan", "eve"}
    # A purchase after the reference date gives a negative recency, floored.
    assert raw["eve"]["recency_days"] == -2 and raw["dan"]["recency_days"] == -1
    assert raw["ann"]["frequency"] == 2 and raw["ann"]["monetary"] == pytest.approx(150.30)
    assert raw["ann"]["avg_review_score"] == pytest.approx(11 / 3)
    assert raw["ann"]["credit_card_rate"] == pytest.approx(1 / 3)
    assert raw["ann"]["avg_installments"] == pytest.approx(5 / 3)
    assert raw["ann"]["late_delivery_rate"] == pytest.approx(0.5)
    assert raw["cat"]["monetary"] == 0 and raw["cat"]["credit_card_rate"] is None
    assert raw["ann"]["churn_label"] == 0
    filled = by_key(warehouse.churn_features)
    # Median of 11/3 and 1.
    assert filled["cat"]["avg_review_score"] == pytest.approx((11 / 3 + 1) / 2)
    assert (filled["cat"]["credit_card_rate"], filled["cat"]["avg_installments"]) == (0, 1)
    assert filled["bob"]["avg_installments"] == 1


def test_churn_cutoff_is_exclusive(spark):
    t = shop(spark)
    facts = t.order_facts()
    cutoff = churn.churn_raw_features(facts, t.customers, "2018-06-30", 90)
    labels = {r["customer_unique_id"]: r["churn_label"] for r in cutoff.collect()}
    # 2018-04-01 00:00 is the cutoff: a purchase that day stays.
    assert labels["bob"] == 0 and labels["cat"] == 1


def test_cohorts(warehouse):
    assert rows(warehouse.cohort_retention) == [
        (date(2018, 1, 1), 0, 1, 1, 100.0),
        (date(2018, 1, 1), 2, 1, 1, 100.0),
        (date(2018, 3, 1), 0, 1, 1, 100.0),
        (date(2018, 4, 1), 0, 1, 1, 100.0),
        (date(2018, 6, 1), 0, 1, 1, 100.0),
    ]
    labelled = warehouse.cohort_retention_by_churn
    summary = cohorts.retention_summary(labelled, 0).first()
    assert summary["total_cohorts"] == 4 and summary["avg_retention_rate"] == 100.0


def test_first_month_from_one_pass_equals_the_direct_form(warehouse):
    t = warehouse.tables
    direct = cohorts.customer_cohorts(t.order_facts(False, False), t.customers)
    assert rows(direct) == rows(warehouse.customer_months.select("customer_unique_id", "cohort_month").distinct())


def test_approval_is_filled_only_when_missing(spark):
    clean = {r["order_id"]: r["order_approved_at"] for r in cleaning.orders_clean(shop(spark).orders).collect()}
    assert clean["o1"] == dt(2018, 1, 6, 10)
    assert clean["o2"] == dt(2018, 3, 1)  # before the purchase, and left so
    assert set(clean) == {"o1", "o2", "o3", "o4", "o5"}


def test_city_names(spark):
    cities = spark.createDataFrame([("São Paulo",), ("SAO PAULO ",), ("sãopaulo",), (None,), ("Rio",)], "city string")
    got = [r[0] for r in cleaning.standardize_text(cities, "city").collect()]
    assert got == ["sao paulo", "sao paulo", "sãopaulo", None, "Rio"]
    counted = cleaning.count_matching(cleaning.standardize_text(cities, "city"), "city")
    assert rows(counted) == [("sao paulo", 2)]


def test_products_get_a_category(spark):
    got = {r["product_id"]: r["product_category_name"] for r in cleaning.products_clean(shop(spark).products).collect()}
    assert got == {"p1": "toys", "p2": "Unknown", "p3": "garden"}


def test_audits(spark):
    t = shop(spark)
    extra = t.payments.union(t.payments.limit(1))
    twice = audits.duplicate_keys({"payments": (extra, ["order_id", "payment_sequential"])}).first()
    assert (twice["duplicate_keys"], twice["surplus_rows"]) == (1, 1)
    lost = audits.orphans({"p": (t.payments, "order_id", t.orders.where("order_id <> 'o1'"), "order_id")}).first()
    assert (lost["orphan_keys"], lost["orphan_rows"]) == (1, 2)
    wrong = audits.domain_violations({"score": (t.reviews, F.col("review_score").between(2, 5))}).first()
    assert (wrong["total_rows"], wrong["violations"]) == (5, 1)
    both = audits.reconcile_revenue(t.payments, order_grain.order_revenue(t.payments)).first()
    assert both["raw_total_payments"] == both["aggregated_revenue"] == pytest.approx(259.35)
    assert audits.customer_counts(t.customers).first().asDict() == {"total_customers": 6, "total_unique_customers": 5}
    assert rows(audits.status_distribution(t.orders)) == [("canceled", 1, 14.29), ("delivered", 6, 85.71)]


def test_reports_do_not_fan_out(warehouse):
    t = warehouse.tables
    sellers = by_key(warehouse.sellers, "seller_id")
    assert (sellers["s1"]["order_count"], sellers["s1"]["revenue"], sellers["s1"]["avg_review"]) == (2, 130.0, 3.75)
    assert (sellers["s2"]["order_count"], sellers["s2"]["revenue_pct"]) == (1, 7.14)
    categories = by_key(warehouse.categories, "product_category_name_english")
    assert set(categories) == {"toys_en", "Unknown"}
    toys = categories["toys_en"]
    assert (toys["order_count"], toys["revenue"], toys["profit"], toys["margin_pct"]) == (1, 90.0, 80.0, 88.89)
    ranked = rows(products.category_revenue_rank(t.order_items, t.products, t.category_translation), "category", "rank")
    assert ranked == [("Unknown", 3), ("garden", 1), ("toys_en", 2)]
    states = by_key(warehouse.states, "customer_state")
    assert (states["SP"]["order_count"], states["SP"]["unique_buyers"]) == (3, 2)


def test_monthly_revenue_needs_a_payment(warehouse):
    months = {r["month"].month: float(r["revenue"]) for r in warehouse.monthly_revenue.collect()}
    assert months == {1: 100.30, 3: 50.0, 4: 0.0, 6: 10.05}
    trends = {r["month"].month: r["mom_growth"] for r in revenue.revenue_trends(warehouse.monthly_revenue).collect()}
    assert trends[1] is None and trends[6] is None and trends[4] == -100.0


def test_one_time_buyers(warehouse):
    assert customers.one_time_buyer_pct(warehouse.customer_base).first()[0] == 75.0
    assert rows(customers.review_vs_repeat(warehouse.customer_base)) == [(4, 1, 2.0, 2)]
