"""Hot keys against brute force in pandas, and jobs over no rows."""

import random
from collections import defaultdict
from datetime import datetime as dt
from datetime import timedelta
from decimal import Decimal

import pytest
from conftest import rows
from shop import shop

from mercantile.operators import audits, cohorts, customers, products, revenue, rfm, scoring
from mercantile.plans.warehouse import Warehouse
from mercantile.sources.retail import RetailTables

ORDERS = 1200


@pytest.fixture(scope="module")
def lopsided(spark):
    """One account places a third of the orders, one order takes a third of the payments, one product a third of the items."""
    pick = random.Random(11)
    accounts = [(f"a{i}", f"p{i % 90}", f"S{i % 5}") for i in range(100)]
    orders, payments, reviews, items = [], [], [], []
    for i in range(ORDERS):
        account = "a0" if i % 3 == 0 else f"a{pick.randint(1, 99)}"
        placed = dt(2018, 1, 1) + timedelta(hours=pick.randint(0, 24 * 300))
        orders.append((f"o{i}", account, "delivered", placed, None, placed + timedelta(days=9), placed + timedelta(days=pick.randint(5, 12))))
        reviews.append((f"r{i}", f"o{i}", pick.randint(1, 5), placed))
        for line in range(2):
            payments.append((f"o{i}", line, "credit_card", 1, Decimal(pick.randint(1, 9999)) / 100))
            items.append((f"o{i}", "x0" if pick.random() < 0.34 else f"x{pick.randint(1, 30)}", f"s{pick.randint(0, 9)}", Decimal("2.50"), Decimal("0.50")))
    payments += [("o5", n, "voucher", 1, Decimal("0.01")) for n in range(ORDERS)]
    stamp = "timestamp_ntz"
    return RetailTables(
        customers=spark.createDataFrame(accounts, "customer_id string, customer_unique_id string, customer_state string"),
        orders=spark.createDataFrame(
            orders,
            f"order_id string, customer_id string, order_status string, order_purchase_timestamp {stamp}, order_approved_at {stamp}, "
            f"order_delivered_customer_date {stamp}, order_estimated_delivery_date {stamp}",
        ),
        payments=spark.createDataFrame(
            payments, "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value decimal(18,2)"
        ),
        reviews=spark.createDataFrame(reviews, f"review_id string, order_id string, review_score int, review_creation_date {stamp}"),
        products=spark.createDataFrame([(f"x{i}", f"c{i % 4}") for i in range(31)], "product_id string, product_category_name string"),
        order_items=spark.createDataFrame(
            items, "order_id string, product_id string, seller_id string, price decimal(18,2), freight_value decimal(18,2)"
        ),
        sellers=spark.createDataFrame([(f"s{i}", f"S{i % 3}") for i in range(10)], "seller_id string, seller_state string"),
        category_translation=spark.createDataFrame([("c0", "zero")], "product_category_name string, product_category_name_english string"),
    )


def test_hot_account_and_hot_order(lopsided, spark):
    base = {r["customer_unique_id"]: r for r in Warehouse(spark, lopsided).customer_base.collect()}
    person = {r["customer_id"]: r["customer_unique_id"] for r in lopsided.customers.collect()}
    owner = {r["order_id"]: person[r["customer_id"]] for r in lopsided.orders.collect()}
    paid, count, stars = defaultdict(Decimal), defaultdict(int), defaultdict(list)
    for p in lopsided.payments.collect():
        paid[owner[p["order_id"]]] += p["payment_value"]
    for o in owner.values():
        count[o] += 1
    for r in lopsided.reviews.collect():
        stars[owner[r["order_id"]]].append(r["review_score"])
    assert count["p0"] > ORDERS / 3
    assert {k: (r["total_orders"], r["total_revenue"]) for k, r in base.items()} == {k: (count[k], paid[k]) for k in count}
    for k, r in base.items():
        assert r["avg_review_score"] == pytest.approx(sum(stars[k]) / len(stars[k]))


def test_hot_product(lopsided, spark):
    got = {r["product_category_name_english"]: r for r in Warehouse(spark, lopsided).categories.collect()}
    named = {r["product_id"]: r["product_category_name"] for r in lopsided.products.collect()}
    seen, money = defaultdict(set), defaultdict(Decimal)
    for i in lopsided.order_items.collect():
        name = {"c0": "zero"}.get(named[i["product_id"]], named[i["product_id"]])
        seen[name].add(i["order_id"])
        money[name] += i["price"]
    assert {k: (r["order_count"], r["revenue"]) for k, r in got.items()} == {k: (len(seen[k]), float(money[k])) for k in seen}


def test_cohort_invariants(lopsided, spark):
    warehouse = Warehouse(spark, lopsided)
    for frame in (warehouse.cohort_retention, warehouse.cohort_retention_by_churn):
        assert frame.where("month_offset < 0 OR active_customers > cohort_size OR cohort_size IS NULL").count() == 0
        assert frame.where("month_offset = 0 AND retention_rate_pct <> 100").count() == 0
    sizes = warehouse.cohort_retention.where("month_offset = 0").selectExpr("sum(cohort_size)").first()[0]
    assert sizes == warehouse.customer_base.count()


def test_money_is_kept(lopsided, spark):
    warehouse = Warehouse(spark, lopsided)
    total = lopsided.payments.selectExpr("sum(payment_value)").first()[0]
    assert warehouse.monthly_revenue.selectExpr("sum(revenue)").first()[0] == total
    assert warehouse.customer_base.selectExpr("sum(total_revenue)").first()[0] == total
    assert warehouse.monthly_by_state.selectExpr("sum(revenue)").first()[0] == total
    assert rfm.segment_distribution(warehouse.rfm).selectExpr("round(sum(total_revenue), 2)").first()[0] == float(total)


def test_a_hot_key_in_an_audit(lopsided):
    twice = audits.duplicate_keys({"payments": (lopsided.payments, ["order_id"])}).first()
    assert (twice["duplicate_keys"], twice["surplus_rows"]) == (ORDERS, 2 * ORDERS)


@pytest.fixture(scope="module")
def nothing(spark):
    full = shop(spark)
    names = "customers orders payments reviews products order_items sellers category_translation".split()
    return Warehouse(spark, RetailTables(**{n: getattr(full, n).limit(0) for n in names}))


def test_no_rows_give_no_rows(nothing):
    empty = [
        nothing.retention_base, nothing.rfm, nothing.churn_summary, nothing.cohort_retention,
        nothing.cohort_retention_by_churn, nothing.monthly_revenue, nothing.categories, nothing.sellers, nothing.states,
        nothing.churn_features, rfm.segment_distribution(nothing.rfm), rfm.high_value_customers(nothing.rfm, nothing.scratch),
        revenue.revenue_trends(nothing.monthly_revenue), revenue.revenue_forecast(nothing.monthly_revenue),
        customers.churn_by_segment(nothing.rfm_labelled), cohorts.cohort_pivot(nothing.cohort_retention),
        products.category_revenue_rank(nothing.tables.order_items, nothing.tables.products, nothing.tables.category_translation),
        scoring.customer_list(nothing.rfm), scoring.riskiest(nothing.segment_probability),
    ]
    assert [f.count() for f in empty] == [0] * len(empty)


def test_bundles_over_no_rows(nothing):
    metrics = nothing.churn_metrics.first()
    assert (metrics["total_customers"], metrics["churn_rate_pct"], metrics["avg_revenue_per_churned"]) == (0, None, 0.0)
    assert customers.one_time_buyer_pct(nothing.customer_base).first()[0] is None
    assert rfm.score_stats(nothing.rfm, nothing.scratch).first()["monetary_median"] is None
    assert rows(rfm.churn_risk_summary(nothing.rfm, nothing.scratch)) == [(0, 0.0, None)]
