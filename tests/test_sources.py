from datetime import date
from datetime import datetime as dt
from decimal import Decimal

from conftest import rows
from shop import shop

from mercantile.sources import marts, retail
from mercantile.sources.schemas import MART_FILES
from mercantile.sources.scratch import Scratch, shared_root

STAR = "/root/testdata/sf0.001"


def test_star_binding_folds_the_same_facts_in_one_pass(spark):
    star = retail.StarSchemaRetail(spark, STAR)
    generic = retail.RetailTables(orders=star.orders, payments=star.payments, reviews=star.reviews)
    for flags in ((True, True), (True, False), (False, False)):
        fast, plain = star.order_facts(*flags), generic.order_facts(*flags)
        assert set(fast.columns) == set(plain.columns)
        assert rows(fast.select(*plain.columns)) == rows(plain)


def test_raw_csv(spark, tmp_path):
    (tmp_path / "olist_orders_dataset.csv").write_text(
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,"
        "order_delivered_customer_date,order_estimated_delivery_date\n"
        'o1,c1,delivered,2018-01-05 10:00:01,,,2018-01-09 00:00:00,2018-01-20 00:00:00\n'
    )
    (tmp_path / "product_category_name_translation.csv").write_bytes(
        "\ufeffproduct_category_name,product_category_name_english\nbebes,baby".encode()
    )
    files = {k: retail.RAW_FILES[k] for k in ("orders", "category_translation")}
    tables = retail.read_raw_csv(spark, str(tmp_path), files)
    order = tables.orders.first()
    assert order["order_purchase_timestamp"] == dt(2018, 1, 5, 10, 0, 1) and order["order_approved_at"] is None
    assert rows(tables.category_translation) == [("bebes", "baby")]
    assert tables.payments is None


def test_marts_that_are_missing_are_reported(spark, tmp_path):
    (tmp_path / MART_FILES["monthly_revenue"]).write_text("month,revenue\n2017-01-01,10.50\n2017-02-01,\n")
    (tmp_path / MART_FILES["churn_summary"]).write_text("\ufeffrevenue,churn_label\n5.25,1\n")
    found, missing = marts.load_marts(spark, str(tmp_path))
    assert set(found) == {"monthly_revenue", "churn_summary"} and "customer_rfm" in missing
    assert rows(found["monthly_revenue"]) == [(date(2017, 1, 1), Decimal("10.50")), (date(2017, 2, 1), None)]
    # Columns are matched by name and absent ones are NULL.
    assert rows(found["churn_summary"]) == [(1, None, Decimal("5.25"))]


def test_written_marts_read_back(spark, tmp_path):
    df = spark.createDataFrame([(date(2017, 1, 1), Decimal("10.50"))], "month date, revenue decimal(18,2)")
    for form in ("csv", "parquet"):
        path = str(tmp_path / form / ("monthly_revenue.csv" if form == "csv" else "monthly_revenue"))
        marts.write_mart(df, path, form)
        assert rows(marts.read_mart(spark, str(tmp_path / form), "monthly_revenue", form)) == rows(df)


def test_bucketed_marts_join_without_a_shuffle(spark):
    df = spark.range(100).selectExpr("id AS customer_unique_id", "id % 7 AS v")
    for name in ("mart_left", "mart_right"):
        marts.write_bucketed(df, name, "customer_unique_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("mart_left").join(spark.table("mart_right"), "customer_unique_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("mart_left", "mart_right"):
            spark.sql(f"DROP TABLE {name}")


def test_scratch_uses_the_configured_folder(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = Scratch(spark).store(shop(spark).customers, "customers")
    assert kept.count() == 6 and shared_root(spark) in kept.inputFiles()[0]


def test_release_removes_only_its_own_folder(spark, tmp_path):
    first, second = Scratch(spark, str(tmp_path)), Scratch(spark, str(tmp_path))
    kept = second.store(spark.range(3).toDF("id"), "kept")
    first.store(spark.range(3).toDF("id"), "gone")
    first.release()
    assert [p.name for p in tmp_path.iterdir()] == [second.folder.rsplit("/", 1)[1]] and kept.count() == 3


def test_exported_marts_feed_the_analyses(spark, tmp_path):
    from mercantile.operators import cohorts, customers, products, revenue, rfm, scoring
    from mercantile.plans.export import export
    from mercantile.plans.warehouse import Warehouse

    warehouse = Warehouse(spark, shop(spark))
    for form in ("csv", "parquet"):
        folder = str(tmp_path / form)
        names = export(warehouse, folder, form)
        found, missing = marts.load_marts(spark, folder, form=form)
        assert missing == [] and "customer_retention_base" in names
        got = rfm.segment_distribution(found["customer_rfm"])
        assert rows(got) == rows(rfm.segment_distribution(warehouse.rfm))
        assert rows(scoring.customer_list(found["rfm_segments"])) == rows(scoring.customer_list(warehouse.rfm))
        assert rows(revenue.revenue_trends(found["monthly_revenue"])) == rows(revenue.revenue_trends(warehouse.monthly_revenue))
        assert rows(customers.churn_metrics(found["churn_summary"])) == rows(warehouse.churn_metrics)
        labelled = cohorts.retention_summary(found["cohort_retention"], 0)
        assert rows(labelled) == rows(cohorts.retention_summary(warehouse.cohort_retention_by_churn, 0))
        assert rows(products.category_insights(found["top_categories"])) == rows(products.category_insights(warehouse.top_categories))
        assert found["customer_churn"].count() == 5


def test_other_column_names_are_known(spark, tmp_path):
    (tmp_path / MART_FILES["customer_rfm"]).write_text("customer_id,recency,monetary\nx,12,3.5\n")
    got = marts.read_mart(spark, str(tmp_path), "customer_rfm").first()
    assert (got["customer_unique_id"], got["recency_days"], got["monetary"], got["r_score"]) == ("x", 12, 3.5, None)
