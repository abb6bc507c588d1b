"""Published marts, pages by index, conditions that reach the scan, figures without scores."""

import os
import re

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from shop import shop

from mercantile.operators.cleaning import DELIVERED, orders_clean
from mercantile.operators.paging import PageIndex
from mercantile.plans import registry
from mercantile.plans.export import export
from mercantile.plans.warehouse import Warehouse
from mercantile.sources import marts
from mercantile.sources.catalog import BrokenMart, MartCatalog
from mercantile.sources.retail import RetailTables, StarSchemaRetail
from mercantile.sources.schemas import MART_FILES

FOLDER = "/root/testdata/sf0.001"


def files(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def test_a_version_replaces_the_last_one(spark, tmp_path):
    catalog = MartCatalog(spark, str(tmp_path))
    assert catalog.names() == []
    with pytest.raises(FileNotFoundError):
        catalog.read("m")
    for n in (3, 5, 7):
        held = catalog.read("m") if n > 3 else None
        manifest = catalog.publish("m", spark.range(n).withColumn("v", F.col("id") * 2))
        assert manifest["rows"] == n and catalog.read("m").count() == n
        if held is not None:
            assert held.count() == n - 2  # who reads the version before may go on
    catalog.verify("m")
    assert catalog.names() == ["m"] and len([p for p in (tmp_path / "m").iterdir() if p.is_dir()]) == 2


def test_a_half_written_version_is_invisible(spark, tmp_path):
    catalog = MartCatalog(spark, str(tmp_path))
    spark.range(9).write.parquet(str(tmp_path / "m" / "version-lost"))
    assert catalog.names() == []
    catalog.publish("m", spark.range(4).toDF("id"))
    spark.range(9).write.parquet(str(tmp_path / "m" / "version-lost-again"))
    assert catalog.read("m").count() == 4


def test_a_broken_mart_raises(spark, tmp_path):
    catalog = MartCatalog(spark, str(tmp_path))
    catalog.publish("gone", spark.range(4).toDF("id"))
    os.remove(files(tmp_path / "gone")[0])
    with pytest.raises(BrokenMart):
        catalog.read("gone")
    catalog.publish("other", spark.range(4).toDF("id"))
    path = tmp_path / "other" / "_manifest.json"
    os.remove(tmp_path / "other" / "._manifest.json.crc")
    path.write_text(path.read_text().replace('"checksum": "4-', '"checksum": "5-'))
    with pytest.raises(BrokenMart):
        catalog.verify("other")


def test_what_can_not_be_read_is_not_missing(spark, tmp_path):
    (tmp_path / "monthly_revenue").mkdir()
    (tmp_path / "monthly_revenue" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception) as e:
        marts.load_marts(spark, str(tmp_path), ["monthly_revenue"], "parquet")
    assert not isinstance(e.value, FileNotFoundError)
    (tmp_path / MART_FILES["churn_summary"]).mkdir()  # a folder without files
    with pytest.raises(AnalysisException):
        marts.load_marts(spark, str(tmp_path), ["churn_summary"])
    assert marts.load_marts(spark, str(tmp_path), ["top_states"]) == ({}, ["top_states"])


def test_exported_marts_are_published(spark, tmp_path):
    w = Warehouse(spark, shop(spark))
    for _ in range(2):
        names = export(w, str(tmp_path))
    catalog = MartCatalog(spark, str(tmp_path))
    assert set(catalog.names()) == set(names)
    assert rows(catalog.read("monthly_revenue")) == rows(w.monthly_revenue)


def numbered(spark, n):
    return spark.range(n).select((F.col("id") * 3 + 1).alias("id"), (F.col("id") % 7).alias("v")).repartition(5)


@pytest.mark.parametrize("ranges", [1, 8])
def test_pages_equal_an_offset(spark, scratch, ranges):
    df = numbered(spark, 1000)
    index = PageIndex.build(df, "id", scratch, ranges)
    assert index.rows == 1000 and len(index.ranges) == ranges
    for limit, offset in ((10, 0), (100, 200), (100, 957), (7, 1000), (400, 300), (1000, 0), (0, 5)):
        assert index.page(limit, offset).collect() == df.orderBy("id").offset(offset).limit(limit).collect()
    for last, limit in ((-5, 10), (1, 10), (700, 50), (2990, 10), (5000, 10), (350, 300)):
        assert index.after(last, limit).collect() == df.where(F.col("id") > last).orderBy("id").limit(limit).collect()


def test_pages_of_an_empty_table_and_by_text(spark, scratch):
    assert PageIndex.build(numbered(spark, 0), "id", scratch).page(10).count() == 0
    names = numbered(spark, 300).select(F.format_string("c%04d", "id").alias("name"))
    index = PageIndex.build(names, "name", scratch, 4)
    page, seen = index.page(90), []
    while found := [r["name"] for r in page.collect()]:
        seen += found
        page = index.after(found[-1], 90)
    assert seen == sorted(r["name"] for r in names.collect())


def test_a_deep_page_opens_two_ranges_at_most(spark, scratch):
    index = PageIndex.build(numbered(spark, 4000), "id", scratch, 16)
    for page in (index.page(100, 3333), index.after(9000, 100)):
        plan = page._jdf.queryExecution().executedPlan().toString()
        slots = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
        # One range: an equality; more: a list.
        assert "slot" in slots and len(re.findall(r"\d+", re.sub(r"slot#\d+", "", slots))) <= 2
        assert page.count() == 100


@pytest.mark.parametrize("name", ["orders_clean", "customer_cohorts", "monthly_revenue", "one_time_buyer_pct"])
def test_the_delivered_condition_reaches_the_scan(spark, name):
    plan = registry.all_queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    scans = re.findall(r"orders\.parquet.*?PushedFilters: \[([^\]]*)\]", plan)
    assert scans and all("EqualTo(o_orderstatus,F)" in s for s in scans) or name == "one_time_buyer_pct"


def test_orders_of_every_status(spark):
    star = StarSchemaRetail(spark, FOLDER)
    for status in ("delivered", "shipped", "processing", "unheard of"):
        want = star.orders.where(F.col("order_status") == status)
        assert rows(star.orders_of(status)) == rows(want)
        for flags in ((True, True), (False, False)):
            facts = star.order_facts(*flags, status=status)
            assert rows(facts) == rows(star.order_facts(*flags).where(F.col("order_status") == status).select(*facts.columns))
    generic = RetailTables(orders=star.orders, payments=star.payments, reviews=star.reviews)
    assert rows(orders_clean(generic.order_facts(status=DELIVERED))) == rows(orders_clean(generic.order_facts()))


@pytest.mark.parametrize("name", ["rfm_score_stats", "churn_risk_summary"])
def test_figures_over_all_customers_build_no_tiles(spark, monkeypatch, name):
    from mercantile.operators import rfm

    monkeypatch.setattr(rfm, "add_tiles", lambda *a, **k: pytest.fail("tiles"))
    assert registry.all_queries()[name](spark, FOLDER).count() == 1


@pytest.mark.parametrize("name", ["report_kpis", "executive_summary"])
def test_summaries_need_no_range_layout(spark, monkeypatch, name):
    from mercantile.operators import ordering

    monkeypatch.setattr(ordering, "range_layout", lambda *a, **k: pytest.fail("a range layout"))
    assert registry.all_queries()[name](spark, FOLDER).count() == 1
