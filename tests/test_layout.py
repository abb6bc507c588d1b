"""Reports on items off tables bucketed by order."""

import random
import re
from datetime import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows
from shop import shop

from mercantile.operators import products
from mercantile.plans.warehouse import Warehouse
from mercantile.sources.layout import OrderLayout
from mercantile.sources.retail import RetailTables


def busy_shop(spark):
    """A third of all items are of one order, another third of one product."""
    pick = random.Random(4)
    orders = [(f"o{k}", "a1", "delivered" if k % 5 else "shipped", dt(2018, 1, 1), dt(2018, 1, 1), dt(2018, 1, 9) if k % 7 else None, dt(2018, 1, 20)) for k in range(80)]
    items = []
    for k in range(1500):
        order = "o1" if k % 3 == 0 else f"o{pick.randrange(85)}"
        product = "p1" if k % 3 == 1 else f"p{pick.randrange(12)}"
        items.append((order, product, f"s{pick.randrange(4)}", Decimal(pick.randint(1, 9999)) / 100, Decimal(pick.randint(0, 500)) / 100))
    plain = shop(spark)
    schema = plain.orders.schema
    goods = [(f"p{k}", [None, "toys", "garden", "books"][k % 4], k) for k in range(10)]  # two products are unknown
    return RetailTables(
        customers=plain.customers,
        orders=spark.createDataFrame(orders, schema),
        payments=plain.payments,
        reviews=spark.createDataFrame([(f"r{k}", f"o{k}", k % 5 + 1, dt(2018, 1, 10)) for k in range(60)], plain.reviews.schema),
        products=spark.createDataFrame(goods, plain.products.schema),
        order_items=spark.createDataFrame(items, plain.order_items.schema),
        sellers=spark.createDataFrame([(f"s{k}", "SP") for k in range(3)], plain.sellers.schema),
        category_translation=plain.category_translation,
    )


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reports_equal_those_without_a_layout(spark, scratch):
    w = Warehouse(spark, busy_shop(spark), scratch=scratch)
    assert rows(w.categories_by_layout) == rows(w.categories.select(*w.categories_by_layout.columns))
    assert rows(w.sellers_by_layout) == rows(w.sellers.select(*w.sellers_by_layout.columns))
    assert len(rows(w.categories)) == 4 and len(rows(w.sellers)) == 3
    w.layout.release()


def test_no_items_are_shuffled(spark, scratch, no_broadcast):
    tables = busy_shop(spark)
    facts = tables.order_facts(payments=False)
    layout = OrderLayout(spark, scratch, 4).build(facts, tables.order_items, tables.products)
    report = products.category_performance_by_layout(layout.orders, layout.lines, tables.category_translation)
    plan = report._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange (?:hash|range)partitioning\(([^)]*)\)", plan)
    # Sums by category, and the names they are joined with: rows per category only.
    assert exchanges and all("order_id" not in e and "product_id" not in e for e in exchanges)
    assert "lines_by_order" in plan and "Bucketed: true" in plan
    layout.release()


def test_a_busy_order_is_folded(spark, scratch):
    tables = busy_shop(spark)
    layout = OrderLayout(spark, scratch, 4).build(tables.order_facts(payments=False), tables.order_items, tables.products)
    held = layout.lines.where("order_id = 'o1'")
    assert held.count() <= 12 * 4 < tables.order_items.where("order_id = 'o1'").count()
    assert layout.lines.agg({"items": "sum"}).first()[0] == 1500
    names = list(layout.names)
    layout.release()
    assert not any(spark.catalog.tableExists(n) for n in names)
