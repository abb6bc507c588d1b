"""The marts and how they build on each other.

Each mart is built on first use. One that several plans read, or that is read twice within a plan,
is stored in the shared folder, which also cuts its lineage.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from mercantile.ml import churn_model, features
from mercantile.ml.store import ModelStore
from mercantile.operators import churn, cohorts, customers, products, revenue, rfm, scoring
from mercantile.operators.cleaning import DELIVERED
from mercantile.sources.layout import OrderLayout
from mercantile.sources.retail import RetailTables
from mercantile.sources.scratch import Scratch


class Warehouse:
    """Marts over one set of retail tables.

    ``churn_as_of`` and ``churn_days`` set the fixed-date churn rule of the feature job;
    ``label_days`` the rolling rule of the customer mart. With ``store_facts`` the order-grain facts
    are written once and all marts start from them, which pays off from about three marts on; without
    it each mart takes the columns it needs straight from the raw tables.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: RetailTables,
        churn_as_of: str = "2018-06-30",
        churn_days: int = 180,
        label_days: int = 90,
        scratch: Scratch | None = None,
        store_facts: bool = False,
    ):
        self.spark = spark
        self.tables = tables
        self.churn_as_of = churn_as_of
        self.churn_days = churn_days
        self.label_days = label_days
        self.scratch = scratch or Scratch(spark)
        self.store_facts = store_facts
        self.models = ModelStore(spark)

    @cached_property
    def _stored_facts(self) -> DataFrame:
        return self.scratch.store(self.tables.order_facts(), "order_facts")

    def order_facts(self, payments: bool = True, reviews: bool = True, status: str | None = None) -> DataFrame:
        """Order facts; with ``status`` those of one status may be all that is read."""
        return self._stored_facts if self.store_facts else self.tables.order_facts(payments, reviews, status)

    # Customer marts

    def customer_base_plan(self) -> DataFrame:
        return customers.customer_base(self.order_facts(status=DELIVERED), self.tables.customers)

    @cached_property
    def customer_base(self) -> DataFrame:
        return self.scratch.store(self.customer_base_plan(), "customer_base")

    @cached_property
    def retention_base(self) -> DataFrame:
        return customers.label_churn(self.customer_base, window_days=self.label_days)

    @cached_property
    def paying(self) -> DataFrame:
        return rfm.paying_customers(self.retention_base)

    @cached_property
    def rfm_labelled(self) -> DataFrame:
        scores = rfm.customer_rfm(self.retention_base, self.scratch, "churn_label")
        return self.scratch.store(rfm.with_segment(scores), "customer_rfm")

    @cached_property
    def rfm(self) -> DataFrame:
        return self.rfm_labelled.drop("churn_label")

    @cached_property
    def churn_summary(self) -> DataFrame:
        return customers.churn_summary(self.retention_base)

    @cached_property
    def churn_metrics(self) -> DataFrame:
        return customers.churn_metrics(self.churn_summary)

    # Cohorts

    @cached_property
    def customer_months(self) -> DataFrame:
        facts = self.order_facts(payments=False, reviews=False, status=DELIVERED)
        return cohorts.customer_months(facts, self.tables.customers)

    @cached_property
    def cohort_retention(self) -> DataFrame:
        return cohorts.cohort_retention(self.customer_months)

    @cached_property
    def cohort_retention_by_churn(self) -> DataFrame:
        months = self.scratch.store(self.customer_months, "customer_months")
        return cohorts.cohort_retention_by_churn(months, self.label_days)

    # Revenue: series are small aggregates that later plans read several times.

    def monthly_revenue_plan(self) -> DataFrame:
        return revenue.monthly_revenue(self.order_facts(reviews=False, status=DELIVERED))

    @cached_property
    def monthly_revenue(self) -> DataFrame:
        return self.scratch.store(self.monthly_revenue_plan(), "monthly_revenue")

    @cached_property
    def monthly_by_state(self) -> DataFrame:
        facts = self.order_facts(reviews=False, status=DELIVERED)
        series = revenue.monthly_revenue_by_state(facts, self.tables.customers)
        return self.scratch.store(series, "monthly_by_state")

    @cached_property
    def monthly_by_category(self) -> DataFrame:
        t = self.tables
        series = revenue.monthly_revenue_by_category(
            self.order_facts(payments=False, reviews=False, status=DELIVERED), t.order_items, t.products
        )
        return self.scratch.store(series, "monthly_by_category")

    # Products

    @cached_property
    def layout(self) -> OrderLayout:
        """Orders and items bucketed by order, for several reports on items."""
        t = self.tables
        facts = self.order_facts(payments=False, status=DELIVERED)
        return OrderLayout(self.spark, self.scratch).build(facts, t.order_items, t.products)

    @cached_property
    def categories_by_layout(self) -> DataFrame:
        return products.category_performance_by_layout(self.layout.orders, self.layout.lines, self.tables.category_translation)

    @cached_property
    def sellers_by_layout(self) -> DataFrame:
        return products.seller_performance(self.layout.orders, self.layout.lines, self.tables.sellers, self.scratch)

    @cached_property
    def categories(self) -> DataFrame:
        t = self.tables
        return products.category_performance(
            self.order_facts(payments=False, reviews=False, status=DELIVERED), t.order_items, t.products, t.category_translation
        )

    @cached_property
    def top_categories(self) -> DataFrame:
        return self.scratch.store(products.top_categories(self.categories), "top_categories")

    @cached_property
    def sellers(self) -> DataFrame:
        t = self.tables
        return products.seller_performance(
            self.order_facts(payments=False, status=DELIVERED), t.order_items, t.sellers, self.scratch
        )

    @cached_property
    def top_sellers(self) -> DataFrame:
        return products.top_sellers(self.sellers)

    @cached_property
    def states(self) -> DataFrame:
        return products.state_performance(self.order_facts(reviews=False, status=DELIVERED), self.tables.customers)

    # Churn features and scores

    @cached_property
    def churn_raw(self) -> DataFrame:
        raw = churn.churn_raw_features(
            self.order_facts(), self.tables.customers, self.churn_as_of, self.churn_days
        )
        return self.scratch.store(raw, "churn_raw")

    @cached_property
    def churn_features(self) -> DataFrame:
        return self.scratch.store(churn.fill_features(self.churn_raw, self.scratch), "churn_features")

    @cached_property
    def churn_model(self) -> churn_model.ChurnModel:
        """The churn model without time features; loaded if these customers have been fitted before."""
        return churn_model.fitted(self.churn_features, self.scratch, exclude_time=True, store=self.models)[0]

    @cached_property
    def model_probability(self) -> DataFrame:
        """Every customer with the probability of the churn model without time features."""
        model = self.churn_model
        filled = features.prepare_churn(self.churn_raw, model.features, self.scratch)
        # Customers that are alike take the same paths through the trees, whose nodes then stay in a core's cache.
        alike = filled.sortWithinPartitions(*model.features)
        return self.scratch.store(model.score(alike), "model_probability")

    @cached_property
    def segment_probability(self) -> DataFrame:
        return scoring.segment_probability(self.rfm)
