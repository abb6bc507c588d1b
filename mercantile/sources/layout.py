"""Orders and their items stored side by side, so that reports on items move no items.

Both tables are bucketed by order: what belongs to an order is in buckets of one number. Joins on the order and folds per order and
anything else then need no shuffle. An item row is the sum of an order's items of one product, seller and category, folded
in tasks before it is written; so an order with very many items, or a product in very many orders, is no single task's burden when the
layout is built, and its product's category is looked up once and for all reports.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercantile.functions.expressions import row_count
from mercantile.sources.scratch import Scratch


class OrderLayout:
    """Bucketed tables ``orders`` and ``lines``; ``release`` drops them."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int | None = None):
        self.spark, self.scratch = spark, scratch
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = []

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        table = f"{name}_{uuid.uuid4().hex}"
        dealt = df.repartition(self.buckets, "order_id")
        writer = dealt.write.bucketBy(self.buckets, "order_id").sortBy("order_id").option("path", self.scratch.path(name))
        writer.saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def build(self, order_facts: DataFrame, items: DataFrame, products: DataFrame) -> OrderLayout:
        """Write both tables; ``order_facts`` has a row per order."""
        self.orders = self._write(order_facts, "orders_by_order")
        category = products.select("product_id", F.coalesce("product_category_name", F.lit("Unknown")).alias("category"))
        folded = items.groupBy("order_id", "product_id", "seller_id").agg(
            F.sum("price").alias("price"), F.sum("freight_value").alias("freight"), row_count().alias("items")
        )
        # A product that the product table lacks has no category, and is left out of reports by category.
        self.lines = self._write(folded.join(category, "product_id", "left"), "lines_by_order")
        return self

    def release(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
