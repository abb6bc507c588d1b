"""The canonical retail tables and the two ways to obtain them.

``read_raw_csv`` reads the public order dataset. ``StarSchemaRetail`` derives the same tables from
a star schema of orders, line items, parts and suppliers.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercantile.functions.dates import shift
from mercantile.operators.order_grain import payment_totals, review_totals
from mercantile.sources.csv_files import CsvLoad, load_csv
from mercantile.sources.schemas import MONEY, RAW_FILES, RAW_TABLES, STAR_TABLES


class RetailTables:
    """Holds the canonical tables; a table that the source lacks is None."""

    loads: dict[str, CsvLoad] = {}

    def __init__(self, **tables: DataFrame):
        unknown = set(tables) - set(RAW_TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        for name in RAW_TABLES:
            if name in tables:
                setattr(self, name, tables[name])
            elif not hasattr(type(self), name):
                setattr(self, name, None)

    def orders_of(self, status: str) -> DataFrame:
        """Orders of one status. A source whose own tables say it otherwise translates the condition, so that it reaches the scan."""
        return self.orders.where(F.col("order_status") == status)

    def order_facts(self, payments: bool = True, reviews: bool = True, status: str | None = None) -> DataFrame:
        """Orders with payment and review totals, one row per order; with ``status`` only those of one status.

        Both sides are reduced to order grain before they meet the orders, so no join fans out and
        an order with very many payment rows is folded map-side.
        """
        facts = self.orders if status is None else self.orders_of(status)
        if payments:
            facts = facts.join(payment_totals(self.payments), "order_id", "left")
        if reviews:
            facts = facts.join(review_totals(self.reviews), "order_id", "left")
        return facts


def read_raw_csv(spark: SparkSession, directory: str, files: dict[str, str] | None = None) -> RetailTables:
    """Read the raw CSV files by column name (a byte-order mark is dropped).

    ``loads`` of the result has, by table, the rejected records and their counts.
    """
    files = files or RAW_FILES
    loads = {name: load_csv(spark, f"{directory.rstrip('/')}/{file}", RAW_TABLES[name]) for name, file in files.items()}
    tables = RetailTables(**{name: load.table for name, load in loads.items()})
    tables.loads = loads
    return tables


def read_raw_parquet(spark: SparkSession, directory: str, names: list[str] | None = None) -> RetailTables:
    """Read the raw tables from Parquet folders named after them."""
    names = names or list(RAW_TABLES)
    return RetailTables(
        **{name: spark.read.schema(RAW_TABLES[name]).parquet(f"{directory.rstrip('/')}/{name}") for name in names}
    )


def read_star_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A star-schema table by its declared schema, without a job to infer one."""
    return spark.read.schema(STAR_TABLES[name]).parquet(f"{directory.rstrip('/')}/{name}.parquet")


class StarSchemaRetail(RetailTables):
    """The canonical tables derived from region/nation/customer/supplier/part/orders/lineitem."""

    def __init__(self, spark: SparkSession, directory: str):
        self._spark = spark
        self.directory = directory.rstrip("/")
        super().__init__()

    def _read(self, name: str) -> DataFrame:
        return read_star_table(self._spark, self.directory, name)

    @cached_property
    def customers(self) -> DataFrame:
        nation = self._read("nation")
        return (
            self._read("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_custkey").alias("customer_unique_id"),
                F.col("c_mktsegment").alias("customer_city"),
                F.col("n_name").alias("customer_state"),
            )
        )

    @cached_property
    def sellers(self) -> DataFrame:
        nation = self._read("nation")
        return (
            self._read("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state"))
        )

    @cached_property
    def products(self) -> DataFrame:
        return self._read("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_brand").alias("product_category_name"),
            F.col("p_type").alias("product_type"),
            F.col("p_name").alias("product_name"),
            F.col("p_size").alias("product_weight_g"),
        )

    @cached_property
    def category_translation(self) -> DataFrame:
        category = F.col("p_brand")
        return (
            self._read("part")
            .select(category.alias("product_category_name"))
            .distinct()
            .withColumn(
                "product_category_name_english",
                F.lower(F.regexp_replace("product_category_name", "#", "_")),
            )
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self._read("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_extendedprice").cast(MONEY).alias("price"),
            F.col("l_quantity").cast(MONEY).alias("freight_value"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self.payments_of(self._read("lineitem"))

    def payments_of(self, lines: DataFrame) -> DataFrame:
        """Payment rows of a batch or a stream of line items."""
        return lines.select(F.col("l_orderkey").alias("order_id"), *self._payment_columns())

    @staticmethod
    def _payment_columns():
        kind = F.col("l_returnflag")
        return [
            F.col("l_linenumber").alias("payment_sequential"),
            F.when(kind == "A", "credit_card")
            .when(kind == "R", "boleto")
            .when(kind == "N", "voucher")
            .alias("payment_type"),
            F.col("l_linenumber").alias("payment_installments"),
            F.col("l_extendedprice").cast(MONEY).alias("payment_value"),
        ]

    @cached_property
    def reviews(self) -> DataFrame:
        return self._read("orders").select(
            F.col("o_orderkey").alias("review_id"),
            F.col("o_orderkey").alias("order_id"),
            *self._review_columns(),
        )

    @staticmethod
    def _review_columns():
        priority = F.col("o_orderpriority")
        return [
            F.when(priority != "4-NOT SPECIFIED", F.substring(priority, 1, 1).cast("int")).alias("review_score"),
            shift("o_orderdate", "10 days").alias("review_creation_date"),
        ]

    #: What a status is in the star schema; all others are the last one.
    STATUSES = {"delivered": "F", "shipped": "O"}
    OTHER_STATUS = "processing"

    def _placed(self, status: str | None) -> DataFrame:
        """The star's orders, all or those of one canonical status, by a condition on the stored column."""
        raw, orders = F.col("o_orderstatus"), self._read("orders")
        if status is None:
            return orders
        if status in self.STATUSES:
            return orders.where(raw == self.STATUSES[status])
        if status == self.OTHER_STATUS:
            return orders.where(raw.isNull() | ~raw.isin(list(self.STATUSES.values())))
        return orders.where(F.lit(False))

    def _order_columns(self, only: str | None = None):
        placed = F.col("o_orderdate")
        key = F.col("o_orderkey")
        status = F.lit(only)
        if only is None:
            status = F.when(F.col("o_orderstatus") == self.STATUSES["delivered"], "delivered")
            status = status.when(F.col("o_orderstatus") == self.STATUSES["shipped"], "shipped").otherwise(self.OTHER_STATUS)
        return [
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status.alias("order_status"),
            placed.alias("order_purchase_timestamp"),
            F.when(key % 7 == 0, F.lit(None).cast("timestamp_ntz"))
            .when(key % 11 == 0, shift("o_orderdate", "-1 day"))
            .otherwise(shift("o_orderdate", "1 hour"))
            .alias("order_approved_at"),
            F.col("delivered_at").alias("order_delivered_customer_date"),
            shift("o_orderdate", "60 days").alias("order_estimated_delivery_date"),
        ]

    @cached_property
    def orders(self) -> DataFrame:
        return self._orders(None)

    def orders_of(self, status: str) -> DataFrame:
        return self._orders(status)

    def _orders(self, status: str | None) -> DataFrame:
        arrivals = (
            self._read("lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.max("l_shipdate").alias("delivered_at"))
        )
        return self._placed(status).join(arrivals, "o_orderkey", "left").select(*self._order_columns(status))

    def order_facts(self, payments: bool = True, reviews: bool = True, status: str | None = None) -> DataFrame:
        """One pass over the line items gives both the delivery date and the payment totals.

        The generic version would aggregate and shuffle the largest table twice. Reviews sit on the
        order row itself here and need no join.
        """
        lines = self._read("lineitem").select(
            F.col("l_orderkey").alias("order_id"), "l_shipdate", *self._payment_columns()
        )
        totals = payment_totals(lines, F.max("l_shipdate").alias("delivered_at"))
        if not payments:
            totals = totals.select("order_id", "delivered_at")
        placed = self._placed(status).join(
            totals.withColumnRenamed("order_id", "o_orderkey"), "o_orderkey", "left"
        )
        extra = [c for c in totals.columns if c not in ("order_id", "delivered_at")]
        if reviews:
            score, created = self._review_columns()
            placed = placed.withColumn("_score", score).withColumn("_created", created)
            found = F.col("_score").isNotNull()
            extra += [
                F.when(found, F.col("_score").cast("long")).alias("review_sum"),
                F.when(found, F.lit(1).cast("long")).alias("review_count"),
                F.when(found, F.col("_created")).alias("latest_review_date"),
            ]
        return placed.select(*self._order_columns(status), *extra)
