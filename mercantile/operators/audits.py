"""Data-quality audits: what a database would enforce as constraints is counted here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercantile.functions.expressions import round_to, row_count


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def missing_values(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows and NULLs per (table, column); each table is scanned once, however many columns."""
    parts = []
    for name, (df, columns) in tables.items():
        counts = df.agg(
            row_count().alias("total_rows"),
            *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
        )
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns]))
        parts.append(
            counts.select("total_rows", pairs.alias("p")).select(
                F.lit(name).alias("table_name"), "p.column_name", "total_rows", "p.missing"
            )
        )
    return _stack(parts)


def duplicate_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per table: how many key values occur more than once, and how many rows are surplus."""
    parts = []
    for name, (df, key) in tables.items():
        repeats = df.groupBy(*key).agg(row_count().alias("n")).where("n > 1")
        parts.append(
            repeats.agg(
                row_count().alias("duplicate_keys"),
                F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus_rows"),
            ).select(F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("key"), "duplicate_keys", "surplus_rows")
        )
    return _stack(parts)


def orphans(references: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows of a child table whose key has no parent.

    The child is folded to (key, rows) first, so a key that fills the child table crosses the
    network once per map task instead of once per row.
    """
    parts = []
    for name, (child, child_key, parent, parent_key) in references.items():
        keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(row_count().alias("n"))
        lost = keys.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
        parts.append(
            lost.agg(
                row_count().alias("orphan_keys"),
                F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orphan_rows"),
            ).select(F.lit(name).alias("reference"), "orphan_keys", "orphan_rows")
        )
    return _stack(parts)


def domain_violations(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Rows for which a check is false (a NULL result passes, as in SQL)."""
    parts = [
        df.agg(row_count().alias("total_rows"), F.count_if(~ok).alias("violations")).select(
            F.lit(name).alias("check_name"), "total_rows", "violations"
        )
        for name, (df, ok) in checks.items()
    ]
    return _stack(parts)


def reconcile_revenue(payments: DataFrame, revenue: DataFrame) -> DataFrame:
    """Total of the raw payments beside the total of the per-order sums (two one-row frames)."""
    raw = payments.agg(F.sum("payment_value").cast("double").alias("raw_total_payments"))
    folded = revenue.agg(F.sum("total_order_payment").cast("double").alias("aggregated_revenue"))
    return raw.crossJoin(F.broadcast(folded))


def customer_counts(customers: DataFrame) -> DataFrame:
    """Distinct account ids and distinct people."""
    return customers.agg(
        F.countDistinct("customer_id").alias("total_customers"),
        F.countDistinct("customer_unique_id").alias("total_unique_customers"),
    )


def status_distribution(orders: DataFrame) -> DataFrame:
    """Orders per status with their share; the share is taken over the small aggregate."""
    total = F.sum("total_orders").over(Window.partitionBy())
    return (
        orders.groupBy("order_status")
        .agg(row_count().alias("total_orders"))
        .withColumn("percentage", round_to(F.col("total_orders") * 100.0 / total.cast("double"), 2))
        .orderBy(F.desc("total_orders"), "order_status")
    )
