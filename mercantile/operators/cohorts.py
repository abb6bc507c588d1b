"""Cohort retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercantile.functions.dates import month_of, months_between_firsts, shift
from mercantile.functions.expressions import percent, round_to, row_count
from mercantile.operators.cleaning import orders_clean


def customer_months(order_facts: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per person and month with a purchase, with the person's first month and last purchase.

    Orders are folded per account and month before they meet the customers. After that a person has
    one row per calendar month at most, which bounds the window below however many orders there are.
    """
    placed = F.col("order_purchase_timestamp")
    accounts = (
        orders_clean(order_facts)
        .groupBy("customer_id", month_of(placed).alias("activity_month"))
        .agg(F.max(placed).alias("last_placed"))
    )
    people = (
        accounts.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id", "activity_month")
        .agg(F.max("last_placed").alias("last_placed"))
    )
    person = Window.partitionBy("customer_unique_id")
    return people.withColumn("cohort_month", F.min("activity_month").over(person)).withColumn(
        "last_order_date", F.max("last_placed").over(person)
    ).drop("last_placed")


def customer_cohorts(order_facts: DataFrame, customers: DataFrame) -> DataFrame:
    """First purchase month per person."""
    accounts = (
        orders_clean(order_facts).groupBy("customer_id").agg(F.min("order_purchase_timestamp").alias("first_placed"))
    )
    return (
        accounts.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(month_of(F.min("first_placed")).alias("cohort_month"))
    )


def monthly_activity(months: DataFrame) -> DataFrame:
    return months.select("customer_unique_id", "cohort_month", "activity_month")


def _retention(counted: DataFrame, group: Sequence[str]) -> DataFrame:
    """Offsets, sizes and rates from active customers per group and month.

    Everyone is active in the month that made their cohort, so the size of a group is its count at
    offset 0. The window runs over one row per group and month.
    """
    offset = months_between_firsts("activity_month", "cohort_month")
    size = F.max(F.when(F.col("month_offset") == 0, F.col("active_customers"))).over(Window.partitionBy(*group))
    return (
        counted.withColumn("month_offset", offset)
        .withColumn("cohort_size", size)
        .select(
            *group,
            "month_offset",
            "active_customers",
            "cohort_size",
            round_to(percent(F.col("active_customers"), F.col("cohort_size")), 2).alias("retention_rate_pct"),
        )
        .orderBy(*group, "month_offset")
    )


def cohort_retention(months: DataFrame) -> DataFrame:
    counted = months.groupBy("cohort_month", "activity_month").agg(row_count().alias("active_customers"))
    return _retention(counted, ["cohort_month"])


def cohort_retention_by_churn(months: DataFrame, window_days: int = 90) -> DataFrame:
    """Retention within each cohort and churn label. Pass stored ``months``: they are read twice."""
    day = months.agg(F.to_date(F.max("last_order_date")).alias("as_of"))
    gone = shift("last_order_date", f"{window_days} days") < F.col("as_of").cast("timestamp_ntz")
    counted = (
        months.crossJoin(F.broadcast(day))
        .withColumn("churn_label", F.when(gone, 1).otherwise(0))
        .groupBy("cohort_month", "churn_label", "activity_month")
        .agg(row_count().alias("active_customers"))
    )
    return _retention(counted, ["cohort_month", "churn_label"])


def cohort_pivot(retention: DataFrame, offsets: Sequence[int] = range(6), since: str | None = "2017-01-01") -> DataFrame:
    """Retention rate per cohort with one column per month offset."""
    kept = retention if since is None else retention.where(F.col("cohort_month") >= F.lit(since).cast("date"))
    rate = F.col("retention_rate_pct")
    return (
        kept.groupBy("cohort_month")
        .agg(*[F.max(F.when(F.col("month_offset") == o, rate)).alias(f"month_{o}") for o in offsets])
        .orderBy("cohort_month")
    )


def cohort_pivot_by_label(retention: DataFrame, label: int = 0, offsets: Sequence[int] | None = None) -> DataFrame:
    """The pivot of one label. Without ``offsets`` it has every offset that the label's cohorts reach: a column per month."""
    if offsets is None:
        reached = retention.where(F.col("churn_label") == label).select("month_offset").distinct()
        offsets = sorted(r["month_offset"] for r in reached.collect())
    return cohort_pivot(retention.where(F.col("churn_label") == label), offsets, since=None)


def cohort_pivot_rows(retention: DataFrame, label: int = 0) -> DataFrame:
    """The whole pivot of one label as rows: every cohort with every offset that any cohort reaches, NULL where it does not.

    Its columns do not depend on the data. Pass a stored ``retention``: it is read three times.
    """
    own = retention.where(F.col("churn_label") == label).select("cohort_month", "month_offset", "retention_rate_pct")
    # One row with an entry per month.
    reached = own.agg(F.collect_set("month_offset").alias("offsets"))
    grid = own.select("cohort_month").distinct().crossJoin(F.broadcast(reached))
    cells = grid.select("cohort_month", F.explode("offsets").alias("month_offset"))
    return cells.join(own, ["cohort_month", "month_offset"], "left").orderBy("cohort_month", "month_offset")


def avg_retention_by_offset(retention: DataFrame, last_offset: int = 6) -> DataFrame:
    rate = F.col("retention_rate_pct").cast("decimal(9,2)")
    mean = F.sum(rate).cast("double") / row_count()
    return (
        retention.where(F.col("month_offset") <= last_offset)
        .groupBy("month_offset")
        .agg(round_to(mean, 2).alias("avg_retention_pct"))
        .orderBy("month_offset")
    )


def retention_summary(retention: DataFrame, label: int = 1) -> DataFrame:
    """One row over the rows of a churn label; cohorts are counted over all rows."""
    chosen = F.col("churn_label") == label
    rate = F.when(chosen, F.col("retention_rate_pct"))
    exact = F.sum(rate.cast("decimal(9,2)")).cast("double")
    return retention.agg(
        F.countDistinct("cohort_month").alias("total_cohorts"),
        F.try_divide(exact, F.count(rate).cast("double")).alias("avg_retention_rate"),
        F.max(rate).alias("max_retention_rate"),
        F.min(F.when(rate > 0, rate)).alias("min_retention_rate"),
        F.max(F.when(chosen, F.col("month_offset"))).alias("months_of_data"),
    )


def cohort_performance(retention: DataFrame) -> DataFrame:
    """Active customers summed over all months against the size of the first row, per cohort."""
    order = [c for c in ("churn_label", "month_offset") if c in retention.columns]
    first_size = F.min_by("cohort_size", F.struct(*order))
    return (
        retention.groupBy("cohort_month")
        .agg(F.sum("active_customers").alias("active_customers"), first_size.alias("cohort_size"))
        .withColumn(
            "initial_to_current_ratio", round_to(percent(F.col("active_customers"), F.col("cohort_size")), 2)
        )
        .orderBy(F.desc("cohort_month"))
    )
