"""Revenue per period: series, trends, growth, seasonality and a closed-form forecast.

Every function that walks a series takes ``series``, the columns that name it. A series has one row
per period, so its window is bounded by the calendar; many series spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercantile.functions.dates import period_of
from mercantile.functions.expressions import dollars, percent, ratio, round_to, row_count, signed_percent
from mercantile.operators.cleaning import orders_clean


def period_revenue(order_facts: DataFrame, grain: str = "month") -> DataFrame:
    """Revenue of clean orders that have a payment, per day, week or month."""
    return (
        orders_clean(order_facts)
        .where(F.col("payment_rows").isNotNull())
        .groupBy(period_of("order_purchase_timestamp", grain).alias("month" if grain == "month" else "period"))
        .agg(F.sum("payment_total").alias("revenue"))
    )


def monthly_revenue(order_facts: DataFrame) -> DataFrame:
    return period_revenue(order_facts, "month")


def monthly_revenue_by_state(order_facts: DataFrame, customers: DataFrame) -> DataFrame:
    """Monthly revenue per customer state; orders are folded per account and month before the join."""
    month = period_of("order_purchase_timestamp", "month").alias("month")
    accounts = (
        orders_clean(order_facts)
        .where(F.col("payment_rows").isNotNull())
        .groupBy("customer_id", month)
        .agg(F.sum("payment_total").alias("paid"))
    )
    return (
        accounts.join(customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state", "month")
        .agg(F.sum("paid").alias("revenue"))
    )


def monthly_revenue_by_category(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Monthly item revenue per category; items are folded per product and month before the join."""
    placed = orders_clean(orders).select(
        "order_id", period_of("order_purchase_timestamp", "month").alias("month")
    )
    per_product = (
        items.select("order_id", "product_id", "price")
        .join(placed, "order_id")
        .groupBy("product_id", "month")
        .agg(F.sum("price").alias("price"))
    )
    category = F.coalesce("product_category_name", F.lit("Unknown")).alias("category")
    return (
        per_product.join(products.select("product_id", category), "product_id")
        .groupBy("category", "month")
        .agg(F.sum("price").alias("revenue"))
    )


def _ordered(series: Sequence[str]):
    return Window.partitionBy(*series).orderBy("month")


def rolling(aggregate, column: str, size: int, ordered) -> Column:
    """Aggregate over the last ``size`` rows, NULL until there are that many."""
    frame = ordered.rowsBetween(1 - size, 0)
    return F.when(F.count(column).over(frame) == size, aggregate(frame))


def rolling_mean(column: str, size: int, ordered) -> Column:
    """Mean over the last ``size`` rows from an exact sum; ``column`` is DECIMAL."""
    return rolling(lambda frame: F.sum(column).over(frame).cast("double") / size, column, size, ordered)


def change_pct(value: Column, previous: Column) -> Column:
    """Percent change in DOUBLE; NULL when there is no previous value or it is 0."""
    return (F.try_divide(value.cast("double"), previous.cast("double")) - 1.0) * 100.0


def revenue_trends(monthly: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Three and six month means and the change on the month before."""
    ordered = _ordered(series)
    return monthly.select(
        *series,
        "month",
        F.col("revenue").cast("double").alias("revenue"),
        rolling_mean("revenue", 3, ordered).alias("rolling_avg_3m"),
        rolling_mean("revenue", 6, ordered).alias("rolling_avg_6m"),
        change_pct(F.col("revenue"), F.lag("revenue").over(ordered)).alias("mom_growth"),
    )


def revenue_growth(monthly: DataFrame, series: Sequence[str] = (), floor: float = 10000) -> DataFrame:
    """Three growth rates per series.

    ``cagr_pct`` compounds between the first and last month with revenue >= floor, over the number
    of rows between them. ``simple_growth_pct`` compares the first and last month.
    ``filtered_growth_pct`` does so among months with revenue > floor. Each is 0 where it is not
    defined, and when there are fewer than two months to compare.
    """
    numbered = monthly.withColumn("position", F.row_number().over(_ordered(series)) - 1)
    value, at = F.col("revenue").cast("double"), F.col("position")
    large, above = value >= floor, value > floor

    def first(keep: Column | None = None, what: Column = value) -> Column:
        return F.min_by(what, at if keep is None else F.when(keep, at))

    def last(keep: Column | None = None, what: Column = value) -> Column:
        return F.max_by(what, at if keep is None else F.when(keep, at))

    ends = numbered.groupBy(*series).agg(
        row_count().alias("months"),
        first().alias("first_value"),
        last().alias("last_value"),
        first(large).alias("large_first"),
        last(large).alias("large_last"),
        (F.max(F.when(large, at)) - F.min(F.when(large, at))).alias("periods"),
        F.count_if(above).alias("above"),
        first(above).alias("above_first"),
        last(above).alias("above_last"),
    )
    growth = F.when(
        (F.col("periods") > 0) & (F.col("large_first") > 0),
        round_to((F.pow(F.col("large_last") / F.col("large_first"), 1.0 / F.col("periods")) - 1.0) * 100.0, 2),
    )

    def simple(count: str, begin: str, end: str) -> Column:
        rate = (F.col(end) - F.col(begin)) / F.col(begin) * 100.0
        return F.when((F.col(count) >= 2) & (F.col(begin) > 0), rate)

    zero = F.lit(0.0)
    return ends.select(
        *series,
        F.coalesce(growth, zero).alias("cagr_pct"),
        F.coalesce(simple("months", "first_value", "last_value"), zero).alias("simple_growth_pct"),
        F.coalesce(simple("above", "above_first", "above_last"), zero).alias("filtered_growth_pct"),
    )


def revenue_summary(monthly: DataFrame, floor: float = 10000) -> DataFrame:
    """Total, mean, extremes, length and compound growth of the series in one row."""
    figures = monthly.agg(
        F.sum("revenue").cast("double").alias("total_revenue"),
        ratio(F.sum("revenue"), row_count()).alias("avg_monthly_revenue"),
        F.max("revenue").cast("double").alias("max_monthly_revenue"),
        F.min("revenue").cast("double").alias("min_monthly_revenue"),
        row_count().alias("months_of_data"),
    )
    growth = revenue_growth(monthly, floor=floor).select(F.col("cagr_pct").alias("growth_rate"))
    return figures.crossJoin(F.broadcast(growth))


def revenue_forecast(monthly: DataFrame, periods: int = 3, series: Sequence[str] = ()) -> DataFrame:
    """Last three-month mean times the mean recent growth factor, compounded, for the next months.

    A series shorter than three months yields no rows.
    """
    backwards = Window.partitionBy(*series).orderBy(F.desc("month"))
    recent = revenue_trends(monthly, series).withColumn("back", F.row_number().over(backwards)).where("back <= 3")
    basis = (
        recent.groupBy(*series)
        .agg(
            row_count().alias("months"),
            F.max("month").alias("last_month"),
            F.max(F.when(F.col("back") == 1, F.col("rolling_avg_3m"))).alias("base"),
            *[F.max(F.when(F.col("back") == b, F.col("mom_growth"))).alias(f"g{b}") for b in (1, 2, 3)],
        )
        .where("months = 3")
    )
    known = [F.col(f"g{b}") for b in (3, 2, 1)]
    total = sum((F.coalesce(g, F.lit(0.0)) for g in known), F.lit(0.0))
    count = sum((F.when(g.isNotNull(), 1).otherwise(0) for g in known), F.lit(0))
    factor = F.lit(1.0) + F.try_divide(total, count.cast("double")) / 100.0
    step = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("forecast_horizon")
    return basis.select(*series, "last_month", "base", factor.alias("factor"), step).select(
        *series,
        F.add_months("last_month", F.col("forecast_horizon")).alias("month"),
        "forecast_horizon",
        round_to(F.col("base") * F.pow("factor", F.col("forecast_horizon").cast("double")), 2).alias(
            "forecasted_revenue"
        ),
    )


def seasonality_index(monthly: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Mean revenue per calendar month, and its ratio to the mean of those means."""
    per_month = monthly.groupBy(*series, F.month("month").alias("month_num")).agg(
        F.sum("revenue").alias("total"), row_count().alias("n")
    )
    mean = round_to(ratio(F.col("total"), F.col("n")), 6)
    overall = F.avg(F.col("avg_revenue")).over(Window.partitionBy(*series))
    return per_month.withColumn("avg_revenue", mean).select(
        *series,
        "month_num",
        "avg_revenue",
        round_to(F.try_divide(F.col("avg_revenue"), overall), 9).alias("seasonality_index"),
    )


def seasonality(monthly: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Best and worst calendar month (the earlier one on a tie)."""
    mean, number = F.col("avg_revenue"), F.col("month_num")
    return (
        seasonality_index(monthly, series)
        .groupBy(*series)
        .agg(
            F.max_by(number, F.struct(mean, -number)).alias("best_month"),
            F.max(mean).alias("best_month_revenue"),
            F.min_by(number, F.struct(mean, number)).alias("worst_month"),
            F.min(mean).alias("worst_month_revenue"),
        )
    )


def report_monthly(monthly: DataFrame) -> DataFrame:
    """Monthly table of the printed report: blank growth without a positive month before."""
    ordered = _ordered(())
    value = F.col("revenue").cast("double")
    before = F.lag("revenue").over(ordered).cast("double")
    growth = F.when(before > 0, signed_percent((value - before) / before * 100.0)).otherwise("")
    return monthly.select(
        F.col("month").alias("date"), dollars(value).alias("revenue"), growth.alias("growth")
    ).orderBy("date")


def share_pct(part: Column, whole: Column) -> Column:
    return round_to(percent(part, whole), 2)
