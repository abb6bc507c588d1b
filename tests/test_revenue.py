"""Published monthly series and the figures that follow from it."""

from datetime import date
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mercantile.operators import revenue

# Monthly revenue of the public order dataset.
SERIES = {
    "2016-10-01": 46566.71,
    "2016-12-01": 19.62,
    "2017-01-01": 127545.67,
    "2017-02-01": 271298.65,
    "2017-03-01": 414369.39,
    "2017-04-01": 390952.18,
    "2017-05-01": 566872.73,
    "2017-06-01": 490225.60,
    "2017-07-01": 566403.93,
    "2017-08-01": 646000.61,
    "2017-09-01": 701169.99,
    "2017-10-01": 751140.27,
    "2017-11-01": 1153393.22,
    "2017-12-01": 843199.17,
    "2018-01-01": 1078606.86,
    "2018-02-01": 966510.88,
    "2018-03-01": 1120678.00,
    "2018-04-01": 1132933.95,
    "2018-05-01": 1128836.69,
    "2018-06-01": 1011561.35,
    "2018-07-01": 1027383.10,
    "2018-08-01": 985414.28,
}


def monthly(spark, pairs):
    data = [(date.fromisoformat(m), Decimal(str(v))) for m, v in pairs]
    return spark.createDataFrame(data, "month date, revenue decimal(18,2)")


def growth(spark, pairs, **options):
    return revenue.revenue_growth(monthly(spark, pairs), **options).first()


def test_published_series(spark):
    series = monthly(spark, SERIES.items())
    summary = revenue.revenue_summary(series).first()
    assert summary["total_revenue"] == pytest.approx(15421082.85)
    assert summary["avg_monthly_revenue"] == pytest.approx(700958.3114, abs=1e-3)
    assert (summary["months_of_data"], summary["growth_rate"]) == (22, 15.64)
    rates = revenue.revenue_growth(series).first()
    assert rates["simple_growth_pct"] == pytest.approx(2016.1346, abs=1e-3)
    assert rates["filtered_growth_pct"] == rates["simple_growth_pct"]
    forecast = [r["forecasted_revenue"] for r in revenue.revenue_forecast(series).orderBy("month").collect()]
    assert forecast == [964736.92, 923221.16, 883491.96]
    season = revenue.seasonality(series).first()
    assert (season["best_month"], season["worst_month"]) == (11, 10)
    assert season["worst_month_revenue"] == pytest.approx(398853.49)


def test_compound_growth_counts_rows_between_the_ends(spark):
    # The small month lies between the ends and still counts as a period.
    got = growth(spark, [("2017-01-01", 10000), ("2017-02-01", 50), ("2017-04-01", 40000)])
    assert got["cagr_pct"] == 100.0
    assert got["simple_growth_pct"] == pytest.approx(300.0)
    # 10000 itself is not above the floor, so one month is left to compare.
    assert got["filtered_growth_pct"] == 0.0


@pytest.mark.parametrize("pairs", [[("2017-01-01", 20000)], [("2017-01-01", 5), ("2017-02-01", 9)]])
def test_growth_needs_two_large_months(spark, pairs):
    assert growth(spark, pairs)["cagr_pct"] == 0.0


def test_growth_from_zero_is_zero(spark):
    assert growth(spark, [("2017-01-01", 0), ("2017-02-01", 9)])["simple_growth_pct"] == 0.0


def test_trends_are_null_until_full(spark):
    got = rows(
        revenue.revenue_trends(monthly(spark, [("2017-01-01", 1), ("2017-02-01", 2), ("2017-03-01", 6)])),
        "month", "rolling_avg_3m", "rolling_avg_6m", "mom_growth",
    )
    assert got == [
        (date(2017, 1, 1), None, None, None),
        (date(2017, 2, 1), None, None, 100.0),
        (date(2017, 3, 1), 3.0, None, 200.0),
    ]


def test_forecast(spark):
    pairs = [("2017-10-01", 100), ("2017-11-01", 110), ("2017-12-01", 121), ("2018-01-01", 133.1)]
    got = rows(revenue.revenue_forecast(monthly(spark, pairs), 2))
    mean = (110 + 121 + 133.1) / 3
    assert [(m, h) for m, h, _ in got] == [(date(2018, 2, 1), 1), (date(2018, 3, 1), 2)]
    assert [v for *_, v in got] == pytest.approx([round(mean * 1.1, 2), round(mean * 1.21, 2)], abs=0.011)


def test_forecast_of_three_months_uses_two_rates(spark):
    got = revenue.revenue_forecast(monthly(spark, [("2017-01-01", 1), ("2017-02-01", 2), ("2017-03-01", 3)]), 1).first()
    assert got["forecasted_revenue"] == pytest.approx(2 * 1.75)


def test_short_series_have_no_forecast_and_do_not_disturb_others(spark):
    long_ = monthly(spark, [("2017-01-01", 1), ("2017-02-01", 2), ("2017-03-01", 3)]).withColumn("s", F.lit("long"))
    short = monthly(spark, [("2017-01-01", 1), ("2017-02-01", 2)]).withColumn("s", F.lit("short"))
    got = revenue.revenue_forecast(long_.unionByName(short), 2, ["s"]).collect()
    assert [r["s"] for r in got] == ["long", "long"]


def test_seasonality_prefers_the_earlier_month_on_a_tie(spark):
    pairs = [("2017-01-01", 5), ("2017-02-01", 9), ("2017-03-01", 9), ("2017-04-01", 5), ("2018-04-01", 5)]
    got = revenue.seasonality(monthly(spark, pairs)).first()
    assert (got["best_month"], got["best_month_revenue"], got["worst_month"]) == (2, 9.0, 1)
    index = revenue.seasonality_index(monthly(spark, pairs)).agg(F.avg("seasonality_index")).first()[0]
    assert index == pytest.approx(1.0)


def test_report_growth_is_blank_after_zero(spark):
    got = rows(revenue.report_monthly(monthly(spark, [("2017-01-01", 0), ("2017-02-01", 1234.5), ("2017-03-01", 617.25)])))
    assert got == [
        (date(2017, 1, 1), "$0.00", ""),
        (date(2017, 2, 1), "$1,234.50", ""),
        (date(2017, 3, 1), "$617.25", "-50.0%"),
    ]


def test_weeks_begin_on_monday(spark):
    from mercantile.functions.dates import period_of

    day = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-03 10:00' AS t")
    assert day.select(period_of("t", "week")).first()[0] == date(2024, 1, 1)
    with pytest.raises(ValueError):
        period_of("t", "year")
