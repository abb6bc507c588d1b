"""Every query by name, over the star-schema tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mercantile.functions.expressions import churn_score, ratio, round_to
from mercantile.ml import churn_model, clv_model, features, forecast_model, metrics, split
from mercantile.ml.parallel import together
from mercantile.operators import (
    audits,
    campaigns,
    churn,
    cleaning,
    cohorts,
    customers,
    order_grain,
    products,
    reports,
    revenue,
    rfm,
    scoring,
    usage,
)
from mercantile.operators.paging import PageIndex
from mercantile.plans.warehouse import Warehouse
from mercantile.sources.catalog import MartCatalog
from mercantile.sources.csv_files import load_csv
from mercantile.sources.marts import load_marts
from mercantile.sources.retail import StarSchemaRetail, read_star_table
from mercantile.sources.schemas import STAR_TABLES
from mercantile.streaming import jobs
from mercantile.streaming.metering import CallMeter
from mercantile.streaming.revenue import RevenueLedger

# The test tables end in 2001 and have large monthly figures, so the dates and the floor differ
# from the defaults, which suit the public order dataset.
CHURN_AS_OF = "2001-01-31"
PIVOT_SINCE = "1996-01-01"
REVENUE_FLOOR = 12_000_000
# At most 99 calls per key and month exist, so the tiers are scaled to let the limits act.
TIER_CALLS = {"starter": 60, "growth": 70, "enterprise": None}

Query = Callable[[SparkSession, str], DataFrame]


# Queries that build several marts from the order facts.
MANY_MARTS = {"executive_summary", "report_kpis", "ml_importance_totals"}


def warehouse(spark: SparkSession, directory: str, store_facts: bool = False) -> Warehouse:
    return Warehouse(spark, StarSchemaRetail(spark, directory), churn_as_of=CHURN_AS_OF, store_facts=store_facts)


def api_calls(spark: SparkSession, directory: str) -> DataFrame:
    """Events read as calls: the user is the key, and the key's tier follows from its number."""
    return as_calls(read_star_table(spark, directory, "events"))


def as_calls(events: DataFrame) -> DataFrame:
    tier = F.when(F.col("user_id") % 3 == 0, "starter").when(F.col("user_id") % 3 == 1, "growth")
    return events.select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("api_key"), tier.otherwise("enterprise").alias("tier"), "ts"
    )


def money(df: DataFrame, *columns: str) -> DataFrame:
    """DECIMAL money shown as DOUBLE."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _cleaning() -> dict[str, Callable[[Warehouse], DataFrame]]:
    def missing(w: Warehouse) -> DataFrame:
        t = w.tables
        return audits.missing_values(
            {
                "products": (t.products, ["product_category_name", "product_weight_g"]),
                "order_reviews": (t.reviews, ["review_score", "review_creation_date"]),
                "orders": (t.order_facts(False, False), ["order_approved_at", "order_delivered_customer_date"]),
            }
        )

    def duplicates(w: Warehouse) -> DataFrame:
        t = w.tables
        return audits.duplicate_keys(
            {
                "customers": (t.customers, ["customer_id"]),
                "products": (t.products, ["product_id"]),
                "orders": (t.order_facts(False, False), ["order_id"]),
                "order_reviews": (t.reviews, ["review_id"]),
                "order_payments": (t.payments, ["order_id", "payment_sequential"]),
            }
        )

    def orphans(w: Warehouse) -> DataFrame:
        t = w.tables
        orders = t.order_facts(False, False)
        return audits.orphans(
            {
                "orders.customer_id": (orders, "customer_id", t.customers, "customer_id"),
                "orders_clean.customer_id": (cleaning.orders_clean(orders), "customer_id", t.customers, "customer_id"),
                "order_reviews.order_id": (t.reviews, "order_id", orders, "order_id"),
                "order_payments.order_id": (t.payments, "order_id", orders, "order_id"),
            }
        )

    def domain(w: Warehouse) -> DataFrame:
        orders = w.tables.order_facts(False, False)
        return audits.domain_violations(
            {
                "review_score in 1..5": (w.tables.reviews, F.col("review_score").between(1, 5)),
                "approved_at >= purchase": (
                    orders,
                    F.col("order_approved_at") >= F.col("order_purchase_timestamp"),
                ),
            }
        )

    def cities(w: Warehouse) -> DataFrame:
        names = cleaning.standardize_text(w.tables.products, "product_name", ("%ring%",), "i", "y")
        return cleaning.count_matching(names, "product_name", "%ryng%")

    return {
        "products_clean": lambda w: cleaning.products_clean(w.tables.products),
        "city_standardize": cities,
        "orders_clean": lambda w: cleaning.orders_clean(w.tables.order_facts(False, False, cleaning.DELIVERED)),
        "order_review_agg": lambda w: order_grain.order_review_agg(w.tables.reviews),
        "order_revenue": lambda w: money(order_grain.order_revenue(w.tables.payments), "total_order_payment"),
        "order_status_distribution": lambda w: audits.status_distribution(w.tables.order_facts(False, False)),
        "customer_counts": lambda w: audits.customer_counts(w.tables.customers),
        "dq_missing": missing,
        "dq_duplicate_keys": duplicates,
        "dq_orphans": orphans,
        "dq_domain": domain,
        "dq_reconcile_revenue": lambda w: audits.reconcile_revenue(
            w.tables.payments, order_grain.order_revenue(w.tables.payments)
        ),
    }


def _sources() -> dict[str, Callable[[Warehouse], DataFrame]]:
    def documents(w: Warehouse) -> DataFrame:
        # Texts hold line breaks and quotes; the columns are in another order in the files.
        docs = w.spark.read.parquet(f"{w.tables.directory}/documents.parquet").select("n_chars", "text", "lang", "doc_id", "source")
        folder = w.scratch.path("csv")
        kept = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        docs.write.options(header=True, **kept).csv(folder)
        schema = StructType([docs.schema[c] for c in ("doc_id", "text", "lang", "source", "n_chars")])
        return load_csv(w.spark, folder, schema).table

    def published(w: Warehouse) -> DataFrame:
        """Marts written by version and read back by their manifests."""
        folder, chosen = w.scratch.path("marts"), {"monthly_revenue": w.monthly_revenue, "churn_summary": w.churn_summary, "cohort_retention": w.cohort_retention_by_churn}
        catalog = MartCatalog(w.spark, folder)
        for name, df in chosen.items():
            catalog.publish(name, df)
            catalog.verify(name)
        found, _ = load_marts(w.spark, folder, chosen, "parquet")
        parts = [df.agg(F.lit(name).alias("mart"), F.count(F.lit(1)).alias("rows")) for name, df in found.items()]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return {"csv_documents": documents, "marts_published": published}


def _customers() -> dict[str, Callable[[Warehouse], DataFrame]]:
    return {
        "customer_retention_base": lambda w: money(w.retention_base, "total_revenue"),
        "churn_label_90d": lambda w: w.retention_base.select(
            "customer_unique_id", "last_order_date", "recency_days", "churn_label"
        ),
        "churn_summary": lambda w: money(w.churn_summary, "revenue"),
        "churn_metrics": lambda w: w.churn_metrics,
        "one_time_buyer_pct": lambda w: customers.one_time_buyer_pct(w.customer_base_plan()),
        "delay_vs_review": lambda w: customers.delay_vs_review(w.customer_base_plan()),
        "review_vs_repeat": lambda w: customers.review_vs_repeat(w.customer_base_plan()),
        "customer_rfm": lambda w: money(w.rfm.drop("rfm_segment"), "monetary"),
        "rfm_segments": lambda w: money(w.rfm, "monetary"),
        "rfm_validation": lambda w: rfm.rfm_validation(w.rfm),
        "churn_by_segment": lambda w: customers.churn_by_segment(w.rfm_labelled),
        "segment_distribution": lambda w: rfm.segment_distribution(w.rfm),
        "segment_metrics": lambda w: rfm.segment_metrics(w.rfm),
        "segment_characteristics": lambda w: rfm.segment_characteristics(w.rfm),
        "rfm_score_stats": lambda w: rfm.score_stats(w.scratch.store(w.paying, "paying"), w.scratch),
        "rfm_score_histogram": lambda w: rfm.score_histogram(w.rfm),
        "high_value_customers": lambda w: money(rfm.high_value_customers(w.rfm, w.scratch), "monetary"),
        "churn_risk_summary": lambda w: rfm.churn_risk_summary(w.scratch.store(w.paying, "paying"), w.scratch),
        "marketing_segments": lambda w: rfm.marketing_segments(w.rfm),
        "churn_label_from_segment": lambda w: money(rfm.churn_label_from_segment(w.rfm), "monetary"),
    }


def _cohorts() -> dict[str, Callable[[Warehouse], DataFrame]]:
    def first_months(w: Warehouse) -> DataFrame:
        return cohorts.customer_cohorts(w.tables.order_facts(False, False, cleaning.DELIVERED), w.tables.customers)

    def whole_pivot(label: int) -> Callable[[Warehouse], DataFrame]:
        return lambda w: cohorts.cohort_pivot_rows(w.scratch.store(w.cohort_retention_by_churn, "retention"), label)

    return {
        "customer_cohorts": first_months,
        "monthly_activity": lambda w: cohorts.monthly_activity(w.customer_months),
        "cohort_retention": lambda w: w.cohort_retention,
        "cohort_retention_by_churn": lambda w: w.cohort_retention_by_churn,
        "cohort_pivot": lambda w: cohorts.cohort_pivot(w.cohort_retention, since=PIVOT_SINCE),
        "cohort_pivot_by_label": whole_pivot(1),
        "cohort_pivot_active": whole_pivot(0),
        "avg_retention_by_offset": lambda w: cohorts.avg_retention_by_offset(w.cohort_retention),
        "retention_summary": lambda w: cohorts.retention_summary(w.cohort_retention_by_churn, 1),
        "retention_summary_active": lambda w: cohorts.retention_summary(w.cohort_retention_by_churn, 0),
        "cohort_performance": lambda w: cohorts.cohort_performance(w.cohort_retention_by_churn),
    }


def _revenue() -> dict[str, Callable[[Warehouse], DataFrame]]:
    def by_grain(grain: str) -> Callable[[Warehouse], DataFrame]:
        return lambda w: money(revenue.period_revenue(w.tables.order_facts(reviews=False, status=cleaning.DELIVERED), grain), "revenue")

    return {
        "monthly_revenue": lambda w: money(w.monthly_revenue_plan(), "revenue").orderBy("month"),
        "daily_revenue": by_grain("day"),
        "weekly_revenue": by_grain("week"),
        "monthly_revenue_by_category": lambda w: money(w.monthly_by_category, "revenue"),
        "revenue_summary": lambda w: revenue.revenue_summary(w.monthly_revenue, REVENUE_FLOOR),
        "revenue_growth": lambda w: revenue.revenue_growth(w.monthly_revenue, floor=REVENUE_FLOOR),
        "revenue_growth_by_state": lambda w: revenue.revenue_growth(w.monthly_by_state, ["customer_state"], 300_000),
        "revenue_trends": lambda w: revenue.revenue_trends(w.monthly_revenue),
        "revenue_forecast": lambda w: revenue.revenue_forecast(w.monthly_revenue),
        "revenue_forecast_by_state": lambda w: revenue.revenue_forecast(w.monthly_by_state, 3, ["customer_state"]),
        "seasonality": lambda w: revenue.seasonality(w.monthly_revenue),
        "seasonality_index": lambda w: revenue.seasonality_index(w.monthly_revenue),
        "report_monthly": lambda w: revenue.report_monthly(w.monthly_revenue),
    }


def _products() -> dict[str, Callable[[Warehouse], DataFrame]]:
    return {
        "category_revenue_rank": lambda w: products.category_revenue_rank(
            w.tables.order_items, w.tables.products, w.tables.category_translation
        ),
        "top_categories": lambda w: products.top_categories(w.categories),
        "top_sellers": lambda w: w.top_sellers,
        "top_categories_layout": lambda w: products.top_categories(w.categories_by_layout),
        "top_sellers_layout": lambda w: products.top_sellers(w.sellers_by_layout),
        "top_states": lambda w: products.top_states(w.states),
        "category_insights": lambda w: products.category_insights(w.categories),
        "seller_insights": lambda w: products.seller_insights(w.top_sellers),
    }


def _scoring() -> dict[str, Callable[[Warehouse], DataFrame]]:
    def detail(w: Warehouse) -> DataFrame:
        return scoring.customer_detail(w.rfm, w.tables.customers, w.churn_raw)

    def listed(w: Warehouse) -> DataFrame:
        return scoring.customer_list(w.rfm)

    return {
        "churn_features": lambda w: w.churn_features,
        "class_distribution": lambda w: churn.class_distribution(w.churn_raw),
        "customer_list": listed,
        "customer_page": lambda w: scoring.page(listed(w), "customer_unique_id", 100, 200),
        "customer_page_deep": lambda w: PageIndex.build(listed(w), "customer_unique_id", w.scratch).page(100, 600),
        "customer_page_after": lambda w: PageIndex.build(listed(w), "customer_unique_id", w.scratch).after(400, 100),
        "customer_page_starter": lambda w: scoring.page(listed(w), "customer_unique_id", 100, 0, "starter"),
        "customer_detail": detail,
        "score_customers": lambda w: scoring.score_requests(w.churn_features, "customer_unique_id"),
        "score_rejects": lambda w: scoring.rejected_requests(w.churn_features).select(
            "customer_unique_id", "failed_fields"
        ),
        "churn_predictions": lambda w: scoring.riskiest(w.segment_probability).withColumn(
            "churn_probability", round_to("churn_probability", 6)
        ),
        "risk_band_totals": lambda w: scoring.risk_band_totals(w.segment_probability),
        "churn_risk_split": lambda w: scoring.churn_risk_split(w.segment_probability),
        "high_risk_list": lambda w: scoring.high_risk_list(w.segment_probability),
        "campaign_plan": lambda w: campaigns.campaign_plan(w.rfm),
        "retention_scenarios": lambda w: campaigns.retention_scenarios(w.churn_raw),
        "retention_scenarios_by_segment": lambda w: campaigns.retention_scenarios(
            w.rfm_labelled, ["rfm_segment"]
        ),
        "marketing_recommendations": lambda w: campaigns.marketing_recommendations(
            rfm.segment_distribution(w.rfm), w.churn_metrics
        ),
    }


def _reports() -> dict[str, Callable[[Warehouse], DataFrame]]:
    def kpis(w: Warehouse) -> DataFrame:
        growth = revenue.revenue_growth(w.monthly_revenue, floor=REVENUE_FLOOR)
        return reports.report_kpis(w.monthly_revenue, w.paying, w.churn_raw, growth)

    def summary(w: Warehouse) -> DataFrame:
        people = w.paying.agg(
            F.count(F.lit(1)).alias("total_customers"),
            ratio(F.sum("monetary"), F.count(F.lit(1))).alias("avg_revenue_per_customer"),
        )
        return reports.executive_summary(
            revenue.revenue_summary(w.monthly_revenue, REVENUE_FLOOR),
            people,
            w.churn_metrics,
            cohorts.retention_summary(w.cohort_retention_by_churn, 1),
            products.category_insights(w.categories),
        )

    return {
        "report_kpis": kpis,
        "report_segments": lambda w: rfm.report_segments(w.rfm),
        "executive_summary": summary,
    }


def _usage() -> dict[str, Query]:
    return {
        "usage_metering": lambda s, d: usage.monthly_usage(api_calls(s, d), TIER_CALLS),
        "usage_call_flags": lambda s, d: usage.flag_calls(api_calls(s, d), TIER_CALLS),
    }


def scored_customers(w: Warehouse) -> DataFrame:
    """Customers with their heuristic churn score as probability and as a yes/no prediction."""
    return (
        scoring.valid_requests(w.churn_features)
        .select("customer_unique_id", "churn_label", round_to(churn_score(), 3).alias("probability"))
        .withColumn("prediction", F.when(F.col("probability") >= 0.5, 1).otherwise(0))
    )


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: round_to(c, places) for c in columns})


def _model_inputs() -> dict[str, Callable[[Warehouse], DataFrame]]:
    names = features.CHURN_FEATURES
    key = "customer_unique_id"

    def naive_forecast(w: Warehouse) -> DataFrame:
        rows = forecast_model.forecast_features(w.monthly_by_state, ["customer_state"])
        quality = metrics.regression_metrics(rows.where("lag_1 IS NOT NULL"), "revenue", "lag_1")
        return rounded(quality, 6, "mae", "rmse", "mape", "r2")

    def clv_rows(w: Warehouse) -> DataFrame:
        customers_ = clv_model.clv_customers(w.retention_base)
        return features.clv_training_set(customers_, features.clv_feature_names(customers_.columns), w.scratch)

    def feature_table(w: Warehouse, monthly: DataFrame, series: list[str]) -> DataFrame:
        table = forecast_model.forecast_features(monthly, series)
        return rounded(table, 6, "rolling_std_3", "month_sin", "month_cos")

    return {
        "ml_features": lambda w: features.impute_median(w.churn_raw, names, w.scratch),
        "ml_standardize": lambda w: rounded(
            features.standardize(w.churn_features, names).select(key, *names), 6, *names
        ),
        "ml_split": lambda w: split.stratified(w.churn_raw.select(key, "churn_label"), key, "churn_label", w.scratch),
        "split_by_recency": lambda w: split.by_recency(w.churn_raw.select(key, "recency_days"), key, w.scratch),
        "class_weights": lambda w: metrics.class_weights(w.churn_raw),
        "eval_binary": lambda w: metrics.binary_metrics(scored_customers(w)),
        "eval_ranking": lambda w: rounded(
            metrics.ranking_metrics(scored_customers(w), w.scratch), 9, "roc_auc", "average_precision"
        ),
        "eval_regression": naive_forecast,
        "forecast_features": lambda w: feature_table(w, w.monthly_revenue, []),
        "forecast_features_by_category": lambda w: feature_table(w, w.monthly_by_category, ["category"]),
        "clv_training_set": clv_rows,
    }


def _models() -> dict[str, Callable[[Warehouse], DataFrame]]:
    key = "customer_unique_id"

    def churn_scores(w: Warehouse) -> DataFrame:
        return w.model_probability.select(key, "prediction", "churn_probability", "risk_level")

    def likeliest(band: str | None = None, limit: int = 100) -> Callable[[Warehouse], DataFrame]:
        return lambda w: scoring.riskiest(w.model_probability, limit, band)

    def hand_off(w: Warehouse) -> DataFrame:
        scored = w.model_probability.select(key, "churn_probability")
        return scoring.high_risk_list(scored.join(w.rfm.select(key, "rfm_segment"), key, "left"))

    def importances(w: Warehouse) -> DataFrame:
        return w.churn_model.importances(w.churn_raw)

    def clv(w: Warehouse) -> tuple[clv_model.ClvModel, DataFrame]:
        people = clv_model.clv_customers(w.retention_base)
        return clv_model.fitted(people, w.scratch, store=w.models)[0], people

    def clv_scores(w: Warehouse) -> DataFrame:
        model, people = clv(w)
        return model.score(people, w.scratch)

    def forecast(w: Warehouse) -> tuple[forecast_model.ForecastModel, DataFrame]:
        return forecast_model.train(w.monthly_by_category, w.scratch, ["category"], store=w.models)

    def clv_importances(w: Warehouse) -> DataFrame:
        model, people = clv(w)
        return model.importances(people)

    def forecast_importances(w: Warehouse) -> DataFrame:
        return forecast(w)[0].importances(w.monthly_by_category)

    def importance_totals(w: Warehouse) -> DataFrame:
        """What holds for the importances of any forest: none below 0, together 1."""
        w.order_facts()  # stored before the fits run at once: all three start from them
        fits = {"churn": importances, "clv": clv_importances, "forecast": forecast_importances}
        found = dict(zip(fits, together(w.spark, [partial(fit, w) for fit in fits.values()]), strict=True))
        parts = [rows.select(F.lit(name).alias("model"), "feature", "importance") for name, rows in found.items()]
        return reduce(DataFrame.unionByName, parts).groupBy("model").agg(
            F.count(F.lit(1)).alias("features"), round_to(F.sum("importance"), 6).alias("total"), F.count_if(F.col("importance") < 0).alias("negative")
        )

    def score_checks(w: Warehouse) -> DataFrame:
        """Every customer once, with what holds for the scores of any model."""
        p = F.col("churn_probability")
        band = F.when(p <= 0.2, "Low").when(p <= 0.4, "Medium").when(p <= 0.6, "High").otherwise("Critical")
        return w.model_probability.select(
            key,
            p.between(0.0, 1.0).alias("in_range"),
            (F.col("risk_level") == band).alias("band_fits"),
            ((F.col("prediction") == 1) == (p > 0.5)).alias("prediction_fits"),
        )

    def clv_checks(w: Warehouse) -> DataFrame:
        value = F.col("predicted_ltv")
        return clv_scores(w).select(key, (value >= 0).alias("not_negative"), F.col("ltv_segment").isNotNull().alias("has_segment"))

    def horizons(w: Warehouse) -> DataFrame:
        return forecast(w)[0].forecast(6).select("category", "month", "forecast_horizon", (F.col("forecasted_revenue") >= 0).alias("not_negative"))

    def folds(w: Warehouse) -> DataFrame:
        return split.stratified_folds(w.churn_raw.select(key, "churn_label"), key, "churn_label", w.scratch)

    return {
        "ml_churn_train": lambda w: churn_model.train(w.churn_features, w.scratch, store=w.models)[1],
        "ml_churn_train_by_recency": lambda w: churn_model.train(
            w.churn_features, w.scratch, exclude_time=True, use_time_split=True, store=w.models
        )[1],
        "ml_importance": importances,
        "ml_churn_score": churn_scores,
        "ml_churn_predictions": likeliest(),
        "ml_churn_predictions_high": likeliest("high"),
        "ml_churn_predictions_medium": likeliest("medium"),
        "ml_churn_predictions_low": likeliest("low"),
        "ml_churn_riskiest": likeliest(limit=5),
        "ml_churn_risk_split": lambda w: scoring.churn_risk_split(w.model_probability),
        "ml_risk_band_totals": lambda w: scoring.risk_band_totals(w.model_probability),
        "ml_high_risk_list": hand_off,
        "ml_customer_detail": lambda w: scoring.customer_detail(w.rfm, w.tables.customers, w.model_probability),
        "ml_folds": folds,
        "ml_cv": lambda w: churn_model.cross_validate(w.churn_features, w.scratch, exclude_time=True, store=w.models),
        "ml_ablation": lambda w: churn_model.ablation(w.churn_features, w.scratch, store=w.models),
        "ml_forecast": lambda w: forecast(w)[1],
        "ml_forecast_recursive": lambda w: forecast(w)[0].forecast(6),
        "ml_forecast_horizons": horizons,
        "ml_forecast_importance": forecast_importances,
        "ml_clv": lambda w: clv_model.train(clv_model.clv_customers(w.retention_base), w.scratch, store=w.models)[1],
        "ml_clv_score": clv_scores,
        "ml_clv_checks": clv_checks,
        "ml_clv_importance": clv_importances,
        "ml_churn_checks": score_checks,
        "ml_importance_totals": importance_totals,
    }


def _streams() -> dict[str, Callable[[Warehouse], DataFrame]]:
    def requests(w: Warehouse) -> DataFrame:
        folder = w.scratch.path("requests")
        w.churn_features.write.parquet(folder)
        return jobs.parquet_stream(w.spark, folder, w.churn_features.schema)

    def written(w: Warehouse, frame: DataFrame) -> DataFrame:
        results = w.scratch.path("results")
        jobs.run_to_parquet(frame, results, w.scratch.path("results_checkpoint"))
        return w.spark.read.schema(frame.schema).parquet(results)

    def scores(w: Warehouse) -> DataFrame:
        return written(w, jobs.score_stream(requests(w), "customer_unique_id"))

    def rejects(w: Warehouse) -> DataFrame:
        return written(w, jobs.reject_stream(requests(w), "customer_unique_id"))

    def monthly(w: Warehouse) -> DataFrame:
        orders = w.scratch.store(w.tables.order_facts(False, False, cleaning.DELIVERED), "orders")
        lines = jobs.parquet_stream(w.spark, f"{w.tables.directory}/lineitem.parquet", STAR_TABLES["lineitem"])
        totals = RevenueLedger(w.spark, w.scratch.path("revenue"), orders)
        totals.run(w.tables.payments_of(lines))
        return money(totals.monthly(), "revenue")

    def flagged(w: Warehouse) -> DataFrame:
        # The calls arrive in eight files, two at a time, and every file has calls of all months.
        landing = w.scratch.path("landing")
        calls = api_calls(w.spark, w.tables.directory)
        calls.repartition(8, "call_id").write.parquet(landing)
        meter = CallMeter(w.spark, w.scratch.path("meter"), TIER_CALLS, calls.schema["api_key"].dataType.simpleString())
        meter.run(jobs.parquet_stream(w.spark, landing, calls.schema, files_per_batch=2))
        return meter.flags()

    def metered(w: Warehouse) -> DataFrame:
        calls = as_calls(jobs.parquet_stream(w.spark, f"{w.tables.directory}/events.parquet", STAR_TABLES["events"]))
        results = w.scratch.path("calls")
        jobs.run_to_parquet(calls, results, w.scratch.path("calls_checkpoint"))
        return usage.monthly_usage(w.spark.read.schema(calls.schema).parquet(results), TIER_CALLS)

    return {
        "stream_score": scores,
        "stream_rejects": rejects,
        "stream_monthly_revenue": monthly,
        "stream_usage": metered,
        "stream_call_flags": flagged,
    }


def all_queries() -> dict[str, Query]:
    queries: dict[str, Query] = {}
    groups = (_sources, _cleaning, _customers, _cohorts, _revenue, _products, _scoring, _reports, _model_inputs, _models, _streams)
    for group in groups:
        for name, plan in group().items():
            many = name in MANY_MARTS
            queries[name] = lambda spark, directory, plan=plan, many=many: plan(warehouse(spark, directory, many))
    queries.update(_usage())
    return queries
