"""Explicit schemas of the raw retail tables and of the exported marts.

Nothing is inferred at read time: a CSV or Parquet folder is always read with one of these.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MONEY_TOTAL = T.DecimalType(28, 2)

_STR, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_DBL, _DATE, _TS = T.DoubleType(), T.DateType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Raw tables. Column names and file names of the public order dataset.
RAW_TABLES: dict[str, T.StructType] = {
    "customers": _struct(
        customer_id=_STR,
        customer_unique_id=_STR,
        customer_zip_code_prefix=_STR,
        customer_city=_STR,
        customer_state=_STR,
    ),
    "products": _struct(
        product_id=_STR,
        product_category_name=_STR,
        product_name_length=_INT,
        product_description_length=_INT,
        product_photos_qty=_INT,
        product_weight_g=_INT,
        product_length_cm=_INT,
        product_height_cm=_INT,
        product_width_cm=_INT,
    ),
    "geolocation": _struct(
        geolocation_zip_code_prefix=_STR,
        geolocation_lat=_DBL,
        geolocation_lng=_DBL,
        geolocation_city=_STR,
        geolocation_state=_STR,
    ),
    "orders": _struct(
        order_id=_STR,
        customer_id=_STR,
        order_status=_STR,
        order_purchase_timestamp=_TS,
        order_approved_at=_TS,
        order_delivered_carrier_date=_TS,
        order_delivered_customer_date=_TS,
        order_estimated_delivery_date=_TS,
    ),
    "reviews": _struct(
        review_id=_STR,
        order_id=_STR,
        review_score=_INT,
        review_comment_title=_STR,
        review_comment_message=_STR,
        review_creation_date=_TS,
        review_answer_timestamp=_TS,
    ),
    "payments": _struct(
        order_id=_STR,
        payment_sequential=_INT,
        payment_type=_STR,
        payment_installments=_INT,
        payment_value=MONEY,
    ),
    "order_items": _struct(
        order_id=_STR,
        order_item_id=_INT,
        product_id=_STR,
        seller_id=_STR,
        shipping_limit_date=_TS,
        price=MONEY,
        freight_value=MONEY,
    ),
    "sellers": _struct(
        seller_id=_STR,
        seller_zip_code_prefix=_STR,
        seller_city=_STR,
        seller_state=_STR,
    ),
    "category_translation": _struct(
        product_category_name=_STR,
        product_category_name_english=_STR,
    ),
}

RAW_FILES: dict[str, str] = {
    "customers": "olist_customers_dataset.csv",
    "products": "olist_products_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "reviews": "olist_order_reviews_dataset.csv",
    "payments": "olist_order_payments_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "category_translation": "product_category_name_translation.csv",
}

# Star schema from which the retail tables can be derived.
STAR_TABLES: dict[str, T.StructType] = {
    "region": _struct(r_regionkey=_INT, r_name=_STR),
    "nation": _struct(n_nationkey=_INT, n_name=_STR, n_regionkey=_INT),
    "customer": _struct(c_custkey=_LONG, c_name=_STR, c_nationkey=_INT, c_acctbal=_DBL, c_mktsegment=_STR),
    "supplier": _struct(s_suppkey=_LONG, s_name=_STR, s_nationkey=_INT, s_acctbal=_DBL),
    "part": _struct(
        p_partkey=_LONG, p_name=_STR, p_brand=_STR, p_type=_STR, p_size=_INT, p_retailprice=_DBL
    ),
    "orders": _struct(
        o_orderkey=_LONG, o_custkey=_LONG, o_orderstatus=_STR, o_totalprice=_DBL, o_orderdate=_TS, o_orderpriority=_STR
    ),
    "lineitem": _struct(
        l_orderkey=_LONG,
        l_partkey=_LONG,
        l_suppkey=_LONG,
        l_linenumber=_INT,
        l_quantity=_DBL,
        l_extendedprice=_DBL,
        l_discount=_DBL,
        l_tax=_DBL,
        l_returnflag=_STR,
        l_linestatus=_STR,
        l_shipdate=_TS,
    ),
    "events": _struct(event_id=_LONG, ts=_TS, user_id=_LONG, event_type=_STR, value=_DBL, props=_STR),
}

# Marts. File names and column names that existing users already have on disk.
MART_TABLES: dict[str, T.StructType] = {
    "customer_rfm": _struct(
        customer_unique_id=_STR,
        recency_days=_INT,
        frequency=_LONG,
        monetary=MONEY_TOTAL,
        r_score=_INT,
        f_score=_INT,
        m_score=_INT,
        rfm_segment=_STR,
    ),
    "monthly_revenue": _struct(month=_DATE, revenue=MONEY_TOTAL),
    "churn_summary": _struct(churn_label=_INT, count=_LONG, revenue=MONEY_TOTAL),
    "cohort_retention": _struct(
        cohort_month=_DATE,
        churn_label=_INT,
        month_offset=_INT,
        active_customers=_LONG,
        cohort_size=_LONG,
        retention_rate_pct=_DBL,
    ),
    "product_revenue": _struct(category=_STR, product_revenue=MONEY_TOTAL, revenue_pct=_DBL, rank=_INT),
    "top_categories": _struct(
        product_category_name_english=_STR,
        order_count=_LONG,
        revenue=MONEY_TOTAL,
        freight_cost=MONEY_TOTAL,
        profit=MONEY_TOTAL,
        margin_pct=_DBL,
        revenue_pct=_DBL,
    ),
    "top_sellers": _struct(
        seller_id=_STR,
        seller_state=_STR,
        order_count=_LONG,
        revenue=MONEY_TOTAL,
        avg_review=_DBL,
        revenue_pct=_DBL,
    ),
    "top_states": _struct(
        customer_state=_STR,
        order_count=_LONG,
        unique_buyers=_LONG,
        total_revenue=MONEY_TOTAL,
        revenue_pct=_DBL,
    ),
    "customer_churn": _struct(
        customer_unique_id=_STR,
        churn_label=_INT,
        recency_days=_INT,
        frequency=_LONG,
        monetary=_DBL,
        tenure_days=_INT,
        avg_review_score=_DBL,
        late_delivery_rate=_DBL,
        credit_card_rate=_DBL,
        avg_installments=_DBL,
    ),
}
MART_TABLES["rfm_segments"] = MART_TABLES["customer_rfm"]

MART_FILES: dict[str, str] = {
    "customer_rfm": "customer_rfm.csv",
    "rfm_segments": "rfm_segments.csv",
    "monthly_revenue": "monthly_revenue.csv",
    "churn_summary": "churn_summary.csv",
    "cohort_retention": "cohort_retention_with_churn.csv",
    "product_revenue": "Product_catagoryby_revenue.csv",
    "top_categories": "top_categories.csv",
    "top_sellers": "top_sellers.csv",
    "top_states": "top_states.csv",
    "customer_churn": "customer_churn.csv",
}
