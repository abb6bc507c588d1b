"""The registered queries in SQL, for an independent engine to run on the same tables.

All statements share the common table expressions below. Each is written from the meaning of the
query, with plain windows and joins, and none of them follows the Spark plans.
"""

from __future__ import annotations

from mercantile.functions import dimensions as dim
from mercantile.plans.registry import CHURN_AS_OF, PIVOT_SINCE, REVENUE_FLOOR, TIER_CALLS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(column: str, values: dict, default: object = None) -> str:
    def show(v: object) -> str:
        return "NULL" if v is None else _text(v) if isinstance(v, str) else f"{v}::DOUBLE"

    whens = " ".join(f"WHEN {_text(k)} THEN {show(v)}" for k, v in values.items())
    return f"(CASE {column} {whens} ELSE {show(default)} END)"


SEGMENT = "(CASE rfm_segment WHEN 'Potential Loyalists' THEN 'Potential Loyalist' ELSE rfm_segment END)"
OPEN_RISK = f"""({_case(SEGMENT, dim.BASE_RISK, dim.DEFAULT_RISK)}
  * (1::DOUBLE + (least(recency_days::DOUBLE, 180::DOUBLE) / 180::DOUBLE) * 0.2::DOUBLE))"""
RISK = f"greatest(least({OPEN_RISK}, 1::DOUBLE), 0::DOUBLE)"
LTV = "(monetary::DOUBLE * (1::DOUBLE + frequency::DOUBLE * 0.1::DOUBLE))"
ACTION = _case(SEGMENT, dim.RECOMMENDED_ACTION, dim.DEFAULT_ACTION)

COMMON = f"""
WITH customers AS (
  SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
sellers AS (
  SELECT s_suppkey AS seller_id, n_name AS seller_state FROM supplier JOIN nation ON s_nationkey = n_nationkey),
products AS (
  SELECT p_partkey AS product_id, p_brand AS category, p_name AS product_name, p_size AS product_weight_g FROM part),
items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
    l_extendedprice::DECIMAL(18,2) AS price, l_quantity::DECIMAL(18,2) AS freight FROM lineitem),
payments AS (
  SELECT l_orderkey AS order_id, l_linenumber AS seq,
    CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'R' THEN 'boleto' WHEN 'N' THEN 'voucher' END AS kind,
    l_linenumber AS installments, l_extendedprice::DECIMAL(18,2) AS amount FROM lineitem),
reviews AS (
  SELECT o_orderkey AS order_id,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN left(o_orderpriority, 1)::INTEGER END AS score,
    o_orderdate + INTERVAL 10 DAY AS created FROM orders),
arrivals AS (SELECT l_orderkey, max(l_shipdate) AS delivered FROM lineitem GROUP BY 1),
orders_raw AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS status,
    o_orderdate AS placed,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN o_orderdate - INTERVAL 1 DAY
      ELSE o_orderdate + INTERVAL 1 HOUR END AS approved,
    delivered, o_orderdate + INTERVAL 60 DAY AS promised
  FROM orders LEFT JOIN arrivals ON l_orderkey = o_orderkey),
orders_clean AS (SELECT * FROM orders_raw WHERE status = 'delivered' AND delivered IS NOT NULL),
order_revenue AS (SELECT order_id, sum(amount) AS total FROM payments GROUP BY 1),
review_agg AS (
  SELECT order_id, sum(score)::DOUBLE / count(*) AS review, count(*) AS reviews, max(created) AS latest
  FROM reviews WHERE score IS NOT NULL GROUP BY 1),
base0 AS (
  SELECT c.customer_unique_id, min(placed) AS first_order_date, max(placed) AS last_order_date,
    count(DISTINCT o.order_id) AS total_orders, coalesce(sum(total), 0)::DECIMAL(28,2) AS total_revenue,
    sum(total)::DOUBLE / nullif(count(total), 0) AS avg_order_value,
    avg(review) AS avg_review_score,
    avg(extract(DAY FROM (delivered - promised))) AS avg_delivery_difference_days,
    avg(CASE WHEN delivered::DATE > promised::DATE THEN 1::DOUBLE ELSE 0::DOUBLE END) AS late_delivery_rate
  FROM customers c JOIN orders_clean o ON c.customer_id = o.customer_id
  LEFT JOIN order_revenue r ON o.order_id = r.order_id LEFT JOIN review_agg v ON o.order_id = v.order_id
  GROUP BY 1),
last_day AS (SELECT max(placed)::DATE AS d FROM orders_clean),
base AS (
  SELECT base0.*, date_diff('day', last_order_date::DATE, d)::INTEGER AS recency_days,
    (CASE WHEN last_order_date + INTERVAL 90 DAY < d THEN 1 ELSE 0 END)::INTEGER AS churn_label
  FROM base0 CROSS JOIN last_day),
rfm0 AS (
  SELECT customer_unique_id, recency_days, total_orders AS frequency, total_revenue AS monetary, churn_label,
    (ntile(5) OVER (ORDER BY recency_days DESC, customer_unique_id))::INTEGER AS r_score,
    (ntile(5) OVER (ORDER BY total_orders, customer_unique_id))::INTEGER AS f_score,
    (ntile(5) OVER (ORDER BY total_revenue, customer_unique_id))::INTEGER AS m_score
  FROM base WHERE total_revenue > 0),
rfm AS (
  SELECT *, CASE
    WHEN r_score = 5 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
    WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 3 THEN 'Loyal Customers'
    WHEN r_score = 5 AND f_score <= 2 THEN 'New Customers'
    WHEN r_score >= 4 AND f_score >= 3 THEN 'Potential Loyalists'
    WHEN r_score = 3 AND f_score >= 3 THEN 'Need Attention'
    WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 THEN 'Lost High Value'
    WHEN r_score <= 2 THEN 'Hibernating' ELSE 'Others' END AS rfm_segment
  FROM rfm0),
summary AS (SELECT churn_label, count(*) AS n, sum(total_revenue) AS revenue FROM base GROUP BY 1),
metrics AS (
  SELECT t AS total_customers, c AS churned_customers, a AS active_customers,
    cr AS churned_revenue, ar AS active_revenue, c * 100::DOUBLE / nullif(t, 0) AS churn_rate_pct,
    a * 100::DOUBLE / nullif(t, 0) AS retention_rate_pct, cr AS revenue_at_risk,
    coalesce(cr / nullif(c, 0), 0::DOUBLE) AS avg_revenue_per_churned,
    coalesce(ar / nullif(a, 0), 0::DOUBLE) AS avg_revenue_per_active
  FROM (SELECT coalesce(sum(n), 0)::BIGINT AS t, coalesce(sum(n) FILTER (WHERE churn_label = 1), 0)::BIGINT AS c,
      coalesce(sum(n) FILTER (WHERE churn_label = 0), 0)::BIGINT AS a,
      coalesce(sum(revenue) FILTER (WHERE churn_label = 1), 0)::DOUBLE AS cr,
      coalesce(sum(revenue) FILTER (WHERE churn_label = 0), 0)::DOUBLE AS ar FROM summary)),
cohorts AS (
  SELECT c.customer_unique_id, date_trunc('month', min(placed))::DATE AS cohort_month
  FROM customers c JOIN orders_clean o ON c.customer_id = o.customer_id GROUP BY 1),
activity AS (
  SELECT DISTINCT k.customer_unique_id, k.cohort_month, date_trunc('month', placed)::DATE AS activity_month
  FROM cohorts k JOIN customers c ON k.customer_unique_id = c.customer_unique_id
  JOIN orders_clean o ON c.customer_id = o.customer_id),
retention AS (
  SELECT a.cohort_month, date_diff('month', a.cohort_month, a.activity_month)::INTEGER AS month_offset,
    count(DISTINCT a.customer_unique_id) AS active_customers, any_value(s.size) AS cohort_size,
    round(count(DISTINCT a.customer_unique_id) * 100::DOUBLE / any_value(s.size), 2) AS retention_rate_pct
  FROM activity a JOIN (SELECT cohort_month, count(*) AS size FROM cohorts GROUP BY 1) s USING (cohort_month)
  GROUP BY 1, 2),
labelled AS (SELECT a.*, b.churn_label FROM activity a JOIN base b USING (customer_unique_id)),
retention_label AS (
  SELECT a.cohort_month, a.churn_label, date_diff('month', a.cohort_month, a.activity_month)::INTEGER AS month_offset,
    count(*) AS active_customers, any_value(s.size) AS cohort_size,
    round(count(*) * 100::DOUBLE / any_value(s.size), 2) AS retention_rate_pct
  FROM labelled a JOIN (
    SELECT cohort_month, churn_label, count(DISTINCT customer_unique_id) AS size FROM labelled GROUP BY 1, 2) s
    USING (cohort_month, churn_label)
  GROUP BY 1, 2, 3),
monthly AS (
  SELECT date_trunc('month', placed)::DATE AS month, sum(total) AS revenue
  FROM orders_clean JOIN order_revenue USING (order_id) GROUP BY 1),
monthly_state AS (
  SELECT customer_state, date_trunc('month', placed)::DATE AS month, sum(total) AS revenue
  FROM orders_clean JOIN order_revenue USING (order_id) JOIN customers USING (customer_id) GROUP BY 1, 2),
monthly_category AS (
  SELECT category, date_trunc('month', placed)::DATE AS month, sum(price) AS revenue
  FROM items JOIN orders_clean USING (order_id) JOIN products USING (product_id) GROUP BY 1, 2),
numbered AS (SELECT month, revenue::DOUBLE AS v, row_number() OVER (ORDER BY month) - 1 AS i FROM monthly),
growth AS (
  SELECT
    coalesce(CASE WHEN li > fi AND fv > 0 THEN round((pow(lv / fv, 1::DOUBLE / (li - fi)) - 1::DOUBLE) * 100::DOUBLE, 2) END, 0::DOUBLE) AS cagr_pct,
    coalesce(CASE WHEN n >= 2 AND a0 > 0 THEN (a1 - a0) / a0 * 100::DOUBLE END, 0::DOUBLE) AS simple_growth_pct,
    coalesce(CASE WHEN m >= 2 AND b0 > 0 THEN (b1 - b0) / b0 * 100::DOUBLE END, 0::DOUBLE) AS filtered_growth_pct
  FROM (SELECT count(*) AS n, arg_min(v, i) AS a0, arg_max(v, i) AS a1,
      min(i) FILTER (WHERE v >= {REVENUE_FLOOR}) AS fi, max(i) FILTER (WHERE v >= {REVENUE_FLOOR}) AS li,
      arg_min(v, i) FILTER (WHERE v >= {REVENUE_FLOOR}) AS fv, arg_max(v, i) FILTER (WHERE v >= {REVENUE_FLOOR}) AS lv,
      count(*) FILTER (WHERE v > {REVENUE_FLOOR}) AS m,
      arg_min(v, i) FILTER (WHERE v > {REVENUE_FLOOR}) AS b0, arg_max(v, i) FILTER (WHERE v > {REVENUE_FLOOR}) AS b1
    FROM numbered)),
revenue_bundle AS (
  SELECT sum(revenue)::DOUBLE AS total_revenue, sum(revenue)::DOUBLE / count(*) AS avg_monthly_revenue,
    max(revenue)::DOUBLE AS max_monthly_revenue, min(revenue)::DOUBLE AS min_monthly_revenue,
    count(*) AS months_of_data, any_value(cagr_pct) AS growth_rate
  FROM monthly CROSS JOIN growth),
trends AS (
  SELECT month, revenue::DOUBLE AS revenue,
    CASE WHEN count(*) OVER w3 = 3 THEN (sum(revenue) OVER w3)::DOUBLE / 3 END AS rolling_avg_3m,
    CASE WHEN count(*) OVER w6 = 6 THEN (sum(revenue) OVER w6)::DOUBLE / 6 END AS rolling_avg_6m,
    (revenue::DOUBLE / nullif((lag(revenue) OVER (ORDER BY month))::DOUBLE, 0) - 1::DOUBLE) * 100::DOUBLE AS mom_growth
  FROM monthly
  WINDOW w3 AS (ORDER BY month ROWS 2 PRECEDING), w6 AS (ORDER BY month ROWS 5 PRECEDING)),
seasons AS (
  SELECT month(month)::INTEGER AS month_num, round(sum(revenue)::DOUBLE / count(*), 6) AS avg_revenue
  FROM monthly GROUP BY 1),
categories AS (
  SELECT lower(replace(category, '#', '_')) AS product_category_name_english, order_count,
    revenue::DOUBLE AS revenue, freight::DOUBLE AS freight_cost, (revenue - freight)::DOUBLE AS profit,
    round((revenue - freight)::DOUBLE * 100::DOUBLE / revenue::DOUBLE, 2) AS margin_pct,
    round(revenue::DOUBLE * 100::DOUBLE / (sum(revenue) OVER ())::DOUBLE, 2) AS revenue_pct
  FROM (SELECT category, count(DISTINCT order_id) AS order_count, sum(price) AS revenue, sum(freight) AS freight
    FROM items JOIN orders_clean USING (order_id) JOIN products USING (product_id) GROUP BY 1)),
top_categories AS (
  SELECT * FROM categories ORDER BY profit DESC, product_category_name_english LIMIT 20),
seller_totals AS (
  SELECT seller_id, count(*) AS order_count, sum(price) AS revenue, round(avg(review), 2) AS avg_review
  FROM (SELECT seller_id, i.order_id, any_value(review) AS review, sum(price) AS price
    FROM items i JOIN orders_clean o ON i.order_id = o.order_id LEFT JOIN review_agg v ON i.order_id = v.order_id
    GROUP BY 1, 2) GROUP BY 1),
top_sellers AS (
  SELECT seller_id, seller_state, order_count, revenue::DOUBLE AS revenue, avg_review,
    round(revenue::DOUBLE * 100::DOUBLE / (SELECT sum(revenue) FROM seller_totals)::DOUBLE, 2) AS revenue_pct
  FROM seller_totals JOIN sellers USING (seller_id) ORDER BY revenue DESC, seller_id LIMIT 20),
delivered_orders AS (SELECT * FROM orders_raw WHERE status = 'delivered'),
churn_raw AS (
  SELECT o.customer_id AS customer_unique_id,
    (CASE WHEN max(placed) < TIMESTAMP '{CHURN_AS_OF}' - INTERVAL 180 DAY THEN 1 ELSE 0 END)::INTEGER AS churn_label,
    floor(date_diff('second', max(placed), TIMESTAMP '{CHURN_AS_OF}') / 86400)::INTEGER AS recency_days,
    count(*) AS frequency, coalesce(sum(p.amount), 0)::DOUBLE AS monetary,
    floor(date_diff('second', min(placed), TIMESTAMP '{CHURN_AS_OF}') / 86400)::INTEGER AS tenure_days,
    sum(score)::DOUBLE / nullif(count(score), 0) AS avg_review_score,
    sum(CASE WHEN delivered > promised THEN 1 ELSE 0 END)::DOUBLE / count(*) AS late_delivery_rate,
    sum(cards)::DOUBLE / nullif(sum(n), 0) AS credit_card_rate,
    sum(inst)::DOUBLE / nullif(sum(inst_n), 0) AS avg_installments
  FROM delivered_orders o JOIN customers c ON o.customer_id = c.customer_id
  LEFT JOIN reviews v ON o.order_id = v.order_id
  LEFT JOIN (SELECT order_id, sum(amount) AS amount, count(*) AS n, count(*) FILTER (WHERE kind = 'credit_card') AS cards,
      sum(installments) AS inst, count(installments) AS inst_n FROM payments GROUP BY 1) p ON o.order_id = p.order_id
  GROUP BY 1),
churn_features AS (
  SELECT customer_unique_id, churn_label, recency_days, frequency, monetary, tenure_days,
    coalesce(avg_review_score, (SELECT quantile_cont(avg_review_score, 0.5) FROM churn_raw)) AS avg_review_score,
    coalesce(late_delivery_rate, 0::DOUBLE) AS late_delivery_rate, coalesce(credit_card_rate, 0::DOUBLE) AS credit_card_rate,
    coalesce(avg_installments, 1::DOUBLE) AS avg_installments
  FROM churn_raw),
checked AS (
  SELECT *, concat_ws(',',
    CASE WHEN coalesce(monetary > 0, false) THEN NULL ELSE 'monetary' END,
    CASE WHEN coalesce(frequency >= 1, false) THEN NULL ELSE 'frequency' END,
    CASE WHEN coalesce(avg_review_score BETWEEN 0 AND 5, false) THEN NULL ELSE 'avg_review_score' END,
    CASE WHEN coalesce(avg_installments >= 1, false) THEN NULL ELSE 'avg_installments' END,
    CASE WHEN coalesce(credit_card_rate BETWEEN 0 AND 1, false) THEN NULL ELSE 'credit_card_rate' END,
    CASE WHEN coalesce(late_delivery_rate BETWEEN 0 AND 1, false) THEN NULL ELSE 'late_delivery_rate' END) AS failed
  FROM churn_features),
raw_score AS (
  SELECT *, least(((1::DOUBLE - least(monetary / 1000::DOUBLE, 1::DOUBLE)) + avg_installments / 12::DOUBLE
      + (1::DOUBLE - avg_review_score / 5::DOUBLE) + (1::DOUBLE - credit_card_rate) + late_delivery_rate
      + (1::DOUBLE - least(frequency::DOUBLE / 10::DOUBLE, 1::DOUBLE))) / 6::DOUBLE, 1::DOUBLE) AS p
  FROM checked WHERE failed = ''),
scored AS (
  SELECT *, CASE WHEN p < 0.1 THEN 'Champions' WHEN p < 0.2 THEN 'Loyal Customers' WHEN p < 0.35 THEN 'Potential Loyalist'
    WHEN p < 0.5 THEN 'New Customers' WHEN p < 0.7 THEN 'At Risk' WHEN p < 0.85 THEN 'Cant Lose Them' ELSE 'Lost' END AS rfm_segment,
    CASE WHEN monetary > 500 AND frequency > 3 THEN 0.95::DOUBLE ELSE 1::DOUBLE END AS raised
  FROM raw_score),
points AS (SELECT churn_label AS y, round(p, 3) AS s FROM raw_score),
risky AS (SELECT *, {RISK} AS churn_probability FROM rfm),
calls AS (
  SELECT event_id AS call_id, user_id AS api_key, ts, date_trunc('month', ts)::DATE AS month,
    CASE user_id % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' ELSE 'enterprise' END AS tier,
    CASE user_id % 3 WHEN 0 THEN {TIER_CALLS['starter']} WHEN 1 THEN {TIER_CALLS['growth']} END AS cap FROM events)
"""

_FEATURES = "recency_days frequency monetary tenure_days avg_review_score late_delivery_rate credit_card_rate avg_installments".split()


def _feature_table(source: str, group: str) -> str:
    by = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    lags = ", ".join(f"lag(revenue::DOUBLE, {n}) OVER w AS lag_{n}" for n in (1, 2, 3, 6))
    return f"""SELECT {by}month, revenue::DOUBLE AS revenue, {lags},
  CASE WHEN count(*) OVER w3 = 3 THEN (sum(revenue) OVER w3)::DOUBLE / 3 END AS rolling_mean_3,
  CASE WHEN count(*) OVER w6 = 6 THEN (sum(revenue) OVER w6)::DOUBLE / 6 END AS rolling_mean_6,
  CASE WHEN count(*) OVER w3 = 3 THEN round(stddev_samp(revenue::DOUBLE) OVER w3, 6) END AS rolling_std_3,
  month(month)::INTEGER AS month_num, round(sin(2 * pi() * month(month) / 12), 6) AS month_sin,
  round(cos(2 * pi() * month(month) / 12), 6) AS month_cos, (row_number() OVER w - 1)::INTEGER AS trend
FROM {source} WINDOW w AS ({part} ORDER BY month), w3 AS ({part} ORDER BY month ROWS 2 PRECEDING), w6 AS ({part} ORDER BY month ROWS 5 PRECEDING)"""


_RFM_COLUMNS = "customer_unique_id, recency_days, frequency, monetary::DOUBLE AS monetary, r_score, f_score, m_score"

_RULES = ", ".join(
    f"({i}, {_text(t)}, {_text(s)}, {_text(a)}, {_text(p)})" for i, (t, s, a, p) in enumerate(dim.RECOMMENDATION_RULES)
)
_CHANNELS = ", ".join(f"({_text(c)}, {r}::DOUBLE)" for c, r in dim.CHANNEL_REACH.items())
_SCENARIOS = ", ".join(f"({_text(n)}, {r}::DOUBLE)" for n, r in dim.RETENTION_SCENARIOS)


def _scenarios(source: str, group: str) -> str:
    by = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""
SELECT {by}scenario, rate AS churn_reduction, total_customers, churned_customers,
  round(churned_customers::DOUBLE * avg_revenue, 2) AS revenue_at_risk, kept AS customers_retained,
  round(kept::DOUBLE * avg_revenue, 2) AS revenue_recovered, kept::DOUBLE * 25::DOUBLE AS cost,
  round(coalesce((kept::DOUBLE * avg_revenue - kept::DOUBLE * 25::DOUBLE) / nullif(kept::DOUBLE * 25::DOUBLE, 0) * 100::DOUBLE, 0::DOUBLE), 2) AS roi_pct
FROM (SELECT t.*, s.*, trunc(churned_customers::DOUBLE * rate)::BIGINT AS kept
  FROM (SELECT {by}count(*) AS total_customers, count(*) FILTER (WHERE churn_label = 1) AS churned_customers,
      sum(monetary::DECIMAL(28,2))::DOUBLE / count(*) AS avg_revenue FROM {source} {tail}) t
  CROSS JOIN (VALUES {_SCENARIOS}) s(scenario, rate))"""


def _forecast(source: str, group: str) -> str:
    by = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""
SELECT {by}(last_month + to_months(h::INTEGER))::DATE AS month, h::INTEGER AS forecast_horizon,
  round(base * pow(1::DOUBLE + g / 100::DOUBLE, h::DOUBLE), 2) AS forecasted_revenue
FROM (SELECT {by}max(month) AS last_month, max(CASE WHEN back = 1 THEN ma END) AS base,
    (coalesce(max(CASE WHEN back = 3 THEN mom END), 0::DOUBLE) + coalesce(max(CASE WHEN back = 2 THEN mom END), 0::DOUBLE)
      + coalesce(max(CASE WHEN back = 1 THEN mom END), 0::DOUBLE)) / nullif(count(mom), 0) AS g, count(*) AS n
  FROM (SELECT {by}month, row_number() OVER ({part} ORDER BY month DESC) AS back,
      (sum(revenue) OVER ({part} ORDER BY month ROWS 2 PRECEDING))::DOUBLE / 3 AS ma,
      (revenue::DOUBLE / nullif((lag(revenue) OVER ({part} ORDER BY month))::DOUBLE, 0) - 1::DOUBLE) * 100::DOUBLE AS mom
    FROM {source}) WHERE back <= 3 {tail})
CROSS JOIN range(1, 4) r(h) WHERE n = 3"""


def _pivot(source: str, offsets: range) -> str:
    columns = ", ".join(f"max(CASE WHEN month_offset = {o} THEN retention_rate_pct END) AS month_{o}" for o in offsets)
    return f"SELECT cohort_month, {columns} FROM {source} GROUP BY 1"


def _whole_pivot(label: int) -> str:
    own = f"(SELECT * FROM retention_label WHERE churn_label = {label})"
    return f"""SELECT cohort_month, month_offset, r.retention_rate_pct
FROM (SELECT DISTINCT cohort_month FROM {own}) CROSS JOIN (SELECT DISTINCT month_offset FROM {own})
LEFT JOIN {own} r USING (cohort_month, month_offset)"""


def _period(grain: str) -> str:
    return f"""SELECT date_trunc('{grain}', placed)::DATE AS period, sum(total)::DOUBLE AS revenue
FROM orders_clean JOIN order_revenue USING (order_id) GROUP BY 1"""


def _retention_summary(label: int) -> str:
    return f"""SELECT count(DISTINCT cohort_month) AS total_cohorts,
  sum(CASE WHEN churn_label = {label} THEN retention_rate_pct::DECIMAL(9,2) END)::DOUBLE / nullif(count(*) FILTER (WHERE churn_label = {label}), 0) AS avg_retention_rate,
  max(retention_rate_pct) FILTER (WHERE churn_label = {label}) AS max_retention_rate,
  min(retention_rate_pct) FILTER (WHERE churn_label = {label} AND retention_rate_pct > 0) AS min_retention_rate,
  max(month_offset) FILTER (WHERE churn_label = {label}) AS months_of_data FROM retention_label"""


_DETAIL = f"""SELECT r.customer_unique_id, rfm_segment AS segment, r_score, f_score, m_score, r.monetary::DOUBLE AS total_spent,
  r.frequency AS order_count, r.recency_days AS days_since_last_purchase, r.risk AS churn_risk, r.ltv AS ltv_estimate,
  CASE WHEN c.customer_unique_id IS NOT NULL THEN 0::DOUBLE END AS model_risk, c.churn_label, {ACTION} AS recommended_action
FROM (SELECT *, round({OPEN_RISK}, 3) AS risk, {LTV} AS ltv FROM rfm) r
LEFT JOIN churn_raw c ON r.customer_unique_id = c.customer_unique_id"""

_LIST = f"""SELECT customer_unique_id, rfm_segment, round({RISK}, 3) AS churn_risk, {LTV} AS ltv_estimate,
  monetary::DOUBLE AS monetary, frequency FROM rfm"""

_INSIGHTS = """SELECT count(*) AS total_categories, arg_max(product_category_name_english, profit) AS top_category,
  arg_max(revenue, profit) AS top_category_revenue, arg_max(margin_pct, profit) AS top_category_margin,
  sum(margin_pct::DECIMAL(9,2))::DOUBLE / count(*) AS avg_margin_all_categories,
  (SELECT coalesce(string_agg(n, ', ' ORDER BY profit DESC), '') FROM (
    SELECT product_category_name_english AS n, profit FROM categories
    WHERE margin_pct > (SELECT quantile_cont(margin_pct, 0.75) FROM categories) ORDER BY profit DESC, n LIMIT 5)) AS high_margin_categories
FROM categories"""

STATEMENTS: dict[str, str] = {
    "products_clean": """SELECT product_id, coalesce(category, 'Unknown') AS product_category_name, product_weight_g FROM products""",
    "city_standardize": """SELECT name AS product_name, count(*) AS count FROM (
  SELECT CASE WHEN product_name ILIKE '%ring%' THEN lower(trim(replace(product_name, 'i', 'y'))) ELSE product_name END AS name FROM products)
WHERE name ILIKE '%ryng%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "orders_clean": """SELECT order_id, customer_id, status AS order_status, placed AS order_purchase_timestamp,
  CASE WHEN approved IS NULL OR approved < placed THEN coalesce(approved, placed + INTERVAL 1 DAY) ELSE approved END AS order_approved_at,
  delivered AS order_delivered_customer_date, promised AS order_estimated_delivery_date FROM orders_clean""",
    "order_review_agg": """SELECT order_id, review AS avg_review_score_per_order, reviews AS review_count_per_order,
  latest AS latest_review_date FROM review_agg""",
    "order_revenue": "SELECT order_id, total::DOUBLE AS total_order_payment FROM order_revenue",
    "order_status_distribution": """SELECT status AS order_status, count(*) AS total_orders,
  round(count(*) * 100::DOUBLE / (sum(count(*)) OVER ())::DOUBLE, 2) AS percentage FROM orders_raw GROUP BY 1""",
    "customer_counts": """SELECT count(DISTINCT customer_id) AS total_customers,
  count(DISTINCT customer_unique_id) AS total_unique_customers FROM customers""",
    "dq_missing": """SELECT 'products' AS table_name, 'product_category_name' AS column_name, count(*) AS total_rows, count(*) FILTER (WHERE category IS NULL) AS missing FROM products
UNION ALL SELECT 'products', 'product_weight_g', count(*), count(*) FILTER (WHERE product_weight_g IS NULL) FROM products
UNION ALL SELECT 'order_reviews', 'review_score', count(*), count(*) FILTER (WHERE score IS NULL) FROM reviews
UNION ALL SELECT 'order_reviews', 'review_creation_date', count(*), count(*) FILTER (WHERE created IS NULL) FROM reviews
UNION ALL SELECT 'orders', 'order_approved_at', count(*), count(*) FILTER (WHERE approved IS NULL) FROM orders_raw
UNION ALL SELECT 'orders', 'order_delivered_customer_date', count(*), count(*) FILTER (WHERE delivered IS NULL) FROM orders_raw""",
    "dq_duplicate_keys": "\nUNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{key}' AS key, count(*) AS duplicate_keys, coalesce(sum(n - 1), 0)::BIGINT AS surplus_rows
FROM (SELECT count(*) AS n FROM {source} GROUP BY {by} HAVING count(*) > 1)"""
        for table, key, source, by in (
            ("customers", "customer_id", "customers", "customer_id"),
            ("products", "product_id", "products", "product_id"),
            ("orders", "order_id", "orders_raw", "order_id"),
            ("order_reviews", "review_id", "reviews", "order_id"),
            ("order_payments", "order_id,payment_sequential", "payments", "order_id, seq"),
        )
    ),
    "dq_orphans": "\nUNION ALL ".join(
        f"""SELECT '{name}' AS reference, count(DISTINCT c.{key}) AS orphan_keys, count(*) AS orphan_rows
FROM {child} c WHERE c.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})"""
        for name, child, key, parent in (
            ("orders.customer_id", "orders_raw", "customer_id", "customers"),
            ("orders_clean.customer_id", "orders_clean", "customer_id", "customers"),
            ("order_reviews.order_id", "reviews", "order_id", "orders_raw"),
            ("order_payments.order_id", "payments", "order_id", "orders_raw"),
        )
    ),
    "dq_domain": """SELECT 'review_score in 1..5' AS check_name, count(*) AS total_rows, count(*) FILTER (WHERE NOT (score BETWEEN 1 AND 5)) AS violations FROM reviews
UNION ALL SELECT 'approved_at >= purchase', count(*), count(*) FILTER (WHERE approved < placed) FROM orders_raw""",
    "dq_reconcile_revenue": """SELECT (SELECT sum(amount) FROM payments)::DOUBLE AS raw_total_payments,
  (SELECT sum(total) FROM order_revenue)::DOUBLE AS aggregated_revenue""",
    "customer_retention_base": """SELECT customer_unique_id, first_order_date, last_order_date, total_orders, total_revenue::DOUBLE AS total_revenue,
  avg_order_value, avg_review_score, avg_delivery_difference_days, late_delivery_rate, recency_days, churn_label FROM base""",
    "churn_label_90d": "SELECT customer_unique_id, last_order_date, recency_days, churn_label FROM base",
    "churn_summary": "SELECT churn_label, n AS count, revenue::DOUBLE AS revenue FROM summary",
    "churn_metrics": "SELECT * FROM metrics",
    "one_time_buyer_pct": "SELECT count(*) FILTER (WHERE total_orders = 1) * 100::DOUBLE / count(*) AS one_time_pct FROM base0",
    "delay_vs_review": """SELECT round(avg_delivery_difference_days)::INTEGER AS delay_bucket,
  round(sum(avg_review_score::DECIMAL(20,10))::DOUBLE / nullif(count(avg_review_score), 0), 2) AS avg_review_score, count(*) AS customer_count
FROM base0 GROUP BY 1""",
    "review_vs_repeat": """SELECT round(avg_review_score)::INTEGER AS review_bucket, count(*) AS repeat_customer_count,
  round(sum(total_orders)::DOUBLE / count(*), 2) AS avg_orders_per_repeat_customer, max(total_orders) AS max_orders_in_bucket
FROM base0 WHERE total_orders > 1 GROUP BY 1""",
    "customer_rfm": f"SELECT {_RFM_COLUMNS} FROM rfm",
    "rfm_segments": f"SELECT {_RFM_COLUMNS}, rfm_segment FROM rfm",
    "rfm_validation": """SELECT rfm_segment, count(*) AS customers, round(sum(recency_days)::DOUBLE / count(*), 1) AS avg_recency
FROM rfm GROUP BY 1""",
    "churn_by_segment": """SELECT rfm_segment, count(*) AS total_customers, count(*) FILTER (WHERE b.churn_label = 1) AS churned_customers,
  round(count(*) FILTER (WHERE b.churn_label = 1) * 100::DOUBLE / count(*), 2) AS churn_rate_pct
FROM rfm r JOIN base b ON r.customer_unique_id = b.customer_unique_id GROUP BY 1""",
    "segment_distribution": """SELECT rfm_segment AS segment, count(*) AS customer_count, sum(monetary)::DOUBLE AS total_revenue,
  round(count(*) * 100::DOUBLE / (sum(count(*)) OVER ())::DOUBLE, 2) AS percentage,
  round(sum(monetary)::DOUBLE / count(*), 2) AS avg_revenue_per_customer FROM rfm GROUP BY 1""",
    "segment_metrics": """SELECT rfm_segment, count(monetary) AS customer_count, round(sum(monetary)::DOUBLE, 2) AS total_revenue,
  round(sum(monetary)::DOUBLE / count(*), 2) AS avg_revenue, round(sum(frequency)::DOUBLE / count(*), 2) AS avg_frequency,
  round(sum(recency_days)::DOUBLE / count(*), 2) AS avg_recency FROM rfm GROUP BY 1""",
    "segment_characteristics": """SELECT rfm_segment, count(*) AS customer_count, sum(monetary)::DOUBLE AS total_revenue,
  sum(monetary)::DOUBLE / count(*) AS avg_revenue, sum(recency_days)::DOUBLE / count(*) AS avg_recency,
  sum(frequency)::DOUBLE / count(*) AS avg_frequency,
  sum(monetary)::DOUBLE * 100::DOUBLE / (SELECT sum(monetary) FROM rfm)::DOUBLE AS revenue_share FROM rfm GROUP BY 1""",
    "rfm_score_stats": """SELECT sum(recency_days)::DOUBLE / count(*) AS recency_mean, quantile_cont(recency_days::DOUBLE, 0.5) AS recency_median,
  min(recency_days) AS recency_min, max(recency_days) AS recency_max, round(stddev_samp(recency_days), 6) AS recency_std,
  sum(frequency)::DOUBLE / count(*) AS frequency_mean, quantile_cont(frequency::DOUBLE, 0.5) AS frequency_median,
  max(frequency) AS frequency_max, sum(frequency)::BIGINT AS frequency_total_orders,
  sum(monetary)::DOUBLE / count(*) AS monetary_mean, quantile_cont(monetary::DOUBLE, 0.5) AS monetary_median,
  min(monetary)::DOUBLE AS monetary_min, max(monetary)::DOUBLE AS monetary_max, sum(monetary)::DOUBLE AS monetary_total FROM rfm""",
    "rfm_score_histogram": """SELECT score_name, score, count(*) AS customers FROM (
  SELECT 'r_score' AS score_name, r_score AS score FROM rfm UNION ALL SELECT 'f_score', f_score FROM rfm
  UNION ALL SELECT 'm_score', m_score FROM rfm) GROUP BY 1, 2""",
    "high_value_customers": f"""SELECT {_RFM_COLUMNS}, rfm_segment FROM rfm
WHERE monetary::DOUBLE >= (SELECT quantile_cont(monetary::DOUBLE, 0.9) FROM rfm)""",
    "churn_risk_summary": """SELECT count(*) FILTER (WHERE hit) AS high_risk_count,
  coalesce(sum(CASE WHEN hit THEN monetary END), 0)::DOUBLE AS high_risk_revenue,
  count(*) FILTER (WHERE hit) * 100::DOUBLE / count(*) AS risk_percentage
FROM (SELECT monetary, recency_days > (SELECT quantile_cont(recency_days::DOUBLE, 0.75) FROM rfm) AND frequency = 1 AS hit FROM rfm)""",
    "marketing_segments": f"""SELECT * FROM (SELECT customer_unique_id, {_case(SEGMENT, dim.MARKETING_AUDIENCE)} AS marketing_segment FROM rfm)
WHERE marketing_segment IS NOT NULL""",
    "churn_label_from_segment": """SELECT customer_unique_id, recency_days, frequency, monetary::DOUBLE AS monetary,
  (CASE WHEN rfm_segment IN ('Hibernating', 'Lost High Value', 'Lost Low Value') THEN 1 ELSE 0 END)::INTEGER AS churn_label,
  4::DOUBLE AS avg_review_score, 0.1::DOUBLE AS late_delivery_rate FROM rfm""",
    "customer_cohorts": "SELECT * FROM cohorts",
    "monthly_activity": "SELECT * FROM activity",
    "cohort_retention": "SELECT * FROM retention",
    "cohort_retention_by_churn": "SELECT * FROM retention_label",
    "cohort_pivot": _pivot(f"(SELECT * FROM retention WHERE cohort_month >= DATE '{PIVOT_SINCE}')", range(6)),
    "cohort_pivot_active": _whole_pivot(0),
    "cohort_pivot_by_label": _whole_pivot(1),
    "avg_retention_by_offset": """SELECT month_offset, round(sum(retention_rate_pct::DECIMAL(9,2))::DOUBLE / count(*), 2) AS avg_retention_pct
FROM retention WHERE month_offset <= 6 GROUP BY 1""",
    "retention_summary": _retention_summary(1),
    "retention_summary_active": _retention_summary(0),
    "cohort_performance": """SELECT cohort_month, sum(active_customers)::BIGINT AS active_customers,
  arg_min(cohort_size, churn_label * 10000 + month_offset) AS cohort_size,
  round(sum(active_customers)::DOUBLE * 100::DOUBLE / arg_min(cohort_size, churn_label * 10000 + month_offset), 2) AS initial_to_current_ratio
FROM retention_label GROUP BY 1""",
    "monthly_revenue": "SELECT month, revenue::DOUBLE AS revenue FROM monthly",
    "daily_revenue": _period("day"),
    "weekly_revenue": _period("week"),
    "monthly_revenue_by_category": "SELECT category, month, revenue::DOUBLE AS revenue FROM monthly_category",
    "revenue_summary": "SELECT * FROM revenue_bundle",
    "revenue_growth": "SELECT * FROM growth",
    "revenue_growth_by_state": """SELECT customer_state,
  coalesce(CASE WHEN li > fi AND fv > 0 THEN round((pow(lv / fv, 1::DOUBLE / (li - fi)) - 1::DOUBLE) * 100::DOUBLE, 2) END, 0::DOUBLE) AS cagr_pct,
  coalesce(CASE WHEN n >= 2 AND a0 > 0 THEN (a1 - a0) / a0 * 100::DOUBLE END, 0::DOUBLE) AS simple_growth_pct,
  coalesce(CASE WHEN m >= 2 AND b0 > 0 THEN (b1 - b0) / b0 * 100::DOUBLE END, 0::DOUBLE) AS filtered_growth_pct
FROM (SELECT customer_state, count(*) AS n, arg_min(v, i) AS a0, arg_max(v, i) AS a1,
    min(i) FILTER (WHERE v >= 300000) AS fi, max(i) FILTER (WHERE v >= 300000) AS li,
    arg_min(v, i) FILTER (WHERE v >= 300000) AS fv, arg_max(v, i) FILTER (WHERE v >= 300000) AS lv,
    count(*) FILTER (WHERE v > 300000) AS m, arg_min(v, i) FILTER (WHERE v > 300000) AS b0,
    arg_max(v, i) FILTER (WHERE v > 300000) AS b1
  FROM (SELECT customer_state, revenue::DOUBLE AS v, row_number() OVER (PARTITION BY customer_state ORDER BY month) - 1 AS i
    FROM monthly_state) GROUP BY 1)""",
    "revenue_trends": "SELECT * FROM trends",
    "revenue_forecast": _forecast("monthly", ""),
    "revenue_forecast_by_state": _forecast("monthly_state", "customer_state"),
    "seasonality": """SELECT arg_max(month_num, avg_revenue) AS best_month, max(avg_revenue) AS best_month_revenue,
  arg_min(month_num, avg_revenue) AS worst_month, min(avg_revenue) AS worst_month_revenue FROM seasons""",
    "seasonality_index": """SELECT month_num, avg_revenue,
  round(avg_revenue / (SELECT avg(avg_revenue) FROM seasons), 9) AS seasonality_index FROM seasons""",
    "report_monthly": """SELECT month AS date, '$' || format('{:,.2f}', round(v, 2)) AS revenue,
  CASE WHEN before > 0 THEN printf('%+.1f%%', round((v - before) / before * 100::DOUBLE, 1)) ELSE '' END AS growth
FROM (SELECT month, revenue::DOUBLE AS v, (lag(revenue) OVER (ORDER BY month))::DOUBLE AS before FROM monthly)""",
    "category_revenue_rank": """SELECT lower(replace(category, '#', '_')) AS category, revenue::DOUBLE AS product_revenue,
  round(revenue::DOUBLE * 100::DOUBLE / (sum(revenue) OVER ())::DOUBLE, 2) AS revenue_pct,
  (rank() OVER (ORDER BY revenue DESC))::INTEGER AS rank
FROM (SELECT category, sum(price) AS revenue FROM items JOIN products USING (product_id) GROUP BY 1)""",
    "top_categories": "SELECT * FROM top_categories",
    "top_sellers": "SELECT * FROM top_sellers",
    "top_states": """SELECT customer_state, order_count, unique_buyers, revenue::DOUBLE AS total_revenue,
  round(revenue::DOUBLE * 100::DOUBLE / (sum(revenue) OVER ())::DOUBLE, 2) AS revenue_pct
FROM (SELECT customer_state, count(*) AS order_count, count(DISTINCT customer_unique_id) AS unique_buyers, sum(total) AS revenue
  FROM orders_clean JOIN order_revenue USING (order_id) JOIN customers USING (customer_id) GROUP BY 1)""",
    "category_insights": _INSIGHTS,
    "seller_insights": """SELECT count(*) AS total_top_sellers, left(arg_max(seller_id, revenue)::VARCHAR, 8) || '...' AS top_seller,
  max(revenue) AS top_seller_revenue, round(sum(avg_review::DECIMAL(9,2))::DOUBLE / count(avg_review), 6) AS avg_review_top_sellers,
  (SELECT seller_state FROM top_sellers GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_state FROM top_sellers""",
    "churn_features": "SELECT * FROM churn_features",
    "class_distribution": """SELECT churn_label, count(*) AS customers, count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE AS share
FROM churn_raw GROUP BY 1""",
    "customer_list": _LIST,
    "customer_page": f"{_LIST} ORDER BY customer_unique_id LIMIT 100 OFFSET 200",
    "customer_page_deep": f"{_LIST} ORDER BY customer_unique_id LIMIT 100 OFFSET 600",
    "customer_page_after": f"SELECT * FROM ({_LIST}) WHERE customer_unique_id > 400 ORDER BY customer_unique_id LIMIT 100",
    "customer_page_starter": f"{_LIST} ORDER BY customer_unique_id LIMIT 10",
    "customer_detail": _DETAIL,
    "score_customers": f"""SELECT customer_unique_id, round(p, 3) AS churn_risk_score, rfm_segment AS segment,
  round(monetary * (1::DOUBLE + frequency::DOUBLE * 0.1::DOUBLE) * (1::DOUBLE - p), 2) AS ltv_estimate, {ACTION} AS recommended_action,
  round(CASE WHEN late_delivery_rate > 0.3 THEN greatest(raised - 0.1::DOUBLE, 0.3::DOUBLE) ELSE raised END, 2) AS confidence FROM scored""",
    "score_rejects": """SELECT customer_unique_id, concat_ws(',',
    CASE WHEN coalesce(monetary > 0, false) THEN NULL ELSE 'monetary' END,
    CASE WHEN coalesce(frequency >= 1, false) THEN NULL ELSE 'frequency' END,
    CASE WHEN coalesce(avg_review_score BETWEEN 0 AND 5, false) THEN NULL ELSE 'avg_review_score' END,
    CASE WHEN coalesce(avg_installments >= 1, false) THEN NULL ELSE 'avg_installments' END,
    CASE WHEN coalesce(credit_card_rate BETWEEN 0 AND 1, false) THEN NULL ELSE 'credit_card_rate' END,
    CASE WHEN coalesce(late_delivery_rate BETWEEN 0 AND 1, false) THEN NULL ELSE 'late_delivery_rate' END) AS failed_fields
FROM churn_features WHERE failed_fields <> ''""",
    "churn_predictions": """SELECT customer_unique_id, round(churn_probability, 6) AS churn_probability FROM (
  SELECT * FROM risky ORDER BY risky.churn_probability DESC, customer_unique_id LIMIT 100)""",
    "risk_band_totals": """SELECT CASE WHEN churn_probability >= 0.6 THEN 'high' WHEN churn_probability >= 0.3 THEN 'medium' ELSE 'low' END AS risk_band,
  count(*) AS customers, round(min(churn_probability), 6) AS min_probability, round(max(churn_probability), 6) AS max_probability
FROM risky GROUP BY 1""",
    "churn_risk_split": """SELECT count(*) FILTER (WHERE churn_probability > 0.5) AS high_risk_customers,
  count(*) FILTER (WHERE NOT churn_probability > 0.5) AS low_risk_customers FROM risky""",
    "high_risk_list": f"""SELECT customer_unique_id, round(churn_probability, 6) AS churn_probability, rfm_segment AS segment, {ACTION} AS action
FROM risky WHERE churn_probability >= 0.6""",
    "campaign_plan": f"""SELECT rfm_segment AS target_segment, channel, n AS segment_size, 1000::DOUBLE AS budget, reach AS estimated_reach,
  round(reach::DOUBLE * conv, 0) AS estimated_conversion, round(reach::DOUBLE * conv * avg_value * 2::DOUBLE, 2) AS expected_revenue,
  round((reach::DOUBLE * conv * avg_value * 2::DOUBLE - 1000::DOUBLE) / 1000::DOUBLE * 100::DOUBLE, 1) AS roi
FROM (SELECT s.*, c.*, trunc(n::DOUBLE * rate)::BIGINT AS reach, {_case(SEGMENT, dim.CONVERSION_RATE, dim.DEFAULT_CONVERSION)} AS conv
  FROM (SELECT rfm_segment, count(*) AS n, sum(monetary)::DOUBLE / count(*) AS avg_value FROM rfm GROUP BY 1) s
  CROSS JOIN (VALUES {_CHANNELS}) c(channel, rate))""",
    "retention_scenarios": _scenarios("churn_raw", ""),
    "retention_scenarios_by_segment": _scenarios("rfm", "rfm_segment"),
    "marketing_recommendations": f"""SELECT segment, action, priority FROM (VALUES {_RULES}) r(i, t, segment, action, priority)
WHERE EXISTS (SELECT 1 FROM rfm WHERE rfm_segment ILIKE '%' || t || '%')
UNION ALL SELECT {', '.join(_text(v) for v in dim.CHURN_RECOMMENDATION)} FROM metrics WHERE churn_rate_pct > 50""",
    "report_kpis": """SELECT total_revenue, avg_monthly_revenue, n AS total_customers, c::DOUBLE / t AS churn_rate, c AS churned_customers,
  t AS scored_customers, filtered_growth_pct AS growth_rate, total_revenue / n AS avg_order_value
FROM revenue_bundle CROSS JOIN (SELECT count(*) AS n FROM rfm)
CROSS JOIN (SELECT count(*) AS t, count(*) FILTER (WHERE churn_label = 1) AS c FROM churn_raw) CROSS JOIN growth""",
    "report_segments": """SELECT rfm_segment AS name, count(*) AS count, '$' || format('{:,.2f}', round(sum(monetary)::DOUBLE, 2)) AS revenue,
  '$' || format('{:,.2f}', round(sum(monetary)::DOUBLE / count(*), 2)) AS avg FROM rfm GROUP BY 1""",
    "executive_summary": f"""SELECT r.*, p.*, churn_rate_pct, revenue_at_risk, churned_customers, active_customers,
  avg_retention_rate, total_cohorts, top_category, top_category_revenue, top_category_margin
FROM revenue_bundle r CROSS JOIN (SELECT count(*) AS total_customers, sum(monetary)::DOUBLE / count(*) AS avg_revenue_per_customer FROM rfm) p
CROSS JOIN (SELECT churn_rate_pct, revenue_at_risk, churned_customers, active_customers FROM metrics) m
CROSS JOIN ({_retention_summary(1)}) t CROSS JOIN ({_INSIGHTS}) i""",
    "ml_features": "SELECT customer_unique_id, churn_label, "
    + ", ".join(f"coalesce({f}::DOUBLE, (SELECT quantile_cont({f}::DOUBLE, 0.5) FROM churn_raw)) AS {f}" for f in _FEATURES)
    + " FROM churn_raw",
    "ml_standardize": "SELECT customer_unique_id, "
    + ", ".join(
        f"round(({f}::DOUBLE - (SELECT avg({f}::DOUBLE) FROM churn_features)) / "
        f"(SELECT CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END FROM churn_features), 6) AS {f}"
        for f in _FEATURES
    )
    + " FROM churn_features",
    "ml_split": """SELECT customer_unique_id, churn_label, CASE WHEN i < floor(n * 0.2::DOUBLE + 0.5::DOUBLE) THEN 'test' ELSE 'train' END AS split
FROM (SELECT customer_unique_id, churn_label, count(*) OVER (PARTITION BY churn_label) AS n,
    row_number() OVER (PARTITION BY churn_label ORDER BY md5('42-' || customer_unique_id::VARCHAR), customer_unique_id) - 1 AS i FROM churn_raw)""",
    "split_by_recency": """SELECT customer_unique_id, recency_days,
  CASE WHEN row_number() OVER (ORDER BY recency_days, customer_unique_id) - 1 < floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
FROM churn_raw""",
    "class_weights": """SELECT churn_label, count(*) AS rows,
  (sum(count(*)) OVER ())::DOUBLE / (count(*) OVER () * count(*))::DOUBLE AS class_weight FROM churn_raw GROUP BY 1""",
    "eval_binary": """SELECT tp, fp, fn, tn, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0::DOUBLE) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0::DOUBLE) AS recall,
  coalesce((tp * 2)::DOUBLE / nullif(tp * 2 + fp + fn, 0), 0::DOUBLE) AS f1_score
FROM (SELECT count(*) FILTER (WHERE y = 1 AND q) AS tp, count(*) FILTER (WHERE y = 0 AND q) AS fp,
    count(*) FILTER (WHERE y = 1 AND NOT q) AS fn, count(*) FILTER (WHERE y = 0 AND NOT q) AS tn
  FROM (SELECT churn_label AS y, round(p, 3) >= 0.5 AS q FROM raw_score))""",
    "eval_ranking": """SELECT round((SELECT sum(CASE WHEN a.s > b.s THEN a.c * b.c * 1::DOUBLE WHEN a.s = b.s THEN a.c * b.c * 0.5::DOUBLE ELSE 0 END)
    FROM (SELECT s, count(*) AS c FROM points WHERE y = 1 GROUP BY 1) a CROSS JOIN (SELECT s, count(*) AS c FROM points WHERE y = 0 GROUP BY 1) b)
    / ((SELECT count(*) FROM points WHERE y = 1) * (SELECT count(*) FROM points WHERE y = 0)), 9) AS roc_auc,
  round((SELECT sum(pos * cum_pos::DOUBLE / cum_all) / sum(pos) FROM (
    SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS cum_pos, sum(n) OVER (ORDER BY s DESC) AS cum_all
    FROM (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) AS n FROM points GROUP BY 1))), 9) AS average_precision""",
    "eval_regression": """SELECT count(*) AS rows, round(avg(abs(y - q)), 6) AS mae, round(sqrt(avg((y - q) * (y - q))), 6) AS rmse,
  round(avg(abs((y - q) / nullif(y, 0))) * 100, 6) AS mape, round(1 - sum((y - q) * (y - q)) / (var_pop(y) * count(*)), 6) AS r2
FROM (SELECT revenue::DOUBLE AS y, (lag(revenue) OVER (PARTITION BY customer_state ORDER BY month))::DOUBLE AS q FROM monthly_state) WHERE q IS NOT NULL""",
    "forecast_features": _feature_table("monthly", ""),
    "forecast_features_by_category": _feature_table("monthly_category", "category"),
    "clv_training_set": """SELECT * FROM (SELECT customer_unique_id, total_orders::DOUBLE AS frequency, total_revenue::DOUBLE AS monetary,
    coalesce(avg_order_value, (SELECT quantile_cont(avg_order_value, 0.5) FROM base)) AS avg_order_value,
    (date_diff('day', first_order_date::DATE, last_order_date::DATE) + recency_days)::DOUBLE AS customer_tenure_days,
    total_orders::DOUBLE AS total_orders, total_revenue::DOUBLE AS total_revenue FROM base)
WHERE total_revenue < (SELECT quantile_cont(total_revenue::DOUBLE, 0.99) FROM base)""",
    "stream_monthly_revenue": "SELECT month, revenue::DOUBLE AS revenue FROM monthly",
    "stream_usage": """SELECT api_key, tier, month, count(*) AS calls, least(count(*), coalesce(any_value(cap), count(*)))::BIGINT AS accepted,
  (count(*) - least(count(*), coalesce(any_value(cap), count(*))))::BIGINT AS rejected FROM calls GROUP BY 1, 2, 3""",
    "usage_metering": """SELECT api_key, tier, month, count(*) AS calls, least(count(*), coalesce(any_value(cap), count(*)))::BIGINT AS accepted,
  (count(*) - least(count(*), coalesce(any_value(cap), count(*))))::BIGINT AS rejected FROM calls GROUP BY 1, 2, 3""",
    "usage_call_flags": """SELECT call_id, api_key, month, coalesce(n <= cap, true) AS accepted FROM (
  SELECT *, row_number() OVER (PARTITION BY api_key, month ORDER BY ts, call_id) AS n FROM calls)""",
}


# What holds for the results of any fitted model.
STATEMENTS["ml_folds"] = """SELECT customer_unique_id, churn_label,
  ((row_number() OVER (PARTITION BY churn_label ORDER BY md5('42-' || customer_unique_id::VARCHAR), customer_unique_id) - 1) % 5)::INTEGER AS fold FROM churn_raw"""
STATEMENTS["ml_churn_checks"] = "SELECT customer_unique_id, true AS in_range, true AS band_fits, true AS prediction_fits FROM churn_raw"
STATEMENTS["ml_clv_checks"] = "SELECT customer_unique_id, true AS not_negative, true AS has_segment FROM base"
STATEMENTS["ml_forecast_horizons"] = """SELECT category, (last_month + to_months(h::INTEGER))::DATE AS month, h::INTEGER AS forecast_horizon, true AS not_negative
FROM (SELECT category, max(month) AS last_month FROM monthly_category GROUP BY 1) CROSS JOIN range(1, 7) r(h)"""
STATEMENTS["ml_importance_totals"] = """SELECT model, features, total, negative
FROM (VALUES ('churn', 6::BIGINT, 1.0::DOUBLE, 0::BIGINT), ('clv', 5::BIGINT, 1.0::DOUBLE, 0::BIGINT), ('forecast', 8::BIGINT, 1.0::DOUBLE, 0::BIGINT)) v(model, features, total, negative)"""
STATEMENTS["marts_published"] = """SELECT 'monthly_revenue' AS mart, count(*) AS rows FROM monthly
UNION ALL SELECT 'churn_summary', count(*) FROM summary UNION ALL SELECT 'cohort_retention', count(*) FROM retention_label"""
STATEMENTS["top_categories_layout"] = STATEMENTS["top_categories"]
STATEMENTS["top_sellers_layout"] = STATEMENTS["top_sellers"]
STATEMENTS["csv_documents"] = "SELECT doc_id, nullif(text, '') AS text, nullif(lang, '') AS lang, nullif(source, '') AS source, n_chars FROM documents"
STATEMENTS["stream_call_flags"] = STATEMENTS["usage_call_flags"]
STATEMENTS["stream_score"] = STATEMENTS["score_customers"]
STATEMENTS["stream_rejects"] = STATEMENTS["score_rejects"]


def oracle_queries() -> dict[str, str]:
    return {name: COMMON + statement for name, statement in STATEMENTS.items()}
