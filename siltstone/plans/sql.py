"""DuckDB SQL of the derived tables, as common table expressions."""

from __future__ import annotations

from .order_events import AS_OF, UPDATED_AT

EVENTS = """
lines AS (
  SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT) AS u FROM lineitem
), sums AS (
  SELECT l_orderkey, count(*) AS n, CAST(sum(q * u) AS BIGINT) AS s FROM lines GROUP BY 1
), base AS (
  SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderdate AS occurred_at, o_orderstatus, coalesce(n, 0) AS n, coalesce(s, 0) AS s
  FROM orders LEFT JOIN sums ON l_orderkey = o_orderkey
), ev AS (
  SELECT k, CAST(k AS VARCHAR) AS event_id, CAST(k AS VARCHAR) AS order_id, customer_id, occurred_at, n, s, seq,
    CASE WHEN o_orderstatus = 'F' THEN 'CANCELLED' ELSE 'PLACED' END AS status,
    CASE WHEN k % 101 = 0 THEN -1 WHEN k % 97 = 0 THEN s + 1 ELSE s END AS total_amount_cents,
    CASE WHEN k % 50 = 49 THEN 'XXX' ELSE ['USD', 'EUR', 'GBP', 'CAD', 'AUD', 'JPY', 'INR'][CAST(k % 7 AS INT) + 1] END AS currency
  FROM base CROSS JOIN (SELECT unnest([0, 1]) AS seq) WHERE seq = 0 OR k % 53 = 0
), own AS (
  SELECT *, CASE WHEN n = 0 THEN 'empty_items_array' WHEN total_amount_cents <= 0 THEN 'non_positive_total' WHEN total_amount_cents <> s THEN 'total_mismatch' END AS own_reason FROM ev
), judged AS (
  SELECT *, CASE WHEN seq = 1 AND own_reason IS NULL THEN 'duplicate_event_id' ELSE own_reason END AS failure_reason,
    CASE WHEN seq = 1 AND own_reason IS NULL THEN 'silver_dedup' WHEN own_reason IS NOT NULL THEN 'silver_validation' END AS failure_stage FROM own
)"""

SILVER = EVENTS + """, silver AS (
  SELECT event_id, order_id, customer_id, occurred_at, currency, total_amount_cents, CAST(n AS INT) AS item_count FROM judged WHERE failure_reason IS NULL
)"""

GOLD = SILVER + f""", gold AS (
  SELECT CAST(occurred_at AS DATE) AS order_date, currency, count(DISTINCT order_id) AS order_count, CAST(sum(total_amount_cents) AS BIGINT) AS total_revenue_cents,
    avg(total_amount_cents) AS avg_order_cents, quantile_cont(total_amount_cents, 0.5) AS p50_order_cents, quantile_cont(total_amount_cents, 0.95) AS p95_order_cents,
    CAST(sum(item_count) AS BIGINT) AS item_count, count(DISTINCT customer_id) AS unique_customers, TIMESTAMP '{UPDATED_AT}' AS updated_at
  FROM silver GROUP BY 1, 2
)"""

LETTERS = EVENTS + """, letters AS (
  SELECT event_id, failure_reason, failure_stage, k % 10 = 0 AS late_arrival, occurred_at + to_hours(CAST(k % 24 AS INT)) AS arrived_at FROM judged WHERE failure_reason IS NOT NULL
)"""

_CHECKS = (
    ("order_id_not_null", "completeness", 1.0, "order_id IS NOT NULL"),
    ("customer_id_not_null", "completeness", 0.999, "customer_id IS NOT NULL"),
    ("total_amount_positive", "validity", 0.999, "total_amount_cents > 0"),
    ("total_amount_reasonable", "validity", 0.9999, "total_amount_cents < 100000000"),
    ("items_total_consistency", "consistency", 0.999, "n > 0 AND s = total_amount_cents"),
    ("currency_valid_iso4217", "validity", 0.999, "currency IN ('USD', 'EUR', 'GBP', 'CAD', 'AUD', 'JPY', 'INR')"),
    ("item_count_positive", "validity", 1.0, "n > 0"),
)

QUALITY = EVENTS + ", checks AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{name}' AS check_name, '{dimension}' AS dimension, {threshold}::DOUBLE AS threshold, event_id, date_trunc('day', occurred_at) AS window_start, {test} AS ok FROM ev" for name, dimension, threshold, test in _CHECKS
) + """
), results AS (
  SELECT 'silver_validation' AS pipeline_stage, 'silver.orders' AS table_name, check_name, dimension, count(*) AS total_record_count, count(*) FILTER (WHERE ok) AS passed_record_count,
    count(*) FILTER (WHERE NOT ok) AS failed_record_count, round(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 6) AS quality_score, threshold,
    count(*) FILTER (WHERE ok) / count(*)::DOUBLE >= threshold AS threshold_met, list_slice(list_sort(list(event_id) FILTER (WHERE NOT ok)), 1, 10) AS ids,
    window_start, window_start + INTERVAL 1 DAY AS window_end, window_start + INTERVAL 1 DAY AS evaluated_at
  FROM checks GROUP BY check_name, dimension, threshold, window_start
)"""


def _metric_rows() -> str:
    parts = ["SELECT partition_date, 'row_count' AS metric_name, n::DOUBLE AS metric_value FROM daily"]
    for c in ("value", "user_id"):
        for stat in ("null_rate", "mean", "stddev", "p95", "distinct_count"):
            parts.append(f"SELECT partition_date, '{stat}_{c}', {stat}_{c}::DOUBLE FROM daily WHERE {stat}_{c} IS NOT NULL")
    return "\n  UNION ALL ".join(parts)


_STATS = ",\n    ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) / count(*)::DOUBLE AS null_rate_{c}, avg({c}) AS mean_{c}, stddev_samp({c}) AS stddev_{c}, quantile_cont({c}, 0.95) AS p95_{c}, count(DISTINCT {c}) AS distinct_count_{c}" for c in ("value", "user_id")
)

METRICS = f"""
daily AS (
  SELECT CAST(ts AS DATE) AS partition_date, count(*) AS n,
    {_STATS}
  FROM events GROUP BY 1
), flat AS (
  {_metric_rows()}
), based AS (
  SELECT *, avg(metric_value) OVER w AS a, stddev_samp(metric_value) OVER w AS sd FROM flat
  WINDOW w AS (PARTITION BY metric_name ORDER BY partition_date RANGE BETWEEN INTERVAL 8 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)
), metrics AS (
  SELECT 'events' AS table_name, partition_date, metric_name, round(metric_value, 6) AS metric_value, a AS baseline_7d_avg, sd AS baseline_7d_stddev,
    CASE WHEN sd > 0 THEN round((metric_value - a) / sd, 3) END AS z_score, coalesce(sd > 0 AND abs(round((metric_value - a) / sd, 3)) > 3.0, false) AS anomaly_detected,
    TIMESTAMP '2024-01-31 00:00:00' AS collected_at
  FROM based
)"""

NOW = f"TIMESTAMP '{AS_OF}'"
