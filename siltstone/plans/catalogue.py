"""Every registered query, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import cents, latest_by, metric_parts, modes, ratio_pct, rounded, stable_id
from ..operators import cdc, drift, gold, lineage, monitor, quality, silver, slo
from ..streaming import windows
from . import order_events as oe
from . import sql as s

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the other engine has them."""
    return df.select(*(F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in df.schema))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- Bronze to Silver --------------------------------------------------------


@query(f"""WITH {s.EVENTS} SELECT coalesce(failure_stage, 'silver') AS outcome_stage, coalesce(failure_reason, 'valid') AS outcome, count(*) AS n, CAST(sum(total_amount_cents) AS BIGINT) AS total_cents FROM judged GROUP BY 1, 2""")
def silver_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oe.judged(spark, sf_dir)
    return rows.groupBy(F.coalesce("failure_stage", F.lit("silver")).alias("outcome_stage"), F.coalesce("failure_reason", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount_cents").alias("total_cents"))


@query(f"""WITH {s.SILVER} SELECT event_id, order_id, customer_id, occurred_at, currency, total_amount_cents, item_count, 'trace-' || event_id AS trace_id, true AS _is_valid FROM silver""")
def silver_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.silver_orders(spark, sf_dir).drop("items_json", "_ingested_at")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS order_id, count(*) AS n_items, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT)) AS BIGINT) AS items_total FROM lineitem GROUP BY 1""")
def silver_items_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items serialised to JSON and read back give the same totals."""
    events = oe.order_events(spark, sf_dir).where("seq = 0 AND items IS NOT NULL")
    back = F.from_json(F.to_json("items"), T.ArrayType(silver.ITEM))
    return events.select("order_id", F.size(back).cast("long").alias("n_items"), silver.items_total(back).alias("items_total"))


@query(f"""WITH {s.LETTERS} SELECT event_id, failure_reason, failure_stage, late_arrival, arrived_at, 'orders.placed' AS original_topic FROM letters""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.dead_letters(spark, sf_dir).select("event_id", "failure_reason", "failure_stage", "late_arrival", "arrived_at", "original_topic")


# --- Gold and serving --------------------------------------------------------

_PCT = "round(p50_order_cents, 2) AS p50_order_cents, round(p95_order_cents, 2) AS p95_order_cents"


@query(f"""WITH {s.GOLD} SELECT order_date, currency, order_count, total_revenue_cents, round(avg_order_cents, 4) AS avg_order_cents, {_PCT}, item_count, unique_customers, updated_at FROM gold""")
def q01_gold_daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = oe.gold_summary(spark, sf_dir)
    return g.withColumn("avg_order_cents", F.round("avg_order_cents", 4)).withColumn("p50_order_cents", F.round("p50_order_cents", 2)).withColumn("p95_order_cents", F.round("p95_order_cents", 2))


@query(f"""WITH {s.GOLD} SELECT order_date, currency, order_count, round(total_revenue_cents / 100.0, 2) AS revenue_usd, round(avg_order_cents / 100.0 + 1e-7, 2) AS avg_order_usd FROM gold WHERE order_date >= CAST({s.NOW} AS DATE) - 7""")
def q02_recent_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gold.recent_revenue(oe.gold_summary(spark, sf_dir), oe.now())
    return out.withColumn("revenue_usd", F.col("revenue_usd").cast("double"))


@query(f"""WITH {s.SILVER} SELECT CAST(occurred_at AS DATE) AS order_date, round(CAST(sum(total_amount_cents) AS DOUBLE) / 100.0, 2) AS revenue_usd FROM silver WHERE occurred_at < TIMESTAMP '2001-07-01' GROUP BY 1""")
def q03_time_travel_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits, one read as of the time between them."""
    from ..sources.snapshots import SnapshotTable
    from ..sources.scratch import scratch_path

    table = SnapshotTable(spark, scratch_path(spark, "gold"))
    rows = oe.silver_orders(spark, sf_dir)
    at = F.lit(oe.UPDATED_AT).cast("timestamp_ntz")
    table.commit(gold.daily_summary(rows.where("occurred_at < '2001-07-01'"), at), committed_at="2001-07-01T00:00:00")
    table.commit(gold.daily_summary(rows, at), mode="replace", committed_at="2001-08-01T00:00:00")
    return gold.revenue_by_day(table.read(as_of="2001-07-30T00:00:00"))


@query(f"""WITH {s.GOLD} SELECT max(updated_at) AS latest_write, CAST(epoch({s.NOW}) - epoch(max(updated_at)) AS BIGINT) AS data_age_seconds, CASE WHEN epoch({s.NOW}) - epoch(max(updated_at)) > 300 THEN 'SLA_BREACH' ELSE 'OK' END AS freshness_status FROM gold""")
def q04_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.freshness(oe.gold_summary(spark, sf_dir), oe.now())


def _mode_cte(table: str, keys: str, value: str, where: str = "true") -> str:
    return f"SELECT {keys}, {value} FROM (SELECT {keys}, {value}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {value}) AS r FROM {table} WHERE {where} GROUP BY {keys}, {value}) WHERE r = 1"


#: The end of a day with dead letters.
_BUSY = "1997-03-05 00:00:00"


@query(f"""WITH {s.LETTERS}, recent AS (SELECT *, date_trunc('hour', arrived_at) AS hour FROM letters WHERE arrived_at >= TIMESTAMP '{_BUSY}' - INTERVAL 24 HOURS AND arrived_at < TIMESTAMP '{_BUSY}')
SELECT c.hour, dlq_count, late_arrivals, st.failure_stage AS dominant_failure_stage, re.failure_reason AS dominant_failure_reason
FROM (SELECT hour, count(*) AS dlq_count, count(*) FILTER (WHERE late_arrival) AS late_arrivals FROM recent GROUP BY 1) c
JOIN ({_mode_cte('recent', 'hour', 'failure_stage')}) st USING (hour) JOIN ({_mode_cte('recent', 'hour', 'failure_reason')}) re USING (hour)""")
def q05_dead_letters_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dead_letters_by_hour(oe.dead_letters(spark, sf_dir), F.lit(_BUSY).cast("timestamp_ntz"))


@query(f"""WITH {s.LETTERS}, recent AS (SELECT *, date_trunc('hour', arrived_at) AS hour FROM letters)
SELECT c.hour, dlq_count, late_arrivals, st.failure_stage AS dominant_failure_stage, re.failure_reason AS dominant_failure_reason
FROM (SELECT hour, count(*) AS dlq_count, count(*) FILTER (WHERE late_arrival) AS late_arrivals FROM recent GROUP BY 1) c
JOIN ({_mode_cte('recent', 'hour', 'failure_stage')}) st USING (hour) JOIN ({_mode_cte('recent', 'hour', 'failure_reason')}) re USING (hour)""")
def dead_letters_by_hour_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the whole history."""
    return gold.dead_letters_by_hour(oe.dead_letters(spark, sf_dir), oe.now(), hours=24 * 366 * 10)


@query(f"""WITH {s.GOLD} SELECT order_date, round(CAST(sum(total_revenue_cents) AS DOUBLE) / 100.0, 2) AS revenue_usd, CAST(sum(unique_customers) AS BIGINT) AS customers, round(CAST(sum(total_revenue_cents) AS DOUBLE) / nullif(CAST(sum(order_count) AS DOUBLE), 0) / 100 + 1e-7, 2) AS avg_order_usd FROM gold WHERE order_date >= CAST({s.NOW} AS DATE) - 30 GROUP BY 1""")
def q26_revenue_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = oe.gold_summary(spark, sf_dir).where(F.col("order_date") >= F.date_sub(F.to_date(oe.now()), 30))
    revenue = F.sum("total_revenue_cents").cast("double")
    return g.groupBy("order_date").agg(F.round(revenue / 100.0, 2).alias("revenue_usd"), F.sum("unique_customers").alias("customers"), rounded(revenue / F.nullif(F.sum("order_count").cast("double"), F.lit(0.0)) / 100, 2).alias("avg_order_usd"))


@query(f"""WITH {s.SILVER} SELECT CAST(occurred_at AS DATE) AS order_date, currency, CAST(sum(total_amount_cents) AS BIGINT) AS total_revenue_cents FROM silver WHERE CAST(occurred_at AS DATE) = DATE '2001-06-13' GROUP BY 1, 2""")
def q27_time_travel_one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.scratch import scratch_path
    from ..sources.snapshots import SnapshotTable

    table = SnapshotTable(spark, scratch_path(spark, "gold_day"))
    summary = oe.gold_summary(spark, sf_dir)
    table.commit(summary.where("order_date < '2001-07-01'"), committed_at="2001-07-01T00:00:00")
    table.commit(summary, mode="replace", committed_at="2001-08-01T00:00:00")
    return table.read(as_of="2001-07-14T00:00:00").where("order_date = '2001-06-13'").select("order_date", "currency", "total_revenue_cents")


@query(f"""WITH {s.LETTERS} SELECT date_trunc('hour', arrived_at) AS hour, failure_stage, failure_reason, count(*) AS event_count FROM letters WHERE arrived_at >= {s.NOW} - INTERVAL 720 HOURS AND arrived_at < {s.NOW} GROUP BY 1, 2, 3""")
def q28_dead_letter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dead_letter_audit(oe.dead_letters(spark, sf_dir), oe.now(), hours=720)


@query(f"""WITH {s.EVENTS} SELECT CAST(occurred_at AS DATE) AS order_date, CAST(sum(total_amount_cents) AS BIGINT) AS total_revenue_cents, count(DISTINCT customer_id) AS unique_customers, count(*) AS total_orders, count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled_orders, round(quantile_cont(total_amount_cents, 0.99), 2) AS p99_order_value_cents FROM judged WHERE failure_reason IS NULL GROUP BY 1""")
def q29_gold_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oe.judged(spark, sf_dir).where("failure_reason IS NULL")
    return gold.variant_summary(rows).withColumn("p99_order_value_cents", F.round("p99_order_value_cents", 2))


@query(f"""WITH {s.GOLD} SELECT order_date, round(CAST(sum(total_revenue_cents) AS DOUBLE) / 100.0, 2) AS revenue_usd, CAST(sum(order_count) AS BIGINT) AS order_count FROM gold WHERE order_date >= CAST({s.NOW} AS DATE) - 7 GROUP BY 1""")
def q32_weekly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = oe.gold_summary(spark, sf_dir).where(F.col("order_date") >= F.date_sub(F.to_date(oe.now()), 7))
    return g.groupBy("order_date").agg(F.round(F.sum("total_revenue_cents").cast("double") / 100.0, 2).alias("revenue_usd"), F.sum("order_count").alias("order_count"))


def _refreshed_by_late_rows(table, rows: DataFrame) -> None:
    late = F.col("order_id").cast("long") % 5 == 0
    at = F.lit(oe.UPDATED_AT).cast("timestamp")
    gold.refresh(table, rows.where(~late), rows.where(~late), at)
    gold.refresh(table, rows, rows.where(late), at)


@query(f"""WITH {s.GOLD} SELECT order_date, currency, order_count, total_revenue_cents, item_count, unique_customers FROM gold WHERE order_date >= DATE '2001-06-01'""")
def gold_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold built from most of Silver and refreshed by late rows equals Gold built at once; the days of the twin are read from the whole table."""
    from ..sources.scratch import scratch_path
    from ..sources.snapshots import SnapshotTable

    table = SnapshotTable(spark, scratch_path(spark, "gold_incremental"))
    _refreshed_by_late_rows(table, oe.silver_orders(spark, sf_dir))
    return table.read().where("order_date >= '2001-06-01'").select("order_date", "currency", "order_count", "total_revenue_cents", "item_count", "unique_customers")


# --- quality -----------------------------------------------------------------

_Q24 = f"evaluated_at >= {s.NOW} - INTERVAL 24 HOURS AND evaluated_at <= {s.NOW}"
_Q30 = f"evaluated_at >= {s.NOW} - INTERVAL 30 DAYS AND evaluated_at <= {s.NOW}"
_Q7 = f"evaluated_at >= {s.NOW} - INTERVAL 7 DAYS AND evaluated_at <= {s.NOW}"


@query(f"""WITH {s.QUALITY} SELECT pipeline_stage, table_name, check_name, dimension, total_record_count, passed_record_count, failed_record_count, quality_score, threshold, threshold_met, coalesce(to_json(ids), '[]') AS sample_failure_ids, window_start, window_end, evaluated_at FROM results""")
def quality_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.quality_results(spark, sf_dir).drop("run_id")


@query(f"""WITH {s.QUALITY}, q AS (SELECT * FROM results WHERE {_Q24}), totals AS (
  SELECT pipeline_stage, CAST(sum(total_record_count) AS BIGINT) AS total_records, CAST(sum(passed_record_count) AS BIGINT) AS passed_records, CAST(sum(failed_record_count) AS BIGINT) AS failed_records,
    round(CAST(sum(passed_record_count) AS DOUBLE) * 100.0 / nullif(CAST(sum(total_record_count) AS DOUBLE), 0), 3) AS quality_pct, count(*) FILTER (WHERE NOT threshold_met) AS checks_below_threshold FROM q GROUP BY 1)
SELECT CASE pipeline_stage WHEN 'bronze_ingestion' THEN '1. Bronze Ingestion' WHEN 'silver_validation' THEN '2. Silver Validation' WHEN 'silver_dedup' THEN '3. Silver Dedup' WHEN 'gold_aggregation' THEN '4. Gold Aggregation' ELSE pipeline_stage END AS stage,
  total_records, passed_records, failed_records, quality_pct, checks_below_threshold, coalesce(check_name, '—') AS top_failing_check, CASE WHEN quality_pct >= 99.9 THEN '✓' WHEN quality_pct >= 99.0 THEN '⚠' ELSE '✗' END AS status
FROM totals LEFT JOIN ({_mode_cte('q', 'pipeline_stage', 'check_name', 'failed_record_count > 0')}) USING (pipeline_stage)""")
def q06_quality_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.waterfall(oe.quality_results(spark, sf_dir), oe.now())


@query(f"""WITH {s.QUALITY} SELECT date_trunc('hour', evaluated_at) AS hour, pipeline_stage, round(avg(quality_score) * 100, 3) AS avg_quality_pct, round(min(quality_score) * 100, 6) AS min_quality_pct, count(*) FILTER (WHERE NOT threshold_met) AS threshold_breaches FROM results WHERE {_Q30} GROUP BY 1, 2""")
def q07_quality_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.hourly_trend(oe.quality_results(spark, sf_dir), oe.now())


@query(f"""WITH {s.QUALITY} SELECT pipeline_stage, check_name, dimension, CAST(sum(failed_record_count) AS BIGINT) AS total_failures, CAST(sum(total_record_count) AS BIGINT) AS total_records, round(CAST(sum(failed_record_count) AS DOUBLE) * 100.0 / nullif(CAST(sum(total_record_count) AS DOUBLE), 0), 4) AS failure_rate_pct, round(min(quality_score) * 100, 6) AS worst_quality_pct, count(*) FILTER (WHERE NOT threshold_met) AS windows_below_threshold, max(evaluated_at) AS last_failure_at FROM results WHERE {_Q7} AND failed_record_count > 0 GROUP BY 1, 2, 3""")
def q08_failure_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failure_breakdown(oe.quality_results(spark, sf_dir), oe.now())


@query(f"""WITH {s.QUALITY} SELECT evaluated_at, pipeline_stage, check_name, failed_record_count, unnest(ids) AS failed_event_id FROM results WHERE evaluated_at >= TIMESTAMP '{_BUSY}' - INTERVAL 1 HOUR AND evaluated_at <= TIMESTAMP '{_BUSY}' AND failed_record_count > 0 ORDER BY evaluated_at DESC, failed_record_count DESC, pipeline_stage, check_name, failed_event_id LIMIT 100""")
def q09_failing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failing_ids(oe.quality_results(spark, sf_dir), F.lit(_BUSY).cast("timestamp_ntz"))


@query(f"""WITH {s.QUALITY} SELECT pipeline_stage, check_name, threshold AS required_threshold, count(*) AS total_windows, count(*) FILTER (WHERE threshold_met) AS passing_windows, round(CAST(count(*) FILTER (WHERE threshold_met) AS DOUBLE) * 100.0 / count(*), 3) AS compliance_pct FROM results WHERE {_Q30} GROUP BY 1, 2, 3""")
def q10_quality_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compliance(oe.quality_results(spark, sf_dir), oe.now())


@query(f"""WITH {s.QUALITY}, bad AS (SELECT check_name, failed_record_count, unnest(ids) AS event_id FROM results WHERE {_Q30}) SELECT check_name, failed_record_count, bad.event_id, failure_reason FROM bad JOIN judged ON judged.event_id = bad.event_id AND judged.failure_reason IS NOT NULL""")
def q30_dead_letter_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dead_letter_context(oe.quality_results(spark, sf_dir), oe.dead_letters(spark, sf_dir), oe.now(), "30 DAYS").drop("raw_payload")


@query(f"""WITH {s.GOLD}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE total_revenue_cents > 0) AS a, count(*) FILTER (WHERE order_count > 0) AS b, count(*) FILTER (WHERE unique_customers <= order_count) AS c, count(*) FILTER (WHERE epoch(updated_at) >= epoch({s.NOW}) - 600) AS d FROM gold)
SELECT check_name, n AS total_record_count, p AS passed_record_count, round(p / n::DOUBLE, 6) AS quality_score, p / n::DOUBLE >= threshold AS threshold_met FROM t, LATERAL (VALUES ('total_revenue_positive', a, 1.0), ('order_count_positive', b, 0.99), ('unique_customers_lte_order_count', c, 1.0), ('updated_at_fresh', d, 0.999)) v(check_name, p, threshold)""")
def quality_gold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.profile(oe.gold_summary(spark, sf_dir), quality.ORDER_RULES["gold_aggregation"], "gold_aggregation", oe.now(), None)
    return rows.select("check_name", "total_record_count", "passed_record_count", "quality_score", "threshold_met")


@query(f"""WITH {s.EVENTS}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id IS NOT NULL) AS a, count(*) FILTER (WHERE occurred_at IS NOT NULL) AS b, count(*) FILTER (WHERE epoch(occurred_at) <= epoch({s.NOW}) + 300) AS c, count(*) FILTER (WHERE occurred_at >= {s.NOW} - INTERVAL 90 DAYS) AS d FROM ev)
SELECT check_name, n AS total_record_count, p AS passed_record_count, round(p / n::DOUBLE, 6) AS quality_score, p / n::DOUBLE >= threshold AS threshold_met FROM t, LATERAL (VALUES ('event_id_not_null', a, 1.0), ('occurred_at_not_null', b, 1.0), ('occurred_at_not_future', c, 0.999), ('occurred_at_not_stale', d, 0.999)) v(check_name, p, threshold)""")
def quality_bronze_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.profile(oe.order_events(spark, sf_dir), quality.ORDER_RULES["bronze_ingestion"], "bronze_ingestion", oe.now(), None)
    return rows.select("check_name", "total_record_count", "passed_record_count", "quality_score", "threshold_met")


# --- monitoring --------------------------------------------------------------

_MNOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _mnow():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


@query(f"""WITH {s.METRICS} SELECT table_name, partition_date, metric_name, round(metric_value + 1e-9, 3) AS metric_value, round(baseline_7d_avg + 1e-9, 3) AS baseline_7d_avg, round(baseline_7d_stddev + 1e-9, 3) AS baseline_7d_stddev, round(z_score + 1e-9, 2) AS z_score, anomaly_detected FROM metrics""")
def monitor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = oe.silver_metrics(spark, sf_dir)
    return m.select("table_name", "partition_date", "metric_name", *(F.round(F.col(c) + 1e-9, 3).alias(c) for c in ("metric_value", "baseline_7d_avg", "baseline_7d_stddev")), F.round(F.col("z_score") + 1e-9, 2).alias("z_score"), "anomaly_detected")


_DEV = "round((metric_value - baseline_7d_avg) / nullif(baseline_7d_avg, 0) * 100, 1)"


@query(f"""WITH {s.METRICS} SELECT table_name, partition_date, CAST(metric_value AS BIGINT) AS row_count, round(baseline_7d_avg) AS baseline_avg_rows, round(z_score + 1e-9, 2) AS z_score, CASE WHEN abs(z_score) > 3.0 THEN '✗ ANOMALY' WHEN abs(z_score) > 2.0 THEN '⚠ WARNING' ELSE '✓ NORMAL' END AS status, {_DEV} AS deviation_pct FROM metrics WHERE metric_name = 'row_count' AND partition_date >= CAST({_MNOW} AS DATE) - 7""")
def q16_volume_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.volume_anomalies(oe.silver_metrics(spark, sf_dir), _mnow())


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS partition_date, count(*)::DOUBLE AS b, count(*) FILTER (WHERE event_type <> 'error')::DOUBLE AS si, count(DISTINCT event_type)::DOUBLE AS g FROM events GROUP BY 1)
SELECT partition_date, b AS bronze_rows, si AS silver_rows, g AS gold_rows, round((b - si) * 100.0 / nullif(b, 0), 3) AS silver_rejection_pct FROM d""")
def q17_volume_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.volume_trend(_layers(spark, sf_dir), _mnow())


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of the events table: all, those that are no errors, and a row a day and type."""
    events = oe.table(spark, sf_dir, "events")
    daily = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    layers = {"bronze.orders": events, "silver.orders": events.where("event_type <> 'error'"), "gold.order_daily_summary": daily.withColumn("ts", F.col("day").cast("timestamp_ntz"))}
    out = None
    for name, df in layers.items():
        rows = monitor.profile(df, name, "ts", [])
        out = rows if out is None else out.unionByName(rows)
    return monitor.scored(out, _mnow())


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS partition_date, count(*)::DOUBLE AS b, count(*) FILTER (WHERE event_type <> 'error')::DOUBLE AS si FROM events GROUP BY 1)
SELECT partition_date, b - si AS rejected_in_silver, round((b - si) * 100.0 / nullif(b, 0), 3) AS rejection_pct FROM d""")
def q31_layer_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.divergence(monitor.volume_trend(_layers(spark, sf_dir), _mnow()))


@query(f"""WITH {s.METRICS} SELECT partition_date, table_name, regexp_extract(metric_name, '^(mean|stddev|p95)_(.*)$', 2) AS column_name, regexp_extract(metric_name, '^(mean|stddev|p95)_(.*)$', 1) AS stat_type, round(metric_value + 1e-9, 2) AS value, round(baseline_7d_avg + 1e-9, 2) AS baseline, round(z_score + 1e-9, 2) AS z_score, anomaly_detected FROM metrics WHERE regexp_matches(metric_name, '^(mean|stddev|p95)_') AND partition_date >= CAST({_MNOW} AS DATE) - 14""")
def q18_distribution_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.distribution_drift(oe.silver_metrics(spark, sf_dir), _mnow())


@query(f"""WITH {s.METRICS} SELECT partition_date, table_name, replace(metric_name, 'null_rate_', '') AS column_name, round(metric_value * 100, 4) AS null_rate_pct, CASE WHEN metric_value > 0.001 THEN '✗ ABOVE 0.1% THRESHOLD' WHEN metric_value > 0 THEN '⚠ SOME NULLS' ELSE '✓ CLEAN' END AS status FROM metrics WHERE metric_name LIKE 'null\\_rate\\_%' ESCAPE '\\' AND partition_date >= CAST({_MNOW} AS DATE) - 14""")
def q19_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.null_rates(oe.silver_metrics(spark, sf_dir), _mnow())


@query(f"""WITH {s.METRICS} SELECT collected_at, table_name, metric_name, round(metric_value + 1e-9, 2) AS current_value, round(baseline_7d_avg + 1e-9, 2) AS expected_value, round(z_score + 1e-9, 2) AS z_score, {_DEV} AS deviation_pct FROM metrics WHERE anomaly_detected""")
def q20_active_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.active_anomalies(oe.silver_metrics(spark, sf_dir), _mnow())


@query("""SELECT CAST(ts AS DATE) AS partition_date, count(*) AS row_count FROM events GROUP BY 1""")
def q22_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("partition_date")).agg(F.count(F.lit(1)).alias("row_count"))


def _baseline(metric: str) -> str:
    return f"""WITH {s.METRICS} SELECT round(avg(metric_value), 4) AS avg_value, round(stddev_samp(metric_value), 4) AS stddev_value FROM metrics WHERE metric_name = '{metric}' AND partition_date BETWEEN DATE '2024-01-22' AND DATE '2024-01-29'"""


def _baseline_of(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    m = oe.silver_metrics(spark, sf_dir).where((F.col("metric_name") == metric) & F.col("partition_date").between("2024-01-22", "2024-01-29"))
    return m.agg(F.round(F.avg("metric_value"), 4).alias("avg_value"), F.round(F.stddev("metric_value"), 4).alias("stddev_value"))


@query(_baseline("row_count"))
def q23_row_count_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline_of(spark, sf_dir, "row_count")


@query("""SELECT count(*) FILTER (WHERE value IS NULL) * 1.0::DOUBLE / count(*) AS null_rate, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, round(quantile_cont(value, 0.95), 4) AS p95, count(DISTINCT value) AS distinct_count FROM events""")
def q24_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return oe.table(spark, sf_dir, "events").agg(F.try_divide(F.count_if(v.isNull()), F.count(F.lit(1))).cast("double").alias("null_rate"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev(v), 6).alias("stddev"), F.round(F.percentile(v, 0.95), 4).alias("p95"), F.count_distinct(v).alias("distinct_count"))


@query(_baseline("mean_value"))
def q25_column_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline_of(spark, sf_dir, "mean_value")


@query("""SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY 1""")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog estimates differ between engines: they must lie within three of their standard errors (5 %) of the exact count."""
    exact, estimate = F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id").alias("about")
    rows = oe.table(spark, sf_dir, "events").groupBy("event_type").agg(exact, estimate)
    return rows.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.15 * F.col("users")).alias("near"))


# --- lineage -----------------------------------------------------------------


def _lineage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a job and day of the events table: every third fails; row counts from the day's events."""
    counts = oe.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("event_type") != "error").alias("rows_out"))
    jobs = F.array(*(F.struct(F.lit(j).alias("job_name"), F.lit(lineage.lineage_json(e)).alias("lineage")) for j, e in (("silver_orders", lineage.BRONZE_TO_SILVER), ("gold_daily_summary", lineage.SILVER_TO_GOLD))))
    runs = counts.select("day", "rows_in", "rows_out", F.explode(jobs).alias("j")).withColumn("ok", F.day("day") % 3 != 0)
    ended = F.when(F.col("ok"), "COMPLETE").otherwise("FAIL")
    steps = runs.select("*", F.explode(F.array(F.struct(F.lit("START").alias("event_type"), F.lit(0).alias("minute")), F.struct(ended.alias("event_type"), F.lit(10).alias("minute")))).alias("e"))
    done = F.col("e.event_type") == "COMPLETE"
    return steps.select(
        F.concat_ws(":", F.col("j.job_name"), F.col("day").cast("string"), F.col("e.event_type")).alias("event_id"),
        (F.col("day").cast("timestamp_ntz") + F.make_interval(mins=F.col("e.minute"))).alias("event_time"),
        F.col("e.event_type").alias("event_type"),
        F.lit("lakehouse").alias("job_namespace"),
        F.col("j.job_name").alias("job_name"),
        F.concat_ws(":", F.col("j.job_name"), F.col("day").cast("string")).alias("run_id"),
        F.lit("[]").alias("input_datasets"),
        F.lit("[]").alias("output_datasets"),
        F.when(done, F.col("j.lineage")).otherwise("[]").alias("column_lineage_json"),
        F.when(done, F.col("rows_in")).alias("row_count_input"),
        F.when(done, F.col("rows_out")).alias("row_count_output"),
        F.when(F.col("e.event_type") == "FAIL", "failed").alias("error_message"),
    )


def _values(edges: tuple, job: str) -> str:
    return ", ".join(f"('{job}', '{c}', '{d}', '{f}', '{t}')" for c, d, f, t in edges)


_EDGES = f"edges(job_name, output_column, source_dataset, source_field, transform_type) AS (VALUES {_values(lineage.BRONZE_TO_SILVER, 'silver_orders')}, {_values(lineage.SILVER_TO_GOLD, 'gold_daily_summary')})"
_RUNS = """days AS (SELECT CAST(ts AS DATE) AS day, count(*) AS rows_in, count(*) FILTER (WHERE event_type <> 'error') AS rows_out FROM events GROUP BY 1),
jobs(job_name) AS (VALUES ('silver_orders'), ('gold_daily_summary')), runs AS (SELECT job_name, job_name || ':' || CAST(day AS VARCHAR) AS run_id, day::TIMESTAMP AS t0, day::TIMESTAMP + INTERVAL 10 MINUTES AS t1, day(day) % 3 <> 0 AS ok, rows_in, rows_out FROM days, jobs)"""


@query(f"""WITH {_EDGES} SELECT DISTINCT source_dataset, source_field, transform_type, output_column, job_name AS produced_by FROM edges""")
def q11_lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.edge_list(_lineage_events(spark, sf_dir))


@query(f"""WITH {_EDGES} SELECT DISTINCT source_field, output_column, transform_type, job_name FROM edges WHERE source_field = 'total_amount_cents'""")
def q12_forward_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.forward_impact(_lineage_events(spark, sf_dir), "total_amount_cents")


@query(f"""WITH {_EDGES} SELECT DISTINCT output_column, source_dataset, source_field, transform_type, job_name AS transformation_step FROM edges WHERE output_column = 'total_revenue_cents'""")
def q13_backward_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.backward_trace(_lineage_events(spark, sf_dir), "total_revenue_cents")


@query(f"""WITH RECURSIVE {_EDGES}, walk(col, hops) AS (SELECT DISTINCT output_column, 1 FROM edges WHERE source_field = 'items' UNION SELECT e.output_column, w.hops + 1 FROM walk w JOIN edges e ON e.source_field = w.col WHERE w.hops < 5) SELECT col AS "column", min(hops) AS hops FROM walk GROUP BY 1""")
def lineage_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.reachable(_lineage_events(spark, sf_dir), "items")


@query(f"""WITH {_RUNS} SELECT job_name, run_id, t0 AS started_at, CASE WHEN ok THEN t1 END AS completed_at, CASE WHEN NOT ok THEN t1 END AS failed_at, ok AS succeeded, CASE WHEN ok THEN rows_in END AS rows_read, CASE WHEN ok THEN rows_out END AS rows_written, CASE WHEN ok THEN round(CAST(rows_out AS DOUBLE) * 100.0 / nullif(CAST(rows_in AS DOUBLE), 0), 3) END AS pass_through_pct FROM runs""")
def q14_run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.run_history(_lineage_events(spark, sf_dir), _mnow(), 31)


_RUN_RULES = (("user_present", "user_id < 900", 0.95), ("value_small", "value < 100", 0.9), ("no_error", "event_type <> 'error'", 0.75))


@query(f"""WITH {_RUNS}, checks AS ({' UNION ALL '.join(f"SELECT 'silver_orders:' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, '{n}' AS check_name, {t}::DOUBLE AS threshold, {c} AS ok FROM events" for n, c, t in _RUN_RULES)}),
qr AS (SELECT run_id, check_name, count(*) FILTER (WHERE NOT ok) AS failed_record_count, round(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 6) AS quality_score, count(*) FILTER (WHERE ok) / count(*)::DOUBLE >= threshold AS threshold_met FROM checks GROUP BY run_id, check_name, threshold),
bad AS (SELECT r.run_id, r.job_name, check_name FROM qr JOIN runs r ON r.run_id = qr.run_id AND r.ok WHERE NOT threshold_met)
SELECT r.run_id, r.job_name, min(t1) AS run_time, CAST(sum(failed_record_count) AS BIGINT) AS total_failures, round(avg(quality_score) * 100, 3) AS avg_quality_pct, min(b.check_name) AS top_failing_check
FROM runs r JOIN qr USING (run_id) LEFT JOIN (SELECT run_id, min(check_name) AS check_name FROM bad GROUP BY 1) b ON b.run_id = r.run_id WHERE r.ok GROUP BY 1, 2 HAVING sum(failed_record_count) > 0""")
def q15_quality_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [quality.Rule("user_present", "validity", "less_than", 0.95, column="user_id", value=900), quality.Rule("value_small", "validity", "less_than", 0.9, column="value", value=100), quality.Rule("no_error", "validity", "in_set", 0.75, column="event_type", values=("signup", "view", "purchase", "click"))]
    run_id = F.concat(F.lit("silver_orders:"), F.date_format("window_start", "yyyy-MM-dd"))
    results = quality.profile(oe.table(spark, sf_dir, "events"), rules, "silver_validation", _mnow(), "ts", run_id=run_id)
    return lineage.quality_correlation(_lineage_events(spark, sf_dir), results, _mnow(), 31)


# --- schema drift ------------------------------------------------------------

_OLD = [drift.Field(1, "order_id", "string", True), drift.Field(2, "customer_id", "string"), drift.Field(3, "amount", "int"), drift.Field(4, "note", "string"), drift.Field(5, "tax", "decimal(10,2)"), drift.Field(6, "flag", "bigint")]
_NEW = [drift.Field(1, "order_id", "string", True), drift.Field(2, "client_id", "string"), drift.Field(3, "amount", "bigint"), drift.Field(5, "tax", "decimal(12,2)"), drift.Field(6, "flag", "int"), drift.Field(7, "channel", "string")]


@query("""SELECT * FROM (VALUES (TIMESTAMP '2024-01-31 00:00:00', 'silver.orders', 'COLUMN_DROPPED', 'warning', 'note', 'string', NULL, true), (TIMESTAMP '2024-01-31 00:00:00', 'silver.orders', 'RENAME', 'info', 'client_id', 'string', 'string', true),
(TIMESTAMP '2024-01-31 00:00:00', 'silver.orders', 'TYPE_CHANGED', 'warning', 'amount', 'int', 'bigint', true), (TIMESTAMP '2024-01-31 00:00:00', 'silver.orders', 'TYPE_CHANGED', 'warning', 'tax', 'decimal(10,2)', 'decimal(12,2)', true),
(TIMESTAMP '2024-01-31 00:00:00', 'silver.orders', 'TYPE_CHANGED', 'error', 'flag', 'bigint', 'int', false), (TIMESTAMP '2024-01-31 00:00:00', 'silver.orders', 'COLUMN_ADDED', 'info', 'channel', NULL, 'string', true)) v(detected_at, table_name, drift_type, severity, column_name, old_type, new_type, is_safe)""")
def q21_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drift.diff("silver.orders", _OLD, _NEW, datetime(2024, 1, 31))
    return drift.log(drift.events(spark, rows)).drop("details")


# --- change data -------------------------------------------------------------


def _stock_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as changes of a part's stock, in a total order (lsn); returned ones delete."""
    lines = oe.table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    lsn = F.row_number().over(order).cast("long")
    image = F.struct(F.col("l_quantity").cast("int").alias("quantity_on_hand"), F.col("l_suppkey").cast("string").alias("warehouse_id"))
    rows = lines.withColumn("lsn", lsn).withColumn("operation", F.when(F.col("l_returnflag") == "R", "DELETE").when(F.col("lsn") == 1, "INSERT").otherwise("UPDATE"))
    gone = F.col("operation") == "DELETE"
    return rows.select(
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("lsn").cast("string")).alias("event_id"), "operation", F.col("l_shipdate").alias("occurred_at"), F.col("l_partkey").cast("string").alias("sku"),
        F.when(F.col("operation") != "INSERT", image).alias("before"), F.when(~gone, image).alias("after"), F.struct("lsn").alias("source"),
    )


_LSN = """ch AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS lsn FROM lineitem)"""


@query(f"""WITH {_LSN}, last AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY lsn DESC) AS r FROM ch) SELECT CAST(l_partkey AS VARCHAR) AS sku, CAST(l_quantity AS INT) AS quantity_on_hand, CAST(l_suppkey AS VARCHAR) AS warehouse_id, lsn FROM last WHERE r = 1 AND l_returnflag <> 'R'""")
def cdc_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = cdc.unwrap(cdc.without_tombstones(_stock_changes(spark, sf_dir)))
    return cdc.latest_state(flat, ["sku"], F.col("lsn")).select("sku", "quantity_on_hand", "warehouse_id", "lsn")


@query(f"""WITH {_LSN} SELECT CASE WHEN lsn % 7 = 3 THEN 'TRUNCATE' WHEN l_returnflag = 'R' THEN 'DELETE' WHEN lsn = 1 THEN 'INSERT' ELSE 'UPDATE' END AS operation, CASE WHEN lsn % 7 = 3 THEN 'unknown_operation' WHEN lsn % 7 = 5 AND l_returnflag <> 'R' THEN 'missing_image' ELSE 'ok' END AS verdict, count(*) AS n FROM ch GROUP BY 1, 2""")
def cdc_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some envelopes are broken on purpose: an unknown operation, or no image after."""
    part = F.col("source.lsn") % 7
    rows = _stock_changes(spark, sf_dir).withColumn("operation", F.when(part == 3, "TRUNCATE").otherwise(F.col("operation"))).withColumn("after", F.when(part != 5, F.col("after")))
    verdict = F.coalesce(cdc.invalid_envelope(F.col("operation"), F.col("before"), F.col("after")), F.lit("ok"))
    return rows.groupBy("operation", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'outbox.' || event_type AS topic, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1""")
def outbox_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = oe.table(spark, sf_dir, "events")
    outbox = events.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("aggregate_type"), F.col("user_id").cast("string").alias("aggregate_id"), "event_type", F.col("props").alias("payload"), F.col("ts").alias("created_at"))
    parsed = cdc.topic_of(outbox).withColumn("k", F.from_json("payload", "k long")["k"])
    return parsed.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"))


@query("""SELECT event_id, user_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00'""")
def q33_polling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = cdc.polled(oe.table(spark, sf_dir, "events"), F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"), "ts")
    return rows.select("event_id", "user_id", "ts")


@query("""SELECT n.n_name AS nation, r.r_name AS region, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation n ON n_nationkey = c_nationkey JOIN region r ON r_regionkey = n_regionkey WHERE c_acctbal > 0 GROUP BY 1, 2""")
def q34_federated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The federated query's shape on local tables (the JDBC driver is absent here): filter pushed to the scan, small dimensions joined."""
    c = oe.table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_nationkey", "c_acctbal")
    n, r = oe.table(spark, sf_dir, "nation"), oe.table(spark, sf_dir, "region")
    per_nation = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return per_nation.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "customers", "balance")


@query("""SELECT event_id AS id, 'events' AS table_name, event_type AS operation, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id > 500""")
def change_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = oe.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("events").alias("table_name"), F.col("event_type").alias("operation"), F.col("user_id").cast("string").alias("row_id"), F.lit(None).cast("string").alias("before_json"), F.col("props").alias("after_json"), F.col("ts").alias("changed_at"))
    rows = cdc.from_change_log(log, 500, T.StructType([T.StructField("k", T.LongType())]))
    return rows.select(F.col("lsn").alias("id"), "table_name", "operation", F.col("after.k").alias("k"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN o_orderkey IS NULL THEN 'READ' ELSE 'UPDATE' END AS operation, coalesce(o_totalprice, c_acctbal) AS amount, 'crm' AS source_connector FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) ON o_custkey = c_custkey AND r = 1""")
def cdc_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the customers as READ rows below every change, then their orders as changes; the last one stands."""
    snapshot = oe.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("amount"))
    changes = oe.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("amount"), F.lit("UPDATE").alias("operation"), F.col("o_orderkey").cast("long").alias("lsn"))
    rows = cdc.tagged(cdc.renamed(cdc.bootstrap(snapshot, changes).withColumn("cust", F.col("cust").cast("string")), {"cust": "key"}), "source_connector", "crm")
    return cdc.latest_state(rows, ["key"], F.col("lsn")).select("key", "operation", "amount", "source_connector")


@query("""SELECT 'good' AS kind, NULL AS failure_reason, NULL AS failure_stage, count(*) AS n FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT 'dead', 'schema_mismatch', 'bronze_validation', count(*) FROM events WHERE event_id % 5 = 0""")
def cdc_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth record is broken off on purpose and must reach the dead letters."""
    raw = oe.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 == 0, F.lit('{"k": ')).otherwise(F.col("props")).alias("value"))
    good, dead = cdc.parsed(raw, T.StructType([T.StructField("k", T.LongType())]))
    none = F.lit(None).cast("string")
    kinds = good.select(F.lit("good").alias("kind"), none.alias("failure_reason"), none.alias("failure_stage")).unionByName(dead.select(F.lit("dead").alias("kind"), "failure_reason", "failure_stage"))
    return kinds.groupBy("kind", "failure_reason", "failure_stage").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LSN} SELECT CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'kept' END AS flag, count(*) AS n FROM ch WHERE lsn % 4 <> 1 AND lsn % 3 <> 2 GROUP BY 1""")
def cdc_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats and tombstones, made on purpose of some changes, don't reach Silver."""
    lsn = F.col("source.lsn")
    rows = _stock_changes(spark, sf_dir).withColumn("topic", F.when(lsn % 4 == 1, "__heartbeat.stock").otherwise("stock"))
    rows = rows.withColumn("before", F.when(lsn % 3 != 2, F.coalesce("before", "after"))).withColumn("after", F.when(lsn % 3 != 2, F.col("after")))
    flag = F.when(F.col("operation") == "DELETE", "R").otherwise("kept")
    return cdc.without_tombstones(cdc.without_heartbeats(rows)).groupBy(flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


# --- service levels ----------------------------------------------------------


@query("""WITH m AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-30 00:00:00', INTERVAL 1 MINUTE)) AS at), u AS (SELECT DISTINCT ts FROM events WHERE event_type = 'purchase'),
g AS (SELECT m.at, epoch(m.at)::BIGINT - floor(epoch(u.ts))::BIGINT <= 14400 AS good FROM m ASOF LEFT JOIN u ON u.ts <= m.at)
SELECT count(*) AS minutes, count(*) FILTER (WHERE NOT coalesce(good, false)) AS bad_minutes, round(avg(CASE WHEN coalesce(good, false) THEN 1.0 ELSE 0.0 END), 6) AS good_fraction FROM g""")
def slo_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of minutes whose newest purchase was at most four hours old."""
    updates = oe.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("ts").cast("timestamp").alias("updated_at"))
    rows = slo.minutes(updates, F.lit("2024-01-02 00:00:00").cast("timestamp"), F.lit("2024-01-30 00:00:00").cast("timestamp"), 14_400)
    return slo.compliance(rows).drop("budget_used")


@query("""WITH m AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-30 00:00:00', INTERVAL 1 MINUTE)) AS at), u AS (SELECT DISTINCT ts FROM events WHERE event_type = 'purchase'),
g AS (SELECT m.at, coalesce(epoch(m.at)::BIGINT - floor(epoch(u.ts))::BIGINT <= 3600, false) AS good FROM m ASOF LEFT JOIN u ON u.ts <= m.at),
t AS (SELECT * FROM (VALUES (1, 14.4::DOUBLE, 'page'), (6, 6.0::DOUBLE, 'ticket')) v(window_hours, allowed_rate, severity))
SELECT window_hours, allowed_rate, severity, round(count(*) FILTER (WHERE NOT good) / count(*)::DOUBLE / 0.001, 6) AS burn_rate, count(*) FILTER (WHERE NOT good) / count(*)::DOUBLE / 0.001 >= allowed_rate AS firing
FROM t JOIN g ON g."at" > TIMESTAMP '2024-01-30 00:00:00' - to_hours(window_hours) AND g."at" <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1, 2, 3""")
def slo_burn_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burn rates of the two alert tiers."""
    updates = oe.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("ts").cast("timestamp").alias("updated_at"))
    end = F.lit("2024-01-30 00:00:00").cast("timestamp")
    rows = slo.minutes(updates, F.lit("2024-01-02 00:00:00").cast("timestamp"), end, 3_600)
    return slo.burn_rates(rows, end)


@query(f"""WITH {s.EVENTS}, p AS (SELECT DISTINCT event_id FROM ev), st AS (SELECT DISTINCT event_id FROM judged WHERE failure_reason IS NULL) SELECT count(*) AS produced, count(st.event_id) AS stored, round(count(st.event_id) * 100.0 / count(*), 4) AS completeness_pct FROM p LEFT JOIN st USING (event_id)""")
def slo_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slo.completeness(oe.order_events(spark, sf_dir), oe.silver_orders(spark, sf_dir))


@query(f"""WITH {s.LETTERS}, t AS (SELECT count(*) FILTER (WHERE arrived_at > {s.NOW} - INTERVAL 1 HOUR AND arrived_at <= {s.NOW}) AS n FROM letters) SELECT n AS last_hour, n > 1 AS alert, n > 10 AS breach FROM t""")
def slo_dead_letter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slo.dead_letter_rate(oe.dead_letters(spark, sf_dir), oe.now())


@query("""SELECT count(*) AS samples, round(count(*) FILTER (WHERE value <= 30) * 100.0 / count(*), 4) AS availability_pct FROM events""")
def slo_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of lag samples (the events' values as seconds) within the limit."""
    return slo.availability(oe.table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("value").alias("lag_seconds")))


@query("""WITH d AS (SELECT CAST(event_type AS VARCHAR) AS stage, round(count(*) FILTER (WHERE value > 20) * 100.0 / count(*), 3) AS quality_pct FROM events GROUP BY 1) SELECT stage, quality_pct, round(quality_pct - lag(quality_pct) OVER (ORDER BY stage), 3) AS delta_pct FROM d""")
def quality_stage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's quality against the stage before it; event types are the stages here."""
    rows = oe.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(ratio_pct(F.count_if(F.col("value") > 20), F.count(F.lit(1)), 3).alias("quality_pct"))
    return quality.stage_deltas(rows)


@query("""SELECT event_id, sha256(CAST(event_id AS VARCHAR) || '|' || event_type || '|') AS stable FROM events""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oe.table(spark, sf_dir, "events").select("event_id", stable_id(F.col("event_id"), F.col("event_type"), F.lit(None)).alias("stable"))


# --- scalar and window functions ---------------------------------------------


@query("""SELECT event_type, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents, round(count(*) FILTER (WHERE value > 50) * 100.0 / count(*), 3) AS large_pct, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, min(substring(sha256(props), 1, 16)) AS least_hash, max(strftime(ts, '%Y-%m-%d')) AS last_day FROM events GROUP BY 1""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = oe.table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(cents(F.col("value"))).alias("cents"), ratio_pct(F.count_if(F.col("value") > 50), F.count(F.lit(1)), 3).alias("large_pct"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"), F.min(F.substring(F.sha2("props", 256), 1, 16)).alias("least_hash"), F.max(F.date_format("ts", "yyyy-MM-dd")).alias("last_day"))


@query(f"""SELECT CAST(ts AS DATE) AS day, event_type AS top_type, user_id AS top_user FROM ({_mode_cte('(SELECT CAST(ts AS DATE) AS ts, event_type FROM events)', 'ts', 'event_type')}) JOIN ({_mode_cte('(SELECT CAST(ts AS DATE) AS ts, CAST(user_id AS VARCHAR) AS user_id FROM events)', 'ts', 'user_id')}) USING (ts)""")
def deterministic_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = oe.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return modes(e, ["day"], ["event_type", "user_id"]).withColumnsRenamed({"event_type": "top_type", "user_id": "top_user"})


@query("""SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(oe.table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "ts", "value")


@query("""SELECT regexp_extract(m, '^(mean|stddev|p95|null_rate|distinct_count)_(.*)$', 1) AS stat, regexp_extract(m, '^(mean|stddev|p95|null_rate|distinct_count)_(.*)$', 2) AS col FROM (VALUES ('mean_total_amount_cents'), ('null_rate_order_id'), ('p95_item_count')) v(m)""")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("mean_total_amount_cents",), ("null_rate_order_id",), ("p95_item_count",)], "m string")
    stat, column = metric_parts(F.col("m"))
    return names.select(stat.alias("stat"), column.alias("col"))


# --- streams -----------------------------------------------------------------


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a stream over the table's files, read to the end."""
    from ..sources.scratch import scratch_path

    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = windows.tumbling(stream, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")])
    out = scratch_path(spark, "tumbling")
    run = grouped.writeStream.outputMode("complete").option("checkpointLocation", scratch_path(spark, "tumbling_state")).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).drop("window_end")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM g GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oe.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(rows, "ts", "1 day", ["user_id"]).select("user_id", "session_start", "events")


@query("""SELECT a.event_id AS click_id, b.event_id AS purchase_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def time_bounded_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = oe.table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("buy_ts"), F.col("event_id").alias("purchase_id"))
    return windows.time_bounded_join(clicks, buys, "user_id", "click_ts", "buy_ts", "6 HOURS").select("click_id", "purchase_id", F.col("a.user_id").alias("user_id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["q01_gold_daily_summary"](spark, sf_dir)
