"""Gold: daily order summaries, built whole or by touched days, and what analysts read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import modes, rounded
from ..sources.snapshots import SnapshotTable

#: The public contract of the daily summary, in order.
DAILY_SUMMARY = T.StructType([
    T.StructField("order_date", T.DateType()),
    T.StructField("currency", T.StringType()),
    T.StructField("order_count", T.LongType()),
    T.StructField("total_revenue_cents", T.LongType()),
    T.StructField("avg_order_cents", T.DoubleType()),
    T.StructField("p50_order_cents", T.LongType()),
    T.StructField("p95_order_cents", T.LongType()),
    T.StructField("item_count", T.LongType()),
    T.StructField("unique_customers", T.LongType()),
    T.StructField("updated_at", T.TimestampType()),
])

#: Declared by the contract; nothing produces it.
SAGA_HEALTH = T.StructType([
    T.StructField("event_hour", T.TimestampType()),
    T.StructField("orders_placed", T.LongType()),
    T.StructField("saga_compensations", T.LongType()),
    T.StructField("compensation_rate_pct", T.DoubleType()),
    T.StructField("saga_p99_duration_ms", T.LongType()),
])

KEYS = ("order_date", "currency")


def daily_summary(silver: DataFrame, updated_at: Column) -> DataFrame:
    """One row a UTC day and currency over valid Silver rows; percentiles are exact and interpolated.

    order_id is unique in Silver by event deduplication only, so orders are counted distinctly; both distinct
    counts and the sums share one shuffle by (day, currency, value).
    """
    valid = silver.where("_is_valid").withColumn("order_date", F.to_date(F.date_trunc("day", "occurred_at")))
    return (
        valid.groupBy(*KEYS)
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            F.sum("total_amount_cents").alias("total_revenue_cents"),
            F.avg("total_amount_cents").alias("avg_order_cents"),
            F.percentile("total_amount_cents", 0.5).alias("p50_order_cents"),
            F.percentile("total_amount_cents", 0.95).alias("p95_order_cents"),
            F.sum("item_count").cast("long").alias("item_count"),
            F.count_distinct("customer_id").alias("unique_customers"),
        )
        .withColumn("updated_at", updated_at)
    )


def contract_view(summary: DataFrame) -> DataFrame:
    """The summary in the contract's types: percentiles as whole cents."""
    return summary.select(*(F.round(f.name).cast("long").alias(f.name) if f.name.startswith(("p50", "p95")) else F.col(f.name).cast(f.dataType).alias(f.name) for f in DAILY_SUMMARY))


def variant_summary(orders: DataFrame) -> DataFrame:
    """The documented day-level variant: cancelled orders and the 99th percentile."""
    return orders.groupBy(F.to_date("occurred_at").alias("order_date")).agg(
        F.sum("total_amount_cents").alias("total_revenue_cents"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("status") == "CANCELLED").alias("cancelled_orders"),
        F.percentile("total_amount_cents", 0.99).alias("p99_order_value_cents"),
    )


def touched_days(changed: DataFrame) -> DataFrame:
    return changed.select(F.to_date("occurred_at").alias("order_date")).distinct()


def refresh(gold: SnapshotTable, silver: DataFrame, changed: DataFrame, updated_at: Column) -> None:
    """Recomputes every day that ``changed`` rows fall on, whole, and swaps those days in one commit.

    Distinct counts and percentiles don't merge, so a touched day is rebuilt from all its Silver rows.  Gold has
    a row a day and currency, so the commit rewrites it whole, in few files; a commit of another writer in
    between raises CommitConflict.  Running it twice changes nothing.
    """
    days = touched_days(changed)
    of_days = silver.join(days, F.to_date("occurred_at") == F.col("order_date"), "left_semi")
    fresh = contract_view(daily_summary(of_days, updated_at))
    if not gold.exists():
        gold.commit(fresh.hint("rebalance"))
        return
    base = gold.current().number
    kept = gold.read(number=base).join(days, "order_date", "left_anti").select(*fresh.columns)
    gold.commit(kept.unionByName(fresh).hint("rebalance"), mode="replace", base=base)


def recent_revenue(summary: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return summary.where(F.col("order_date") >= F.date_sub(F.to_date(as_of), days)).select(
        "order_date", "currency", "order_count", F.round(F.col("total_revenue_cents") / 100.0, 2).alias("revenue_usd"), rounded(F.col("avg_order_cents") / 100.0, 2).alias("avg_order_usd")
    ).orderBy(F.desc("order_date"), F.desc("revenue_usd"), "currency")


def revenue_by_day(summary: DataFrame) -> DataFrame:
    return summary.groupBy("order_date").agg(F.round(F.sum("total_revenue_cents").cast("double") / 100.0, 2).alias("revenue_usd")).orderBy(F.desc("order_date"))


def freshness(summary: DataFrame, as_of: Column, limit_minutes: int = 5) -> DataFrame:
    """The latest write, its age in seconds, and whether it breaks the limit."""
    latest = summary.agg(F.max("updated_at").alias("latest_write"))
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("latest_write").cast("timestamp"))
    return latest.select("latest_write", seconds.alias("data_age_seconds"), F.when(seconds > 60 * limit_minutes, "SLA_BREACH").otherwise("OK").alias("freshness_status"))


def dead_letters_by_hour(letters: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Per hour: dead letters, late ones, and the commonest stage and reason (ties: the least)."""
    recent = letters.where((F.col("arrived_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("arrived_at") < as_of)).withColumn("hour", F.date_trunc("hour", "arrived_at"))
    counts = recent.groupBy("hour").agg(F.count(F.lit(1)).alias("dlq_count"), F.count_if("late_arrival").alias("late_arrivals"))
    top = modes(recent, ["hour"], ["failure_stage", "failure_reason"])
    return counts.join(top, "hour").select("hour", "dlq_count", "late_arrivals", F.col("failure_stage").alias("dominant_failure_stage"), F.col("failure_reason").alias("dominant_failure_reason")).orderBy(F.desc("hour"))


def dead_letter_audit(letters: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    recent = letters.where((F.col("arrived_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("arrived_at") < as_of))
    return recent.groupBy(F.date_trunc("hour", "arrived_at").alias("hour"), "failure_stage", "failure_reason").agg(F.count(F.lit(1)).alias("event_count")).orderBy(F.desc("hour"), F.desc("event_count"), "failure_stage", "failure_reason")
