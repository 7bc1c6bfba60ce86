"""The order-event tables that the registered queries read, derived from the TPC-H-like tables.

An order becomes an order_placed event; some are made defective or repeated by
rules on their key, so that every branch of the pipeline has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, silver
from ..operators.gold import daily_summary

#: "Now" of every registered query: the day after the last order.
AS_OF = "2001-08-02 00:00:00"
UPDATED_AT = "2001-08-01 23:57:00"
CURRENCIES = ("USD", "EUR", "GBP", "CAD", "AUD", "JPY", "INR")


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_placed events with ``seq`` (1 for a repeat); the items are gathered by order in one shuffle."""
    unit = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).cast("long")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_partkey").cast("string").alias("sku"), F.col("l_quantity").cast("int").alias("quantity"), unit.alias("unit_price_cents")).alias("item"))
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("item")).alias("items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    k = F.col("o_orderkey")
    total = silver.items_total(F.col("items"))
    amount = F.when(k % 101 == 0, F.lit(-1).cast("long")).when(k % 97 == 0, total + 1).otherwise(total)
    currency = F.when(k % 50 == 49, "XXX").otherwise(F.element_at(F.array(*(F.lit(c) for c in CURRENCIES)), (k % 7 + 1).cast("int")))
    joined = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    events = joined.select(
        k.cast("string").alias("event_id"),
        k.cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").alias("occurred_at"),
        "items",
        amount.alias("total_amount_cents"),
        currency.alias("currency"),
        F.struct(F.concat(F.lit("trace-"), k.cast("string")).alias("trace_id"), F.lit("orders-service").alias("source_svc")).alias("metadata"),
        F.when(F.col("o_orderstatus") == "F", "CANCELLED").otherwise("PLACED").alias("status"),
        F.when(k % 53 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("seqs"),
    )
    return events.select("*", F.explode("seqs").alias("seq")).drop("seqs")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.judged(order_events(spark, sf_dir))


def silver_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.to_silver(judged(spark, sf_dir), F.lit(UPDATED_AT).cast("timestamp_ntz"))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected events; they arrive when they occurred, ``event key mod 24`` hours into the day."""
    hour = F.make_interval(hours=F.pmod(F.col("event_id").cast("long"), F.lit(24)).cast("int"))
    return silver.to_dead_letters(judged(spark, sf_dir), F.col("occurred_at") + hour, late=F.col("event_id").cast("long") % 10 == 0)


def gold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_summary(silver_orders(spark, sf_dir), F.lit(UPDATED_AT).cast("timestamp_ntz"))


def quality_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the Silver rules score: all events that carry items, good or not, in Silver's columns."""
    events = order_events(spark, sf_dir)
    return events.select("event_id", "order_id", "customer_id", "occurred_at", "currency", "total_amount_cents", "items", F.coalesce(F.size("items"), F.lit(0)).alias("item_count"))


def quality_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver's rules by day of the order."""
    return quality.profile(quality_input(spark, sf_dir), quality.ORDER_RULES["silver_validation"], "silver_validation", now(), "occurred_at")


def silver_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import monitor

    rows = monitor.profile(table(spark, sf_dir, "events"), "events", "ts", ["value", "user_id"], approximate_distinct=False)
    return monitor.scored(rows, F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")))
