"""Bronze to Silver: validation, deduplication, dead letters.

The same column expressions serve batch and stream, so a replay runs the same
code.  A row's reason is the first rule it breaks; only valid rows mark an
event_id as seen, so an invalid row never blocks a later valid one, and a
repeat of an invalid row reports its own reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPIC = "orders.placed"

#: The stages a dead letter can come from.
STAGES = ("bronze_validation", "silver_validation", "silver_dedup", "silver_watermark", "silver_enrichment")

ITEM = T.StructType([T.StructField("sku", T.StringType()), T.StructField("quantity", T.IntegerType()), T.StructField("unit_price_cents", T.LongType())])
ADDRESS = T.StructType([T.StructField(n, T.StringType()) for n in ("line1", "line2", "city", "post_code", "country_code")])
METADATA = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("source_svc", T.StringType())])
ORDER_PLACED = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("occurred_at", T.TimestampType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("total_amount_cents", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("shipping_address", ADDRESS),
    T.StructField("metadata", METADATA),
])

DEAD_LETTER = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("original_topic", T.StringType()),
    T.StructField("original_offset", T.LongType()),
    T.StructField("failure_reason", T.StringType()),
    T.StructField("failure_stage", T.StringType()),
    T.StructField("late_arrival", T.BooleanType()),
    T.StructField("raw_payload", T.BinaryType()),
    T.StructField("arrived_at", T.TimestampType()),
])


def items_total(items: Column) -> Column:
    """The sum of quantity times unit price, widened before it is multiplied; missing fields count 0."""
    return F.aggregate(
        F.coalesce(items, F.array().cast(T.ArrayType(ITEM))),
        F.lit(0).cast("long"),
        lambda total, i: total + F.coalesce(i["quantity"].cast("long"), F.lit(0)) * F.coalesce(i["unit_price_cents"], F.lit(0)),
    )


def failure_reason(items: Column, total: Column) -> Column:
    """The first rule an order breaks, or null."""
    return (
        F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "empty_items_array")
        .when(F.coalesce(total, F.lit(0)) <= 0, "non_positive_total")
        .when(total != items_total(items), "total_mismatch")
    )


def judged(events: DataFrame, key: str = "event_id", order: str = "seq") -> DataFrame:
    """``events`` with failure_reason and failure_stage (null for Silver rows), deduplicated by ``key`` in ``order``."""
    with_reason = events.withColumn("_own", failure_reason(F.col("items"), F.col("total_amount_cents")))
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("_own").isNull()).over(earlier), F.lit(False))
    return (
        with_reason.withColumn("_seen", seen)
        .withColumn("failure_reason", F.when(F.col("_seen"), "duplicate_event_id").otherwise(F.col("_own")))
        .withColumn("failure_stage", F.when(F.col("_seen"), "silver_dedup").when(F.col("_own").isNotNull(), "silver_validation"))
        .drop("_seen", "_own")
    )


def to_silver(rows: DataFrame, ingested_at: Column) -> DataFrame:
    """Valid rows in Silver's columns."""
    return rows.where(F.col("failure_reason").isNull()).select(
        "event_id",
        "order_id",
        "customer_id",
        "occurred_at",
        "currency",
        "total_amount_cents",
        F.size("items").alias("item_count"),
        F.to_json("items").alias("items_json"),
        F.col("metadata.trace_id").alias("trace_id"),
        ingested_at.alias("_ingested_at"),
        F.lit(True).alias("_is_valid"),
    )


def to_dead_letters(rows: DataFrame, arrived_at: Column, topic: str = TOPIC, late: Column | None = None, offset: Column | None = None, raw: Column | None = None) -> DataFrame:
    """Rejected rows in the contract's dead-letter columns, with the event_id."""
    payload = raw if raw is not None else F.encode(F.to_json(F.struct("event_id", "order_id", "total_amount_cents")), "UTF-8")
    return rows.where(F.col("failure_reason").isNotNull()).select(
        "event_id",
        F.lit(topic).alias("original_topic"),
        (offset if offset is not None else F.lit(None)).cast("long").alias("original_offset"),
        "failure_reason",
        "failure_stage",
        (late if late is not None else F.lit(False)).alias("late_arrival"),
        payload.alias("raw_payload"),
        arrived_at.alias("arrived_at"),
    )
