"""Change data: envelopes, latest state, outbox routing, change logs, polling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import latest_by

OPERATIONS = ("INSERT", "UPDATE", "DELETE", "READ")

STOCK = T.StructType([T.StructField("quantity_on_hand", T.IntegerType()), T.StructField("quantity_reserved", T.IntegerType()), T.StructField("warehouse_id", T.StringType()), T.StructField("updated_at", T.TimestampType())])
SOURCE = T.StructType([T.StructField("db", T.StringType()), T.StructField("schema", T.StringType()), T.StructField("table", T.StringType()), T.StructField("lsn", T.LongType()), T.StructField("txn_id", T.LongType()), T.StructField("connector", T.StringType())])
INVENTORY_UPDATED = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("occurred_at", T.TimestampType()),
    T.StructField("sku", T.StringType()),
    T.StructField("before", STOCK),
    T.StructField("after", STOCK),
    T.StructField("source", SOURCE),
])
OUTBOX = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("aggregate_type", T.StringType()),
    T.StructField("aggregate_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("metadata", T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("source_service", T.StringType())])),
])
CHANGE_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("row_id", T.StringType()),
    T.StructField("before_json", T.StringType()),
    T.StructField("after_json", T.StringType()),
    T.StructField("changed_at", T.TimestampType()),
])


def unwrap(envelopes: DataFrame, keep: tuple[str, ...] = ("event_id", "operation", "occurred_at", "sku")) -> DataFrame:
    """The row an envelope is about: after, or before for deletes; tombstones (neither) stay as nulls."""
    image = envelopes.schema["after"].dataType
    fields = [F.coalesce(F.col(f"after.{f.name}"), F.when(F.col("operation") == "DELETE", F.col(f"before.{f.name}"))).alias(f.name) for f in image]
    lsn = [F.col("source.lsn").alias("lsn")] if "source" in envelopes.columns else []
    return envelopes.select(*keep, *fields, *lsn)


def renamed(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Rename transform: source path (may be nested) to field."""
    return df.select("*", *(F.col(old).alias(new) for old, new in renames.items()))


def tagged(df: DataFrame, name: str, value: str) -> DataFrame:
    """Static field transform."""
    return df.withColumn(name, F.lit(value))


def without_tombstones(df: DataFrame) -> DataFrame:
    """Bronze keeps null payloads; Silver drops them."""
    return df.where(F.col("before").isNotNull() | F.col("after").isNotNull())


def without_heartbeats(df: DataFrame, topic: str = "topic") -> DataFrame:
    return df.where(~F.col(topic).startswith("__heartbeat"))


def invalid_envelope(operation: Column, before: Column, after: Column) -> Column:
    """What is wrong with an envelope, or null."""
    return (
        F.when(operation.isNull() | ~operation.isin(*OPERATIONS), "unknown_operation")
        .when(operation.isin("INSERT", "READ") & (before.isNotNull() | after.isNull()), "unexpected_image")
        .when((operation == "DELETE") & after.isNotNull(), "unexpected_image")
        .when((operation == "UPDATE") & after.isNull(), "missing_image")
    )


def latest_state(changes: DataFrame, keys: list[str], *order: Column, deleted: Column | None = None) -> DataFrame:
    """Each key's last change by ``order`` unless it is a delete."""
    gone = deleted if deleted is not None else F.col("operation") == "DELETE"
    return latest_by(changes, keys, *order).where(~gone)


def bootstrap(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """Snapshot rows as READ changes at the lowest position, then the stream's changes."""
    first = snapshot.withColumn("operation", F.lit("READ")).withColumn("lsn", F.lit(0).cast("long"))
    return first.unionByName(changes, allowMissingColumns=True)


def parsed(raw: DataFrame, schema: T.StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON records as (good rows, dead letters of stage bronze_validation)."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = raw.withColumn("_r", F.from_json(F.col(column).cast("string"), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull()
    good = rows.where(~bad).select(*(F.col(f"_r.{f.name}").alias(f.name) for f in schema))
    dead = rows.where(bad).select(F.lit("schema_mismatch").alias("failure_reason"), F.lit("bronze_validation").alias("failure_stage"), F.col(column).cast("binary").alias("raw_payload"))
    return good, dead


def routed(outbox: DataFrame, payloads: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Outbox rows by event_type, with the payload parsed by its type's schema; other types are under ''."""
    out = {t: outbox.where(F.col("event_type") == t).withColumn("payload", F.from_json("payload", s)) for t, s in payloads.items()}
    out[""] = outbox.where(~F.col("event_type").isin(*payloads) | F.col("event_type").isNull()) if payloads else outbox
    return out


def topic_of(outbox: DataFrame, prefix: str = "outbox") -> DataFrame:
    """The topic each outbox row is routed to, by its aggregate_type."""
    return outbox.withColumn("topic", F.concat(F.lit(prefix + "."), F.lower("aggregate_type")))


def polled(table: DataFrame, last_seen: Column | None, column: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(rows after the stored high-water mark in its order, the new mark as one row); the predicate reaches the scan."""
    rows = table if last_seen is None else table.where(F.col(column) > last_seen)
    return rows.orderBy(F.col(column).asc_nulls_first()), rows.agg(F.max(column).alias("high_water_mark"))


def from_change_log(log: DataFrame, after_id: int, image: T.StructType) -> DataFrame:
    """Change-log rows beyond an id as envelopes."""
    rows = log.where(F.col("id") > after_id)
    return rows.select(F.col("id").alias("lsn"), "table_name", "operation", "row_id", F.from_json("before_json", image).alias("before"), F.from_json("after_json", image).alias("after"), "changed_at")


def federated(spark, url: str, query: str, properties: dict[str, str]) -> DataFrame:
    """A query pushed to an external database over JDBC (needs its driver on the class path)."""
    return spark.read.format("jdbc").options(url=url, query=query, **properties).load()


def assembled(orders: DataFrame, items: DataFrame) -> DataFrame:
    """order_placed rows from row-level changes of two tables: orders with their items as an array."""
    lines = items.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("sku", "quantity", "unit_price_cents"))).alias("items"))
    return orders.join(lines, "order_id", "left")
