"""Bronze to Silver as a stream: late, duplicate and invalid events go to dead letters, nothing is dropped.

One stateful operator keyed by event_id.  It runs in processing-time mode,
because event-time mode would drop late rows before they are seen, and asks the
timer for the watermark itself.  What an event breaks is a column computed
before the operator (the batch expression), so the state holds one timestamp a
key.  A key is forgotten ``ttl`` after it was marked, in event time (for replays
at full speed) and by the state store's own processing-time expiry.

Each micro-batch commits Bronze, Silver and dead letters under one transaction
name and the batch's number, so a repeated batch changes nothing.  The query's
progress carries the batch's counts (processed, dlq_routed, dedup_dropped) under
the query's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import silver
from ..sources.snapshots import SnapshotTable
from .windows import observed

WATERMARK_MINUTES, TTL_HOURS, TRIGGER_SECONDS = 5, 24, 60


class Deduplicate(StatefulProcessor):
    """Adds failure_reason, failure_stage and late_arrival to the rows of a key, in event-time order of each batch."""

    def __init__(self, columns: list[str], ttl_hours: int = TTL_HOURS):
        self.columns, self.ttl_ms = columns, ttl_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("at_ms", T.LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for row in sorted(rows, key=lambda r: (r["_at_ms"], r["_offset"])):
            at, own = row["_at_ms"], row["_own"]
            marked = self.seen.get()
            known = marked is not None and at - marked[0] < self.ttl_ms
            late = at < watermark
            if late:
                verdict = ("late_arrival", "silver_watermark")
            elif known:
                verdict = ("duplicate_event_id", "silver_dedup")
            elif own is not None:
                verdict = (own, "silver_validation")
            else:
                self.seen.update((at,))
                verdict = (None, None)
            yield Row(**{c: row[c] for c in self.columns}, failure_reason=verdict[0], failure_stage=verdict[1], late_arrival=late)

    def close(self) -> None:
        pass


def classified(events: DataFrame, key: str = "event_id", watermark_minutes: int = WATERMARK_MINUTES, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """A stream of order_placed events (occurred_at TIMESTAMP) with their verdicts."""
    columns = events.columns
    marked = (
        events.withWatermark("occurred_at", f"{watermark_minutes} minutes")
        .withColumn("_own", silver.failure_reason(F.col("items"), F.col("total_amount_cents")))
        .withColumn("_at_ms", F.unix_millis("occurred_at"))
        .withColumn("_offset", F.col("offset") if "offset" in columns else F.lit(0).cast("long"))
    )
    out = T.StructType([*events.schema.fields, T.StructField("failure_reason", T.StringType()), T.StructField("failure_stage", T.StringType()), T.StructField("late_arrival", T.BooleanType())])
    return marked.groupBy(key).transformWithState(statefulProcessor=Deduplicate(columns, ttl_hours), outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


def start(events: DataFrame, bronze: SnapshotTable, silver_table: SnapshotTable, letters: SnapshotTable, checkpoint: str, name: str = "silver", available_now: bool = False, watermark_minutes: int = WATERMARK_MINUTES, ttl_hours: int = TTL_HOURS) -> StreamingQuery:
    """Starts the stream; with ``available_now`` it ends when all input is read.

    Needs spark.sql.streaming.stateStore.providerClass set to the RocksDB provider, and for ``available_now``
    spark.sql.streaming.noDataMicroBatches.enabled=false (``configured`` sets both).
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        ingested = F.lit(datetime.now(UTC)).cast("timestamp")
        rows = batch.persist()
        try:
            bronze.commit(rows.drop("failure_reason", "failure_stage", "late_arrival").withColumn("ingest_date", F.to_date(ingested)), partition_by=["ingest_date"], transaction=(name, batch_id))
            silver_table.commit(silver.to_silver(rows, ingested), transaction=(name, batch_id))
            letters.commit(silver.to_dead_letters(rows, ingested, late=F.col("late_arrival")), transaction=(name, batch_id))
        finally:
            rows.unpersist()

    verdicts = observed(classified(events, watermark_minutes=watermark_minutes, ttl_hours=ttl_hours), name)
    writer = verdicts.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(commit)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{TRIGGER_SECONDS} seconds")).start()


def configured(spark) -> None:
    """Session settings the stream needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def kafka(spark, servers: str, topic: str = silver.TOPIC, starting: str = "earliest", most_per_trigger: int | None = None) -> DataFrame:
    """The topic as a stream of committed records (needs the Kafka connector on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("kafka.isolation.level", "read_committed")
    return (reader.option("maxOffsetsPerTrigger", most_per_trigger) if most_per_trigger else reader).load()


def files(spark, path: str, schema: T.StructType = silver.ORDER_PLACED, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a topic: each new file is records in order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def reprocess(events: DataFrame, new_silver: SnapshotTable, letters: SnapshotTable, bronze: SnapshotTable, checkpoint: str, validate, name: str) -> bool:
    """Replay into a new table version with its own checkpoint; true if ``validate`` accepts it (then swap the catalog's pointer)."""
    start(events, bronze, new_silver, letters, checkpoint, name=name, available_now=True).awaitTermination()
    return bool(validate(new_silver.read()))
