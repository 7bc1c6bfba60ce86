"""Windowed side branches of a stream: quality by tumbling window, rates, stream-stream joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import quality
from ..sources.snapshots import SnapshotTable


def quality_branch(stream: DataFrame, rules: list[quality.Rule], stage: str, results: SnapshotTable, checkpoint: str, now: Column | None = None, time: str = "occurred_at", window: str = "minute", available_now: bool = False) -> StreamingQuery:
    """Scores each micro-batch by window in a query of its own: it never gates the main stream."""
    name = f"quality_{stage}"

    def score(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            results.commit(quality.profile(batch, rules, stage, now if now is not None else F.current_timestamp(), time, window), transaction=(name, batch_id))

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(score)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")).start()


def tumbling(stream: DataFrame, time: str, length: str, keys: list[str], aggregates: list[Column], watermark: str = "5 minutes") -> DataFrame:
    """Aggregates (aliased) by event-time window and keys; late rows beyond the watermark don't reopen a window."""
    rows = stream.withWatermark(time, watermark) if stream.isStreaming else stream
    grouped = rows.groupBy(F.window(time, length).alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in grouped.columns if c != "w"))


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str]) -> DataFrame:
    """Rows of a key closer than ``gap`` are one session."""
    rows = stream.withWatermark(time, gap) if stream.isStreaming else stream
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "events")


def time_bounded_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str) -> DataFrame:
    """Rows of both sides with equal keys whose right time follows the left by at most ``within``; state is bounded by the watermarks."""
    a = left.withWatermark(left_time, within) if left.isStreaming else left
    b = right.withWatermark(right_time, within) if right.isStreaming else right
    bound = (F.col(f"b.{right_time}") >= F.col(f"a.{left_time}")) & (F.col(f"b.{right_time}") <= F.col(f"a.{left_time}") + F.expr(f"INTERVAL {within}"))
    equal = F.col(f"a.{key}") == F.col(f"b.{key}")
    if a.isStreaming or b.isStreaming:
        return a.alias("a").join(b.alias("b"), equal & bound)
    # in batch, buckets as wide as the bound join the key, so a hot key's rows meet only those near in time
    a = a.withColumn("_bucket", _bucket(a, left_time, within))
    own = _bucket(b, right_time, within)
    b = b.withColumn("_bucket", F.explode(F.array(own, own - 1)))
    joined = a.alias("a").join(b.alias("b"), equal & (F.col("a._bucket") == F.col("b._bucket")) & bound)
    return joined.drop(F.col("a._bucket"), F.col("b._bucket"))


def _bucket(df: DataFrame, time: str, within: str) -> Column:
    """The number of the stretch of length ``within`` that a time falls in, on one scale without clock changes."""
    kind = "TIMESTAMP_NTZ" if dict(df.dtypes)[time] == "timestamp_ntz" else "TIMESTAMP"
    zone = "" if kind == "TIMESTAMP_NTZ" else "Z"
    zero = f"{kind}'1970-01-01 00:00:00{zone}'"

    def micros(interval: str) -> Column:
        # intervals of days and smaller parts have one length
        return F.expr(f"CAST(extract(DAY FROM ({interval})) AS BIGINT) * 86400000000 + CAST(extract(HOUR FROM ({interval})) AS BIGINT) * 3600000000 + CAST(extract(MINUTE FROM ({interval})) AS BIGINT) * 60000000 + CAST(extract(SECOND FROM ({interval})) * 1000000 AS BIGINT)")

    return F.floor(micros(f"`{time}` - {zero}") / micros(f"({zero} + INTERVAL {within}) - {zero}"))


def observed(stream: DataFrame, name: str = "silver") -> DataFrame:
    """Counts processed, dead-lettered and duplicate rows of each batch for a listener."""
    return stream.observe(name, F.count(F.lit(1)).alias("processed"), F.count("failure_reason").alias("dlq_routed"), F.count_if(F.col("failure_reason") == "duplicate_event_id").alias("dedup_dropped"))
