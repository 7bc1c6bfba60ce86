"""Column lineage: events of runs, the edges they declare, and questions to the graph."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_path
from ..functions.scalars import modes, ratio_pct

EVENTS = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("job_namespace", T.StringType()),
    T.StructField("job_name", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("input_datasets", T.StringType()),
    T.StructField("output_datasets", T.StringType()),
    T.StructField("column_lineage_json", T.StringType()),
    T.StructField("row_count_input", T.LongType()),
    T.StructField("row_count_output", T.LongType()),
    T.StructField("error_message", T.StringType()),
])

EDGES = "array<struct<output_column:string,input_fields:array<struct<dataset:string,field:string,transform:string>>>>"

# Which input field gives each column, and how (output column, dataset, field, transform).
BRONZE_TO_SILVER = (
    ("event_id", "topic://orders.placed", "event_id", "direct_copy"),
    ("order_id", "topic://orders.placed", "order_id", "direct_copy"),
    ("customer_id", "topic://orders.placed", "customer_id", "direct_copy"),
    ("occurred_at", "topic://orders.placed", "occurred_at", "direct_copy"),
    ("currency", "topic://orders.placed", "currency", "direct_copy"),
    ("total_amount_cents", "topic://orders.placed", "total_amount_cents", "direct_copy"),
    ("item_count", "topic://orders.placed", "items", "expression:size(items)"),
    ("items_json", "topic://orders.placed", "items", "expression:to_json(items)"),
    ("trace_id", "topic://orders.placed", "metadata.trace_id", "direct_copy"),
    ("_ingested_at", "system", "processing_timestamp", "expression:current_timestamp()"),
)
SILVER_TO_GOLD = (
    ("order_date", "silver.orders", "occurred_at", "expression:to_date(occurred_at)"),
    ("currency", "silver.orders", "currency", "direct_copy"),
    ("order_count", "silver.orders", "order_id", "aggregate_count_distinct"),
    ("total_revenue_cents", "silver.orders", "total_amount_cents", "aggregate_sum"),
    ("avg_order_cents", "silver.orders", "total_amount_cents", "aggregate_avg"),
    ("p50_order_cents", "silver.orders", "total_amount_cents", "aggregate_percentile"),
    ("p95_order_cents", "silver.orders", "total_amount_cents", "aggregate_percentile"),
    ("item_count", "silver.orders", "item_count", "aggregate_sum"),
    ("unique_customers", "silver.orders", "customer_id", "aggregate_count_distinct"),
    ("updated_at", "system", "run_timestamp", "expression:current_timestamp()"),
)

Edge = tuple[str, str, str, str]


def lineage_json(edges: tuple[Edge, ...]) -> str:
    """Edges as JSON: one object an output column, with all its input fields."""
    by_column: dict[str, list[dict[str, str]]] = {}
    for column, dataset, name, transform in edges:
        by_column.setdefault(column, []).append({"dataset": dataset, "field": name, "transform": transform})
    return json.dumps([{"output_column": c, "input_fields": f} for c, f in by_column.items()])


class Emitter:
    """Appends run events through ``sink`` (a function of one DataFrame), and to ``post`` if given, whose failure is ignored."""

    def __init__(self, spark: SparkSession, sink: Callable[[DataFrame], object], namespace: str, job: str, edges: tuple[Edge, ...], post: Callable[[dict], object] | None = None):
        self.spark, self.sink, self.namespace, self.job, self.edges, self.post = spark, sink, namespace, job, edges, post

    def emit(self, kind: str, run_id: str, at: datetime | None = None, inputs: tuple[str, ...] = (), outputs: tuple[str, ...] = (), read: int | None = None, written: int | None = None, error: str | None = None) -> None:
        if kind not in ("START", "COMPLETE", "FAIL"):
            raise ValueError(f"unknown event type {kind!r}")
        at = at or datetime.now(UTC)
        row = {"event_id": f"{run_id}:{kind}", "event_time": at, "event_type": kind, "job_namespace": self.namespace, "job_name": self.job, "run_id": run_id, "input_datasets": json.dumps(list(inputs)), "output_datasets": json.dumps(list(outputs)), "column_lineage_json": lineage_json(self.edges) if kind == "COMPLETE" else "[]", "row_count_input": read, "row_count_output": written, "error_message": error}
        self.sink(self.spark.createDataFrame([tuple(row[f.name] for f in EVENTS)], EVENTS))
        if self.post is not None:
            try:
                self.post(row)
            except Exception:  # noqa: BLE001  telemetry must not fail the run
                pass

    @contextmanager
    def run(self, run_id: str) -> Iterator[dict[str, int]]:
        """START now; COMPLETE with the counts put into the yielded dict, or FAIL with the error."""
        counts: dict[str, int] = {}
        self.emit("START", run_id)
        try:
            yield counts
        except Exception as e:
            self.emit("FAIL", run_id, error=str(e))
            raise
        self.emit("COMPLETE", run_id, read=counts.get("read"), written=counts.get("written"))


def edges(events: DataFrame) -> DataFrame:
    """One row an edge of completed runs."""
    done = events.where(F.col("event_type") == "COMPLETE")
    columns = done.select("job_name", "run_id", "event_time", F.explode(F.from_json("column_lineage_json", EDGES)).alias("e"))
    fields = columns.select("job_name", "run_id", "event_time", F.col("e.output_column").alias("output_column"), F.explode("e.input_fields").alias("f"))
    return fields.select("job_name", "run_id", "event_time", "output_column", F.col("f.dataset").alias("source_dataset"), F.col("f.field").alias("source_field"), F.col("f.transform").alias("transform_type"))


def edge_list(events: DataFrame) -> DataFrame:
    return edges(events).select("source_dataset", "source_field", "transform_type", "output_column", F.col("job_name").alias("produced_by")).distinct()


def forward_impact(events: DataFrame, field: str) -> DataFrame:
    return edges(events).where(F.col("source_field") == field).select("source_field", "output_column", "transform_type", "job_name").distinct()


def backward_trace(events: DataFrame, column: str) -> DataFrame:
    return edges(events).where(F.col("output_column") == column).select("output_column", "source_dataset", "source_field", "transform_type", F.col("job_name").alias("transformation_step")).distinct()


def reachable(events: DataFrame, field: str) -> DataFrame:
    """Every column that a field reaches over any number of jobs, with the fewest hops.

    Each step is written, so the plan stays as small as the graph is deep; a cycle ends when nothing new is found.
    """
    spark = events.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pairs = kept(edges(events).select("source_field", "output_column").distinct(), "lineage_pairs")
    front = kept(pairs.where(F.col("source_field") == field).select(F.col("output_column").alias("column"), F.lit(1).alias("hops")).distinct(), "lineage_front")
    found, hop = front, 1
    while not front.isEmpty():
        hop += 1
        onward = front.join(pairs, front.column == pairs.source_field).select(F.col("output_column").alias("column")).distinct()
        front = kept(onward.join(found, "column", "left_anti").select("column", F.lit(hop).alias("hops")), "lineage_front")
        found = kept(found.unionByName(front), "lineage_found")
    return found


def run_history(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    recent = events.where((F.col("event_time") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("event_time") <= as_of))

    def when(kind: str) -> Column:
        return F.when(F.col("event_type") == kind, F.col("event_time"))

    return recent.groupBy("job_name", "run_id").agg(
        F.min(when("START")).alias("started_at"),
        F.max(when("COMPLETE")).alias("completed_at"),
        F.max(when("FAIL")).alias("failed_at"),
        F.bool_or(F.col("event_type") == "COMPLETE").alias("succeeded"),
        F.max("row_count_input").alias("rows_read"),
        F.max("row_count_output").alias("rows_written"),
        ratio_pct(F.max("row_count_output"), F.max("row_count_input"), 3).alias("pass_through_pct"),
    )


def quality_correlation(events: DataFrame, results: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Completed runs whose checks failed rows: one run_id is given to both the lineage and the quality results."""
    runs = events.where((F.col("event_type") == "COMPLETE") & (F.col("event_time") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("event_time") <= as_of)).select("run_id", "job_name", "event_time")
    both = runs.join(results.select("run_id", "check_name", "failed_record_count", "quality_score", "threshold_met"), "run_id")
    keys = ["run_id", "job_name"]
    sums = both.groupBy(*keys).agg(F.min("event_time").alias("run_time"), F.sum("failed_record_count").alias("total_failures"), F.round(F.avg("quality_score") * 100, 3).alias("avg_quality_pct")).where("total_failures > 0")
    top = modes(both.where(~F.col("threshold_met")), keys, ["check_name"]).withColumnRenamed("check_name", "top_failing_check")
    return sums.join(top, keys, "left")
