"""Declarative quality rules, compiled to columns and scored by window in one pass.

A rule passes or fails a row; a NULL or missing column fails every rule that
reads it, and an unknown rule passes.  ``profile`` scores all rules of a stage
at once: one aggregation by window with three aggregates a rule, then one row a
rule.  Scores inform, they never gate.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import modes, ratio_pct, stable_id
from .silver import ITEM, items_total

SAMPLE = 10
DIMENSIONS = ("completeness", "validity", "consistency", "timeliness", "uniqueness")


@dataclass(frozen=True)
class Rule:
    name: str
    dimension: str
    rule: str
    threshold: float
    column: str | None = None
    value: float | None = None
    values: tuple[Any, ...] = ()
    tolerance_minutes: int | None = None
    column_a: str | None = None
    column_b: str | None = None
    sum_source_column: str | None = None
    target_column: str | None = None


# The stages' tables and the orders product's checks (name, dimension, rule, threshold, arguments).
STAGE_TABLES = {"bronze_ingestion": "bronze.orders", "silver_validation": "silver.orders", "gold_aggregation": "gold.order_daily_summary"}
ORDER_RULES: dict[str, list[Rule]] = {
    "bronze_ingestion": [
        Rule("event_id_not_null", "completeness", "not_null", 1.0, column="event_id"),
        Rule("occurred_at_not_null", "completeness", "not_null", 1.0, column="occurred_at"),
        Rule("occurred_at_not_future", "timeliness", "not_future", 0.999, column="occurred_at", tolerance_minutes=5),
        Rule("occurred_at_not_stale", "timeliness", "within_days", 0.999, column="occurred_at", value=90),
    ],
    "silver_validation": [
        Rule("order_id_not_null", "completeness", "not_null", 1.0, column="order_id"),
        Rule("customer_id_not_null", "completeness", "not_null", 0.999, column="customer_id"),
        Rule("total_amount_positive", "validity", "greater_than", 0.999, column="total_amount_cents", value=0),
        Rule("total_amount_reasonable", "validity", "less_than", 0.9999, column="total_amount_cents", value=100_000_000),
        Rule("items_total_consistency", "consistency", "column_sum_equals", 0.999, sum_source_column="items_json", target_column="total_amount_cents"),
        Rule("currency_valid_iso4217", "validity", "in_set", 0.999, column="currency", values=("USD", "EUR", "GBP", "CAD", "AUD", "JPY", "INR")),
        Rule("item_count_positive", "validity", "greater_than", 1.0, column="item_count", value=0),
    ],
    "gold_aggregation": [
        Rule("total_revenue_positive", "validity", "greater_than", 1.0, column="total_revenue_cents", value=0),
        Rule("order_count_positive", "validity", "greater_than", 0.99, column="order_count", value=0),
        Rule("unique_customers_lte_order_count", "consistency", "column_a_lte_column_b", 1.0, column_a="unique_customers", column_b="order_count"),
        Rule("updated_at_fresh", "timeliness", "within_minutes", 0.999, column="updated_at", value=10),
    ],
}

RESULTS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("pipeline_stage", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("check_name", T.StringType()),
    T.StructField("dimension", T.StringType()),
    T.StructField("total_record_count", T.LongType()),
    T.StructField("passed_record_count", T.LongType()),
    T.StructField("failed_record_count", T.LongType()),
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("threshold_met", T.BooleanType()),
    T.StructField("sample_failure_ids", T.StringType()),
    T.StructField("window_start", T.TimestampType()),
    T.StructField("window_end", T.TimestampType()),
    T.StructField("evaluated_at", T.TimestampType()),
])


def load_rules(path: str) -> dict[str, list[Rule]]:
    """Rules by stage from YAML (stages: [{stage, checks: [...]}]); descriptive keys are ignored."""
    import yaml

    with open(path, encoding="utf-8") as f:
        spec = yaml.safe_load(f)
    known = {f.name for f in fields(Rule)}
    return {s["stage"]: [Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in c.items() if k in known}) for c in s["checks"]] for s in spec["stages"]}


def passes(rule: Rule, columns: Iterable[str], now: Column) -> Column:
    """Whether a row passes; never null."""
    have = set(columns)

    def col(name: str | None) -> Column:
        return F.col(name) if name in have else F.lit(None)

    def ms(ts: Column) -> Column:
        return F.unix_millis(ts.cast("timestamp"))

    if rule.rule == "not_null":
        return col(rule.column).isNotNull()
    if rule.rule == "greater_than":
        ok = col(rule.column) > F.lit(rule.value)
    elif rule.rule == "less_than":
        ok = col(rule.column) < F.lit(rule.value)
    elif rule.rule == "in_set":
        ok = col(rule.column).isin([v for v in rule.values if v is not None])
        if None in rule.values:
            ok = ok | col(rule.column).isNull()
    elif rule.rule == "not_future":
        ok = ms(col(rule.column)) <= ms(now) + F.lit((rule.tolerance_minutes or 5) * 60_000)
    elif rule.rule == "within_days":
        ok = ms(col(rule.column)) >= ms(now) - F.lit(int((rule.value or 0) * 86_400_000))
    elif rule.rule == "within_minutes":
        ok = ms(col(rule.column)) >= ms(now) - F.lit(int((rule.value or 0) * 60_000))
    elif rule.rule == "column_a_lte_column_b":
        ok = col(rule.column_a) <= col(rule.column_b)
    elif rule.rule == "column_sum_equals":
        if "items" in have:
            items = F.col("items")
        else:
            items = F.from_json(col(rule.sum_source_column or "items_json").cast("string"), T.ArrayType(ITEM))
        total = F.coalesce(col(rule.target_column or "total_amount_cents"), F.lit(-1))
        ok = (F.size(items) > 0) & (items_total(items) == total)
    else:
        return F.lit(True)
    return F.coalesce(ok, F.lit(False))


def profile(df: DataFrame, rules: list[Rule], stage: str, now: Column, time: str | None, window: str = "day", run_id: Column | None = None) -> DataFrame:
    """Results of a stage's rules by window of ``time`` (all rows in one window if None); empty windows give none."""
    columns = df.columns
    failing = F.col("event_id") if "event_id" in columns else F.col("order_id") if "order_id" in columns else F.lit("unknown")
    start = F.date_trunc(window, F.col(time).cast("timestamp")) if time else now.cast("timestamp")
    end = (start + F.expr(f"INTERVAL 1 {window}")) if time else start
    # the verdicts are columns first, so that each is computed once for its three aggregates
    judged = df.select(start.alias("window_start"), end.alias("window_end"), failing.cast("string").alias("_id"), *(passes(r, columns, now).alias(f"_ok{i}") for i, r in enumerate(rules)))
    scored = judged.groupBy("window_start", "window_end").agg(F.count(F.lit(1)).alias("_total"), *(F.count_if(f"_ok{i}").alias(f"_passed{i}") for i in range(len(rules))))
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r.name).alias("check_name"), F.lit(r.dimension).alias("dimension"), F.lit(float(r.threshold)).alias("threshold"), F.col(f"_passed{i}").alias("passed")) for i, r in enumerate(rules)))
    counted = scored.select("window_start", "window_end", "_total", F.explode(each).alias("c"))
    samples = _first_ids(judged, len(rules))
    rows = counted.join(samples, F.col("window_start").eqNullSafe(F.col("_window")) & (F.col("c.i") == F.col("_check")), "left")
    score = F.when(F.col("_total") > 0, F.col("c.passed") / F.col("_total")).otherwise(F.lit(1.0))
    return rows.select(
        (run_id if run_id is not None else stable_id(F.lit(stage), F.col("window_start"))).alias("run_id"),
        F.lit(stage).alias("pipeline_stage"),
        F.lit(STAGE_TABLES.get(stage, stage)).alias("table_name"),
        "c.check_name",
        "c.dimension",
        F.col("_total").alias("total_record_count"),
        F.col("c.passed").alias("passed_record_count"),
        (F.col("_total") - F.col("c.passed")).alias("failed_record_count"),
        F.round(score, 6).alias("quality_score"),
        "c.threshold",
        (score >= F.col("c.threshold")).alias("threshold_met"),
        F.to_json(F.coalesce("_ids", F.array().cast("array<string>"))).alias("sample_failure_ids"),
        "window_start",
        "window_end",
        F.col("window_end").alias("evaluated_at"),
    )


def _first_ids(judged: DataFrame, n_rules: int) -> DataFrame:
    """The least SAMPLE failing ids of each window and rule.

    Spark limits a ranked window before the shuffle, so each task sends SAMPLE ids of a window and rule at most,
    however many rows fail.
    """
    failed = F.filter(F.array(*(F.when(~F.col(f"_ok{i}"), F.lit(i)) for i in range(n_rules))), lambda i: i.isNotNull())
    each = judged.where(F.col("_id").isNotNull()).select(F.col("window_start").alias("_window"), "_id", F.explode(failed).alias("_check"))
    ranked = each.withColumn("_rank", F.row_number().over(Window.partitionBy("_window", "_check").orderBy("_id"))).where(F.col("_rank") <= SAMPLE)
    return ranked.groupBy("_window", "_check").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))


def _recent(results: DataFrame, as_of: Column, span: str) -> DataFrame:
    return results.where((F.col("evaluated_at") >= as_of - F.expr(f"INTERVAL {span}")) & (F.col("evaluated_at") <= as_of))


STAGE_LABELS = {"bronze_ingestion": "1. Bronze Ingestion", "silver_validation": "2. Silver Validation", "silver_dedup": "3. Silver Dedup", "gold_aggregation": "4. Gold Aggregation"}


def waterfall(results: DataFrame, as_of: Column, span: str = "24 HOURS") -> DataFrame:
    """Per stage: record counts, quality, breaches, the check that fails most often, and a status mark."""
    recent = _recent(results, as_of, span)
    totals = recent.groupBy("pipeline_stage").agg(
        F.sum("total_record_count").alias("total_records"),
        F.sum("passed_record_count").alias("passed_records"),
        F.sum("failed_record_count").alias("failed_records"),
        F.count_if(~F.col("threshold_met")).alias("checks_below_threshold"),
    )
    top = modes(recent.where("failed_record_count > 0"), ["pipeline_stage"], ["check_name"]).withColumnRenamed("check_name", "top")
    pct = ratio_pct(F.col("passed_records"), F.col("total_records"), 3)
    label = F.col("pipeline_stage")
    for k, v in STAGE_LABELS.items():
        label = F.when(F.col("pipeline_stage") == k, v).otherwise(label)
    return totals.join(top, "pipeline_stage", "left").select(
        label.alias("stage"), "total_records", "passed_records", "failed_records", pct.alias("quality_pct"), "checks_below_threshold", F.coalesce("top", F.lit("—")).alias("top_failing_check"), status_mark(pct).alias("status")
    ).orderBy("stage")


def status_mark(pct: Column) -> Column:
    return F.when(pct >= 99.9, "✓").when(pct >= 99.0, "⚠").otherwise("✗")


def hourly_trend(results: DataFrame, as_of: Column, span: str = "30 DAYS") -> DataFrame:
    return _recent(results, as_of, span).groupBy(F.date_trunc("hour", "evaluated_at").alias("hour"), "pipeline_stage").agg(
        F.round(F.avg("quality_score") * 100, 3).alias("avg_quality_pct"), F.round(F.min("quality_score") * 100, 6).alias("min_quality_pct"), F.count_if(~F.col("threshold_met")).alias("threshold_breaches")
    ).orderBy(F.desc("hour"), "pipeline_stage")


def failure_breakdown(results: DataFrame, as_of: Column, span: str = "7 DAYS") -> DataFrame:
    failing = _recent(results, as_of, span).where("failed_record_count > 0")
    return failing.groupBy("pipeline_stage", "check_name", "dimension").agg(
        F.sum("failed_record_count").alias("total_failures"),
        F.sum("total_record_count").alias("total_records"),
        ratio_pct(F.sum("failed_record_count"), F.sum("total_record_count"), 4).alias("failure_rate_pct"),
        F.round(F.min("quality_score") * 100, 6).alias("worst_quality_pct"),
        F.count_if(~F.col("threshold_met")).alias("windows_below_threshold"),
        F.max("evaluated_at").alias("last_failure_at"),
    ).orderBy(F.desc("total_failures"), "pipeline_stage", "check_name", "dimension")


def failing_ids(results: DataFrame, as_of: Column, span: str = "1 HOUR", limit: int = 100) -> DataFrame:
    failing = _recent(results, as_of, span).where("failed_record_count > 0")
    rows = failing.select("evaluated_at", "pipeline_stage", "check_name", "failed_record_count", F.explode(F.from_json("sample_failure_ids", "array<string>")).alias("failed_event_id"))
    return rows.orderBy(F.desc("evaluated_at"), F.desc("failed_record_count"), "pipeline_stage", "check_name", "failed_event_id").limit(limit)


def compliance(results: DataFrame, as_of: Column, span: str = "30 DAYS") -> DataFrame:
    return _recent(results, as_of, span).groupBy("pipeline_stage", "check_name", F.col("threshold").alias("required_threshold")).agg(
        F.count(F.lit(1)).alias("total_windows"), F.count_if("threshold_met").alias("passing_windows"), ratio_pct(F.count_if("threshold_met"), F.count(F.lit(1)), 3).alias("compliance_pct")
    ).orderBy("compliance_pct", "pipeline_stage", "check_name", "required_threshold")


def dead_letter_context(results: DataFrame, letters: DataFrame, as_of: Column, span: str = "1 HOUR") -> DataFrame:
    """Sampled failing ids with their dead letters, joined on event_id."""
    failing = _recent(results, as_of, span).select("check_name", "failed_record_count", F.explode(F.from_json("sample_failure_ids", "array<string>")).alias("event_id"))
    return failing.join(letters, "event_id").select("check_name", "failed_record_count", "event_id", "failure_reason", "raw_payload")


def stage_deltas(waterfall_rows: DataFrame) -> DataFrame:
    """Each stage's quality against the stage before it (a handful of rows: one a stage)."""
    before = F.lag("quality_pct").over(Window.orderBy("stage"))
    return waterfall_rows.select("stage", "quality_pct", F.round(F.col("quality_pct") - before, 3).alias("delta_pct"))
