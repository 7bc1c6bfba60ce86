"""Volume and distribution monitoring: daily profiles, rolling baselines, Z-scores.

A table is profiled in one aggregation for all days and columns; the profile is
turned to one row a metric, and the baseline of every (table, metric, day) is a
range window over the days before it, not a query each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import latest_by, metric_parts, ratio_pct, stable_id

#: Baseline dates: from the first to the last number of days before the day (eight dates).
BASELINE = (8, 1)
ANOMALY, WARNING = 3.0, 2.0

METRICS = T.StructType([
    T.StructField("metric_id", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("partition_date", T.DateType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("metric_value", T.DoubleType()),
    T.StructField("baseline_7d_avg", T.DoubleType()),
    T.StructField("baseline_7d_stddev", T.DoubleType()),
    T.StructField("z_score", T.DoubleType()),
    T.StructField("anomaly_detected", T.BooleanType()),
    T.StructField("collected_at", T.TimestampType()),
])


def profile(df: DataFrame, table: str, date_column: str, numeric: list[str], approximate_distinct: bool = True) -> DataFrame:
    """(table_name, partition_date, metric_name, metric_value) of every day; metrics without a value are left out."""
    distinct = F.approx_count_distinct if approximate_distinct else F.count_distinct
    aggregates = [F.count(F.lit(1)).cast("double").alias("row_count")]
    for c in numeric:
        aggregates += [
            (F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(f"null_rate_{c}"),
            F.avg(c).alias(f"mean_{c}"),
            F.stddev(c).alias(f"stddev_{c}"),
            F.percentile(c, 0.95).alias(f"p95_{c}"),
            distinct(c).cast("double").alias(f"distinct_count_{c}"),
        ]
    daily = df.groupBy(F.to_date(date_column).alias("partition_date")).agg(*aggregates)
    names = [c for c in daily.columns if c != "partition_date"]
    return daily.unpivot(["partition_date"], names, "metric_name", "metric_value").where("metric_value is not null").select(F.lit(table).alias("table_name"), "partition_date", "metric_name", "metric_value")


def scored(metrics: DataFrame, collected_at: Column) -> DataFrame:
    """Adds baseline, Z-score and verdict; the score is null without a history or with none of its spread."""
    day = F.datediff("partition_date", F.lit("1970-01-01").cast("date"))
    history = Window.partitionBy("table_name", "metric_name").orderBy("_day").rangeBetween(-BASELINE[0], -BASELINE[1])
    rows = metrics.withColumn("_day", day).withColumn("_avg", F.avg("metric_value").over(history)).withColumn("_std", F.stddev("metric_value").over(history))
    z = F.when((F.col("_std") > 0) & F.col("_avg").isNotNull(), F.round((F.col("metric_value") - F.col("_avg")) / F.col("_std"), 3))
    return rows.withColumn("z_score", z).select(
        stable_id(F.col("table_name"), F.col("partition_date"), F.col("metric_name")).alias("metric_id"),
        "table_name",
        "partition_date",
        "metric_name",
        F.round("metric_value", 6).alias("metric_value"),
        F.col("_avg").alias("baseline_7d_avg"),
        F.col("_std").alias("baseline_7d_stddev"),
        "z_score",
        F.coalesce(F.abs("z_score") > ANOMALY, F.lit(False)).alias("anomaly_detected"),
        collected_at.alias("collected_at"),
    )


def last_collected(metrics: DataFrame) -> DataFrame:
    """Intra-day reruns append; the last metric of a (table, metric, date) counts."""
    return latest_by(metrics, ["table_name", "metric_name", "partition_date"], F.col("collected_at"))


def run_monitor(tables: dict[str, tuple[Callable[[], DataFrame], str, list[str]]], collected_at: Column) -> tuple[DataFrame | None, dict[str, str]]:
    """Profiles of several tables (name -> reader, date column, numeric columns); a table that fails is reported, not fatal."""
    out: DataFrame | None = None
    failed: dict[str, str] = {}
    for name, (read, date_column, numeric) in tables.items():
        try:
            rows = profile(read(), name, date_column, numeric)
            out = rows if out is None else out.unionByName(rows)
        except Exception as e:  # noqa: BLE001  one table's failure must not hide the others
            failed[name] = str(e)
    return (scored(out, collected_at) if out is not None else None), failed


def status(z: Column) -> Column:
    return F.when(F.abs(z) > ANOMALY, "✗ ANOMALY").when(F.abs(z) > WARNING, "⚠ WARNING").otherwise("✓ NORMAL")


def _two_digits(name: str) -> Column:
    """Rounded a trifle upwards, so that the last bits of a sum don't decide a half."""
    return F.round(F.col(name) + 1e-9, 2)


def _deviation() -> Column:
    return F.round((F.col("metric_value") - F.col("baseline_7d_avg")) / F.nullif(F.col("baseline_7d_avg"), F.lit(0.0)) * 100, 1)


def _since(as_of: Column, days: int) -> Column:
    return (F.col("partition_date") >= F.date_sub(F.to_date(as_of), days)) & (F.col("partition_date") <= F.to_date(as_of))


def _by_deviation() -> Column:
    """Largest deviations first, in either direction; a metric without a baseline counts as none."""
    return F.abs(F.coalesce(F.col("z_score"), F.lit(0.0))).desc()


def volume_anomalies(metrics: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    rows = metrics.where((F.col("metric_name") == "row_count") & _since(as_of, days))
    return rows.select("table_name", "partition_date", F.col("metric_value").cast("long").alias("row_count"), F.round("baseline_7d_avg").alias("baseline_avg_rows"), _two_digits("z_score").alias("z_score"), status(F.col("z_score")).alias("status"), _deviation().alias("deviation_pct")).orderBy(_by_deviation(), "table_name", F.desc("partition_date"))


def volume_trend(metrics: DataFrame, as_of: Column, days: int = 30, tables: tuple[str, str, str] = ("bronze.orders", "silver.orders", "gold.order_daily_summary")) -> DataFrame:
    """Row counts of the three layers side by side, and what Silver rejects of Bronze."""
    rows = metrics.where((F.col("metric_name") == "row_count") & _since(as_of, days))
    wide = rows.groupBy("partition_date").agg(*(F.max(F.when(F.col("table_name") == t, F.col("metric_value"))).alias(f"{layer}_rows") for layer, t in zip(("bronze", "silver", "gold"), tables, strict=True)))
    return wide.withColumn("silver_rejection_pct", ratio_pct(F.col("bronze_rows") - F.col("silver_rows"), F.col("bronze_rows"), 3)).orderBy(F.desc("partition_date"))


def divergence(trend: DataFrame) -> DataFrame:
    lost = F.col("bronze_rows") - F.col("silver_rows")
    return trend.select("partition_date", lost.alias("rejected_in_silver"), ratio_pct(lost, F.col("bronze_rows"), 3).alias("rejection_pct"))


def distribution_drift(metrics: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    stat, column = metric_parts(F.col("metric_name"))
    rows = metrics.where(F.col("metric_name").rlike("^(mean|stddev|p95)_") & _since(as_of, days))
    return rows.select("partition_date", "table_name", column.alias("column_name"), stat.alias("stat_type"), _two_digits("metric_value").alias("value"), _two_digits("baseline_7d_avg").alias("baseline"), _two_digits("z_score").alias("z_score"), "anomaly_detected").orderBy(F.desc("partition_date"), "table_name", "column_name", "stat_type")


def null_rates(metrics: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    rows = metrics.where(F.col("metric_name").like(r"null\_rate\_%") & _since(as_of, days))
    band = F.when(F.col("metric_value") > 0.001, "✗ ABOVE 0.1% THRESHOLD").when(F.col("metric_value") > 0, "⚠ SOME NULLS").otherwise("✓ CLEAN")
    return rows.select("partition_date", "table_name", F.replace("metric_name", F.lit("null_rate_"), F.lit("")).alias("column_name"), F.round(F.col("metric_value") * 100, 4).alias("null_rate_pct"), band.alias("status")).orderBy(F.desc("partition_date"), F.desc("null_rate_pct"), "column_name")


def active_anomalies(metrics: DataFrame, as_of: Column, span: str = "24 HOURS") -> DataFrame:
    rows = metrics.where(F.col("anomaly_detected") & (F.col("collected_at") >= as_of - F.expr(f"INTERVAL {span}")) & (F.col("collected_at") <= as_of))
    return rows.select("collected_at", "table_name", "metric_name", _two_digits("metric_value").alias("current_value"), _two_digits("baseline_7d_avg").alias("expected_value"), _two_digits("z_score").alias("z_score"), _deviation().alias("deviation_pct")).orderBy(_by_deviation(), F.desc("collected_at"), "table_name", "metric_name")
