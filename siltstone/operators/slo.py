"""Service levels: windowed fractions, burn rates, error budgets, completeness, lag."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BurnTier:
    """An alert: the bad fraction over ``hours`` burns the budget ``rate`` times too fast."""

    hours: int
    rate: float
    severity: str


# The product's alert tiers and limits.
TIERS = (BurnTier(1, 14.4, "page"), BurnTier(6, 6.0, "ticket"))
GOLD_LIMIT_SECONDS, GOLD_TARGET, AVAILABILITY_TARGET, BUDGET_DAYS = 300, 0.999, 0.999, 30
DLQ_ALERT_PER_HOUR, DLQ_MOST_PER_HOUR, LAG_LIMIT_SECONDS = 1, 10, 30


def error_budget_minutes(target: float = GOLD_TARGET, days: int = BUDGET_DAYS) -> float:
    return (1 - target) * days * 24 * 60


def minutes(updates: DataFrame, start: Column, end: Column, limit_seconds: int = GOLD_LIMIT_SECONDS) -> DataFrame:
    """Per minute from start to end: whether the newest update at that time was within the limit.

    The minute spine and the updates are one sorted stream of rows, carried forward by a window: no range join.
    The spine has one row a minute (43,200 for 30 days), whatever the number of updates.
    """
    one = updates.sparkSession.range(1)
    spine = one.select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MINUTE"))).alias("at")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    # only the last update of each minute can matter: the updates shrink to at most a row a minute before the window
    last = updates.where(F.col("updated_at") <= end).groupBy(F.greatest(F.date_trunc("minute", "updated_at") + F.expr("INTERVAL 1 MINUTE"), start).alias("at")).agg(F.max("updated_at").alias("updated_at"))
    both = spine.withColumn("is_minute", F.lit(True)).unionByName(last.withColumn("is_minute", F.lit(False)))
    carried = F.max("updated_at").over(Window.orderBy("at", "is_minute").rowsBetween(Window.unboundedPreceding, 0))
    age = F.unix_seconds("at") - F.unix_seconds("latest")
    return both.withColumn("latest", carried).where("is_minute").select("at", "latest", F.coalesce(age <= limit_seconds, F.lit(False)).alias("good"))


def compliance(minute_rows: DataFrame, target: float = GOLD_TARGET) -> DataFrame:
    bad = F.count_if(~F.col("good"))
    return minute_rows.agg(F.count(F.lit(1)).alias("minutes"), bad.alias("bad_minutes"), F.round(F.avg(F.col("good").cast("double")), 6).alias("good_fraction"), F.round(bad / (error_budget_minutes(target)), 6).alias("budget_used"))


def burn_rates(minute_rows: DataFrame, as_of: Column, target: float = GOLD_TARGET, tiers: tuple[BurnTier, ...] = TIERS) -> DataFrame:
    """Per tier: the bad fraction of its window over the budgeted one, and whether the alert fires."""
    out = None
    for t in tiers:
        inside = minute_rows.where((F.col("at") > as_of - F.expr(f"INTERVAL {t.hours} HOURS")) & (F.col("at") <= as_of))
        rate = F.coalesce(F.avg((~F.col("good")).cast("double")), F.lit(0.0)) / (1 - target)
        row = inside.agg(F.round(rate, 6).alias("burn_rate")).select(F.lit(t.hours).alias("window_hours"), F.lit(t.rate).alias("allowed_rate"), F.lit(t.severity).alias("severity"), "burn_rate", (F.col("burn_rate") >= t.rate).alias("firing"))
        out = row if out is None else out.unionByName(row)
    return out


def dead_letter_rate(letters: DataFrame, as_of: Column) -> DataFrame:
    """Dead letters in the last hour against the alert and the most."""
    n = F.count_if((F.col("arrived_at") > as_of - F.expr("INTERVAL 1 HOUR")) & (F.col("arrived_at") <= as_of))
    return letters.agg(n.alias("last_hour")).select("last_hour", (F.col("last_hour") > DLQ_ALERT_PER_HOUR).alias("alert"), (F.col("last_hour") > DLQ_MOST_PER_HOUR).alias("breach"))


def completeness(produced: DataFrame, stored: DataFrame, key: str = "event_id") -> DataFrame:
    """The share of produced keys that are stored."""
    keys = produced.select(key).distinct()
    marked = keys.join(stored.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("produced"), F.count("_in").alias("stored")).select("produced", "stored", F.round(F.try_divide(F.col("stored") * 100.0, F.col("produced")).cast("double"), 4).alias("completeness_pct"))


def availability(lag_samples: DataFrame, limit_seconds: int = LAG_LIMIT_SECONDS) -> DataFrame:
    """The share of samples (at, lag_seconds) whose lag was within the limit."""
    good = F.count_if(F.col("lag_seconds") <= limit_seconds)
    return lag_samples.agg(F.count(F.lit(1)).alias("samples"), F.round(F.try_divide(good * 100.0, F.count(F.lit(1))).cast("double"), 4).alias("availability_pct"))
