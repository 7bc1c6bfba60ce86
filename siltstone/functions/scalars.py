"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """A double amount as whole cents, half up."""
    return F.floor(amount * 100 + 0.5).cast("long")


def ratio_pct(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole as a rounded double; null where there is nothing to divide by."""
    return F.round(part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def rounded(x: Column, digits: int) -> Column:
    """Rounded a trifle upwards, so that the last bits of a quotient don't decide a half."""
    return F.round(x + 1e-7, digits)


def age(now: Column, since: Column) -> Column:
    return now - since


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def stable_id(*parts: Column) -> Column:
    """A reproducible identifier in place of a random one."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def metric_parts(name: Column) -> tuple[Column, Column]:
    """('mean', 'total_amount_cents') of 'mean_total_amount_cents', whatever underscores the column has."""
    pattern = r"^(mean|stddev|p95|null_rate|distinct_count)_(.*)$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)


def modes(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The most frequent value of each of ``values`` by ``keys``; of equally frequent ones the least.

    One aggregation counts (key, column, value) triples, the second keeps the best a key and column, so no
    value list is ever gathered: skewed keys are combined on the map side.
    """
    pairs = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).cast("string").alias("value")) for v in values))).alias("p"))
    counted = pairs.where("p.value is not null").groupBy(*keys, "p.name", "p.value").agg(F.count(F.lit(1)).alias("n"))
    # the largest count wins, then the least value: min over (-n, value)
    best = counted.groupBy(*keys, "name").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
    return best.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == v, F.col("best.value"))).alias(v) for v in values))


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Each key's last row by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
