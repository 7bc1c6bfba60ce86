"""Mixing sources to target word counts by subset-sum budget fitting.

A source's target is met by whole passes over the source and one rest.  The
rest is fitted exactly where it can be: documents are counted by their exact
length, every length first gives its proportional share, and a bounded-knapsack
dynamic program over lengths and counts closes what remains.  The documents of
a length are then chosen in a seeded order of doc_id and text, so that rows which
share a doc_id are told apart and lie in different tasks.

Defined cases: null text has no words; null is a source of its own, last in
order; rows that repeat a doc_id count each; an empty table gives an empty
result, and a table without words takes nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .shared import ship, written

WEIGHTS = (1.0, 2.0, 3.0)
MOST_PASSES = 3
SEED = 20_240_601
#: Rows of one source and length that one task ranks.
ROWS_PER_SALT, LEAST_SALTS = 20_000, 16
#: Sources are few; their sizes and targets are held by the driver up to this many.
MOST_SOURCES = 1_000_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [np.diff(kernel.word_spans(d, o)[2]) for _, _, d, o in kernel.slices(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), batch.column(3)], names=["doc_id", "source", "size", "row_key"])


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Weights 1, 2, 3, repeating over sources by code point (null last) share all words; none gets above three times its own."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > MOST_PASSES * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(MOST_PASSES * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget``, not above it.

    Proportional shares first; then the largest lengths that fit, which leaves
    less than the largest length or no documents; the program runs over what is
    left plus a few of the lengths taken, as bits of reachable sums.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    order = np.argsort(lengths, kind="stable")
    n, c = lengths[order].astype(object), counts[order].astype(object)
    take = np.array([k * budget // total for k in c], object)
    rest = budget - int((n * take).sum())
    for i in range(len(n) - 1, -1, -1):
        if n[i] > 0:
            more = min(c[i] - take[i], rest // n[i])
            take[i] += more
            rest -= int(n[i] * more)
    if rest:
        # give back some short and then some long documents, so that the program has others to choose from
        room = 4 * int(n[-1])
        for turn, most in ((range(len(n)), room // 2), (range(len(n) - 1, -1, -1), room)):
            for i in turn:
                if take[i] and n[i] and rest + n[i] <= most:
                    take[i] -= 1
                    rest += int(n[i])
        take += _knapsack([int(x) for x in n], [int(x) for x in c - take], rest)
    out = np.zeros(len(lengths), np.int64)
    out[order] = take.astype(np.int64)
    return out


def _knapsack(lengths: list[int], spare: list[int], budget: int) -> np.ndarray:
    """Bounded knapsack over reachable sums: each sum remembers the first item that reached it."""
    items = []
    for i, (w, c) in enumerate(zip(lengths, spare, strict=True)):
        c, step = min(c, budget // w if w else 0), 1
        while c > 0:
            k = min(step, c)
            items.append((i, k, k * w))
            c, step = c - k, step * 2
    reached, first = np.zeros(budget + 1, bool), np.full(budget + 1, -1, np.int64)
    reached[0] = True
    for j, (_, _, weight) in enumerate(items):
        new = np.flatnonzero(reached[: budget + 1 - weight] & ~reached[weight:]) + weight
        reached[new], first[new] = True, j
        if reached[budget]:
            break
    at, take = int(np.flatnonzero(reached)[-1]), np.zeros(len(lengths), object)
    while at:
        i, k, weight = items[first[at]]
        take[i] += k
        at -= weight
    return take


def _fit(table: pa.Table) -> pa.Table:
    take = fitted(table.column("size").to_numpy(), table.column("n").to_numpy(), table.column("rest")[0].as_py())
    return table.select(["key", "size", "n"]).append_column("take", pa.array(take, pa.int64()))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken."""
    return planned(docs, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def planned(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, row_key (a hash of the text), size, source_size, target, and how many times the mix takes it."""
    spark = docs.sparkSession
    ship(spark)
    sizes = written(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("row_key")).mapInArrow(_count_words, "doc_id long, source string, size long, row_key long"), "lengths")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    words = {r["source"]: r["words"] for r in per_source}
    goal = targets(words)
    plan = []
    for s, t in goal.items():
        passes = min(MOST_PASSES, int(t // words[s])) if words[s] else 0
        rest = 0 if passes == MOST_PASSES else round(t - passes * words[s])
        plan.append(("n" if s is None else "s" + s, words[s], t, passes, rest))
    by_source = spark.createDataFrame(plan, "key string, source_size long, target double, passes int, rest long")

    salts = max(LEAST_SALTS, sum(r["n"] for r in per_source) // ROWS_PER_SALT)
    order = F.xxhash64("doc_id", "row_key", F.lit(seed))
    keyed = sizes.withColumn("key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))).withColumn("order", order)
    keyed = keyed.withColumn("salt", F.pmod(F.shiftrightunsigned("order", 20), F.lit(salts)).cast("int"))
    # the program's input is a row a source and length, whatever the number of documents
    by_length = keyed.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(by_source.select("key", "rest")), "key")
    chosen = by_length.groupBy("key").applyInArrow(_fit, "key string, size long, n long, take long")
    by_salt = keyed.groupBy("key", "size", "salt").agg(F.count(F.lit(1)).alias("m"))
    ahead = by_salt.select("key", "size", "salt", (F.sum("m").over(Window.partitionBy("key", "size").orderBy("salt")) - F.col("m")).alias("ahead"))
    quota = written(ahead.join(chosen, ["key", "size"]).select("key", "size", "salt", (F.col("take") - F.col("ahead")).alias("quota")), "quotas")
    rank = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("order", "doc_id", "row_key"))
    picked = keyed.join(quota, ["key", "size", "salt"]).withColumn("picked", (rank <= F.col("quota")).cast("int"))
    return picked.join(F.broadcast(by_source.drop("rest")), "key").select("doc_id", "source", "row_key", "size", "source_size", "target", (F.col("passes") + F.col("picked")).alias("times"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it."""
    # rows that agree in all of these are numbered on both sides, so that each meets one
    key = ["_doc_id", "_source", "_row_key"]
    same = [F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.xxhash64("text").alias(key[2])]
    plan = planned(docs, seed).select("doc_id", "source", F.col("row_key").alias(key[2]), "times")
    plan = plan.select(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), key[2], "times", F.row_number().over(Window.partitionBy("doc_id", "source", key[2]).orderBy("times")).alias("_nth"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *same)
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("_doc_id")))
    on = F.lit(True)
    for c in [*key, "_nth"]:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    taken = rows.alias("r").join(plan.where("times > 0").alias("p"), on).select("r._row", F.explode(F.sequence(F.lit(1), "p.times")).alias("_time"))
    return taken.select("_row.*")
