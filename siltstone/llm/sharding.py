"""Byte-balanced shards by Karmarkar-Karp differencing.

Documents with equal texts form one indivisible group.  Groups are dealt to
parts by their hash; within a part every group starts as a partition with all
its bytes in one slot, and the two partitions with the largest spread are
combined again and again, the largest slot of one with the smallest of the
other.  A part ends as one partial partition of ``shards`` slots; the driver
differences these few tuples (one a part) the same way, which fixes the shard
of every slot of every part.

The law that holds is ``bytes``: shard sizes are as near equal as the largest
group allows (a group above a shard's even share fills a shard by itself).

Defined cases: null text has no bytes and equals empty text; null and repeated
doc_ids are placed like others (each row has its slot); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, written

SHARDS = 24
ROW_BYTES = 8
#: Groups that one task differences: the smaller number while there are up to MANY_PARTS parts, at most the larger.
GROUPS_PER_PART, MOST_GROUPS_PER_PART, MANY_PARTS = 2_000, 100_000, 4_096
#: Rows of a shard that one task numbers.
ROWS_PER_BLOCK = 50_000


def differenced(starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Combines partitions (ascending sums) until one is left: for each input and slot the final slot, and the final sums."""
    n, k = len(starts), len(starts[0])
    nodes: list[np.ndarray] = list(starts)
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(int(s[0] - s[-1]), i) for i, s in enumerate(nodes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        sums = nodes[a] + nodes[b][::-1]
        order = np.argsort(sums, kind="stable")
        made.append((a, b, order))
        nodes.append(sums[order])
        heapq.heapreplace(heap, (int(sums[order[0]] - sums[order[-1]]), n + len(made) - 1))
    place = np.empty((n + len(made), k), np.int64)
    place[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        final = place[n + i]
        place[a][order] = final
        place[b][k - 1 - order] = final
    return place[:n], nodes[-1]


def _part(shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("key", "ascending")])
        sizes = table.column("bytes").to_numpy()
        starts = np.zeros((len(sizes), shards), np.int64)
        starts[:, -1] = sizes
        place, sums = differenced(list(starts))
        n = len(sizes) + 1  # the last row has the part's sums
        return pa.table({
            "part": pa.array([table.column("part")[0].as_py()] * n, pa.int32()),
            "key": pa.concat_arrays([table.column("key").combine_chunks(), pa.nulls(1, pa.binary())]),
            "place": pa.array([*place[:, -1].tolist(), None], pa.int32()),
            "sums": pa.array([*[None] * len(sizes), sums.tolist()], pa.list_(pa.int64())),
        })

    return run


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select("doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")), "sizes")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    n = groups.count()
    parts = max(1, min(MANY_PARTS, n // GROUPS_PER_PART), n // MOST_GROUPS_PER_PART)
    parted = groups.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    local = written(parted.groupBy("part").applyInArrow(_part(shards), "part int, key binary, place int, sums array<long>"), "parts")

    tops = sorted((r["part"], r["sums"]) for r in local.where("key is null").select("part", "sums").collect())  # a row a part
    place = differenced([np.array(s, np.int64) for _, s in tops])[0] if tops else []
    final = spark.createDataFrame([(p, i, int(x)) for (p, _), row in zip(tops, place, strict=True) for i, x in enumerate(row)], "part int, place int, shard int")
    groups_at = local.where("key is not null").select("part", "key", "place").join(F.broadcast(final), ["part", "place"]).select("key", "shard")

    blocks = max(8, rows.count() // (shards * ROWS_PER_BLOCK))
    placed = written(rows.join(groups_at, "key").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int").alias("block")), "placed")
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("ahead"))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return placed.join(ahead, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + number - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
