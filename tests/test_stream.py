"""The Silver stream over fixed micro-batches: verdicts, restarts, repeated batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import quality, silver
from siltstone.sources.snapshots import SnapshotTable
from siltstone.streaming import silver_stream, windows

T0 = datetime(2024, 1, 1)
ITEMS = [("a", 1, 100)]


def event(key, minutes, total=100, items=ITEMS):
    return (key, "ORDER_PLACED", "1.0", T0 + timedelta(minutes=minutes), key, "c", items, total, "EUR", None, ("t", "svc"))


BATCHES = [
    [event("a", 0), event("b", 1), event("bad", 2, total=7), event("late-base", 30)],
    [event("a", 31), event("bad", 32), event("none", 33, items=[])],
    [event("old", 3), event("c", 60)],
]


@pytest.fixture()
def topic(spark, tmp_path):
    path = tmp_path / "topic"
    path.mkdir()

    def add(k):
        part = tmp_path / f"part{k}"
        spark.createDataFrame(BATCHES[k], silver.ORDER_PLACED).coalesce(1).write.parquet(str(part))
        next(part.glob("*.parquet")).rename(path / f"{k}.parquet")

    return path, add


def test_stream(spark, tmp_path, topic):
    path, add = topic
    tables = [SnapshotTable(spark, str(tmp_path / n)) for n in ("bronze", "silver", "dlq")]

    def run():
        silver_stream.start(silver_stream.files(spark, str(path)), *tables, checkpoint=str(tmp_path / "ck"), available_now=True).awaitTermination()

    for k in range(3):  # each run restarts from the checkpoint
        add(k)
        run()
    bronze, good, dead = (t.read() for t in tables)
    assert bronze.count() == 9
    assert sorted(r["event_id"] for r in good.collect()) == ["a", "b", "bad", "c", "late-base"]
    got = sorted((r["event_id"], r["failure_reason"], r["failure_stage"], r["late_arrival"]) for r in dead.collect())
    assert got == [("a", "duplicate_event_id", "silver_dedup", False), ("bad", "total_mismatch", "silver_validation", False), ("none", "empty_items_array", "silver_validation", False), ("old", "late_arrival", "silver_watermark", True)]
    run()
    assert [t.read().count() for t in tables] == [9, 5, 4]


def test_counts_and_reprocessing(spark, tmp_path, topic):
    path, add = topic
    for k in range(3):
        add(k)
    tables = [SnapshotTable(spark, str(tmp_path / n)) for n in ("bronze", "silver", "dlq")]
    query = silver_stream.start(silver_stream.files(spark, str(path), per_trigger=10), *tables, checkpoint=str(tmp_path / "ck"), name="counted", available_now=True)
    query.awaitTermination()
    counts = [p["observedMetrics"]["counted"] for p in query.recentProgress if p["observedMetrics"]]
    assert sum(c["processed"] for c in counts) == 9 and sum(c["dlq_routed"] for c in counts) == tables[2].read().count()
    assert sum(c["dedup_dropped"] for c in counts) == tables[2].read().where("failure_reason = 'duplicate_event_id'").count() > 0
    again = [SnapshotTable(spark, str(tmp_path / f"{n}_v2")) for n in ("silver", "dlq", "bronze")]
    assert silver_stream.reprocess(silver_stream.files(spark, str(path), per_trigger=10), *again, checkpoint=str(tmp_path / "ck2"), validate=lambda df: df.count() == tables[1].read().count(), name="v2")
    assert sorted(r["event_id"] for r in again[0].read().collect()) == sorted(r["event_id"] for r in tables[1].read().collect())


def test_quality_branch_and_repeated_batch(spark, tmp_path, topic):
    path, add = topic
    add(0)
    results = SnapshotTable(spark, str(tmp_path / "quality"))
    rule = quality.Rule("total_positive", "validity", "greater_than", 1.0, column="total_amount_cents", value=50)
    for name in ("one", "one"):
        windows.quality_branch(silver_stream.files(spark, str(path)), [rule], "silver_validation", results, str(tmp_path / name), now=F.lit(T0), window="hour", available_now=True).awaitTermination()
    rows = results.read().collect()
    assert [(r["total_record_count"], r["passed_record_count"], r["threshold_met"]) for r in rows] == [(4, 3, False)]
