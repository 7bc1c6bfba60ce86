"""Every registered query against its SQL twin on the same tables."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from siltstone.plans import catalogue, order_events
from siltstone.sources import snapshots


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert differences(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, sf_dir):
    plan = catalogue.queries()["q33_polling"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


def test_gold_is_refreshed_whole(spark, sf_dir, monkeypatch):
    """The table behind gold_incremental holds every day of Gold, not the twin's two months only."""
    made = []

    class Kept(snapshots.SnapshotTable):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(snapshots, "SnapshotTable", Kept)
    catalogue.queries()["gold_incremental"](spark, sf_dir)
    columns = ["order_date", "currency", "order_count", "total_revenue_cents", "item_count", "unique_customers"]
    assert sorted(made[0].read().select(columns).collect()) == sorted(order_events.gold_summary(spark, sf_dir).select(columns).collect())
