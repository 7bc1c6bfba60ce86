"""Operators on hand-written rows: branches, boundaries, nulls."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import cdc, drift, gold, lineage, monitor, quality, silver, slo
from siltstone.sources import avro, contracts
from siltstone.sources.snapshots import SnapshotTable

NOW = datetime(2024, 1, 31, 12)
ITEMS = [("a", 2, 100), ("b", 1, 50)]


def orders(spark, rows):
    """(event_id, items, total, seq)"""
    schema = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("items", T.ArrayType(silver.ITEM)), T.StructField("total_amount_cents", T.LongType()), T.StructField("seq", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


# --- Silver ------------------------------------------------------------------


@pytest.mark.parametrize("items, total, reason", [(ITEMS, 250, None), (ITEMS, 251, "total_mismatch"), ([], 250, "empty_items_array"), (None, 250, "empty_items_array"), (ITEMS, 0, "non_positive_total"), (ITEMS, None, "non_positive_total"), (ITEMS, -5, "non_positive_total"), ([], 0, "empty_items_array"), ([("a", None, 5), ("b", 1, 7)], 7, None)])
def test_first_broken_rule_wins(spark, items, total, reason):
    row = orders(spark, [("e", items, total, 0)]).select(silver.failure_reason(F.col("items"), F.col("total_amount_cents")).alias("r")).first()
    assert row["r"] == reason


def test_only_valid_events_mark_a_key(spark):
    rows = [("a", ITEMS, 250, 0), ("a", ITEMS, 250, 1), ("b", ITEMS, 1, 0), ("b", ITEMS, 250, 1), ("b", ITEMS, 2, 2), ("c", [], 1, 0), ("c", [], 1, 1)]
    got = {(r["event_id"], r["seq"]): (r["failure_reason"], r["failure_stage"]) for r in silver.judged(orders(spark, rows)).collect()}
    assert got == {
        ("a", 0): (None, None), ("a", 1): ("duplicate_event_id", "silver_dedup"), ("b", 0): ("total_mismatch", "silver_validation"), ("b", 1): (None, None), ("b", 2): ("duplicate_event_id", "silver_dedup"),
        ("c", 0): ("empty_items_array", "silver_validation"), ("c", 1): ("empty_items_array", "silver_validation"),
    }


item = st.tuples(st.just("s"), st.integers(0, 5), st.integers(0, 9))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.lists(item, max_size=3)), st.one_of(st.none(), st.integers(-2, 30))), min_size=1, max_size=30))
def test_validation_equals_its_specification(spark, cases):
    def spec(items, total):
        if not items:
            return "empty_items_array"
        if (total or 0) <= 0:
            return "non_positive_total"
        return "total_mismatch" if total != sum(q * p for _, q, p in items) else None

    rows = [(str(i), items, total, i) for i, (items, total) in enumerate(cases)]
    got = orders(spark, rows).orderBy("seq").select(silver.failure_reason(F.col("items"), F.col("total_amount_cents")).alias("r")).collect()
    assert [r["r"] for r in got] == [spec(*c) for c in cases]


# --- quality -----------------------------------------------------------------

R = quality.Rule
RULE_CASES = [
    (R("r", "d", "not_null", 1, column="x"), "long", [(1, True), (None, False)]),
    (R("r", "d", "greater_than", 1, column="x", value=0), "long", [(1, True), (0, False), (None, False)]),
    (R("r", "d", "less_than", 1, column="x", value=10), "long", [(9, True), (10, False), (None, False)]),
    (R("r", "d", "in_set", 1, column="x", values=("A", "B")), "string", [("A", True), ("C", False), (None, False)]),
    (R("r", "d", "in_set", 1, column="x", values=("A", None)), "string", [("A", True), (None, True), ("B", False)]),
    (R("r", "d", "not_future", 1, column="x", tolerance_minutes=0), "timestamp", [(NOW + timedelta(minutes=5), True), (NOW + timedelta(minutes=5, seconds=1), False), (None, False)]),
    (R("r", "d", "within_days", 1, column="x", value=90), "timestamp", [(NOW - timedelta(days=90), True), (NOW - timedelta(days=90, seconds=1), False), (None, False)]),
    (R("r", "d", "within_minutes", 1, column="x", value=10), "timestamp", [(NOW - timedelta(minutes=10), True), (NOW - timedelta(minutes=11), False), (None, False)]),
    (R("r", "d", "column_a_lte_column_b", 1, column_a="x", column_b="y"), "long", [(5, True), (6, False), (None, False)]),
    (R("r", "d", "no_such_rule", 1, column="x"), "long", [(1, True), (None, True)]),
    (R("r", "d", "not_null", 1, column="absent"), "long", [(1, False)]),
]


@pytest.mark.parametrize("rule, kind, cases", RULE_CASES)
def test_rules(spark, rule, kind, cases):
    df = spark.createDataFrame([(v, 5) for v, _ in cases], f"x {kind}, y int")
    got = [r["ok"] for r in df.select(quality.passes(rule, df.columns, F.lit(NOW)).alias("ok")).collect()]
    assert got == [ok for _, ok in cases]


def test_sum_rule_reads_items_or_json(spark):
    rule = R("r", "d", "column_sum_equals", 1, sum_source_column="items_json", target_column="total_amount_cents")
    df = orders(spark, [("a", ITEMS, 250, 0), ("b", ITEMS, 9, 0), ("c", [], 0, 0), ("d", None, None, 0)])
    want = {"a": True, "b": False, "c": False, "d": False}
    for d in (df, df.withColumn("items_json", F.to_json("items")).drop("items")):
        assert {r["event_id"]: r["ok"] for r in d.select("event_id", quality.passes(rule, d.columns, F.lit(NOW)).alias("ok")).collect()} == want


def test_profile_rows(spark):
    df = spark.createDataFrame([(f"e{i:02d}", None if i < 12 else 1) for i in range(20)], "event_id string, x int")
    row = quality.profile(df, [R("x_there", "completeness", "not_null", 0.4, column="x")], "other", F.lit(NOW), None).first()
    assert (row["total_record_count"], row["passed_record_count"], row["quality_score"], row["threshold_met"], row["table_name"]) == (20, 8, 0.4, True, "other")
    assert json.loads(row["sample_failure_ids"]) == [f"e{i:02d}" for i in range(10)]
    assert quality.profile(df.where("false"), [R("x", "d", "not_null", 1, column="x")], "s", F.lit(NOW), None).collect() == []


@pytest.mark.parametrize("pct, mark", [(99.9, "✓"), (99.899, "⚠"), (99.0, "⚠"), (98.999, "✗")])
def test_status_marks(spark, pct, mark):
    assert spark.range(1).select(quality.status_mark(F.lit(pct)).alias("m")).first()["m"] == mark


def test_rules_from_yaml(tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("stages:\n  - stage: s\n    table: t\n    checks:\n      - {name: a, dimension: validity, rule: in_set, column: c, values: [X, Y], threshold: 0.5, description: ignored}\n      - {name: b, dimension: consistency, rule: column_sum_equals, sum_source_column: items_json, target_column: total, threshold: 1.0}\n")
    rules = quality.load_rules(str(path))["s"]
    assert rules[0].values == ("X", "Y") and rules[1].target_column == "total"


# --- monitor -----------------------------------------------------------------


@pytest.mark.parametrize("z, band", [(3.0, "⚠ WARNING"), (3.001, "✗ ANOMALY"), (-3.1, "✗ ANOMALY"), (2.0, "✓ NORMAL"), (2.001, "⚠ WARNING"), (None, "✓ NORMAL")])
def test_bands(spark, z, band):
    assert spark.range(1).select(monitor.status(F.lit(z).cast("double")).alias("s")).first()["s"] == band


def test_baseline_is_eight_days_and_needs_spread(spark):
    days = [(datetime(2024, 1, 1) + timedelta(days=i)).date() for i in range(12)]
    flat = spark.createDataFrame([("t", d, "row_count", 10.0) for d in days], "table_name string, partition_date date, metric_name string, metric_value double")
    assert all(r["z_score"] is None and not r["anomaly_detected"] for r in monitor.scored(flat, F.lit(NOW)).collect())
    values = [1000.0, *[10.0, 12.0] * 4, 11.0, 10.0, 99.0]
    df = spark.createDataFrame([("t", d, "row_count", v) for d, v in zip(days, values, strict=True)], flat.schema)
    last = monitor.scored(df, F.lit(NOW)).orderBy(F.desc("partition_date")).first()
    assert last["anomaly_detected"] and last["baseline_7d_avg"] == pytest.approx(sum(values[3:11]) / 8)


def test_failing_table_is_isolated(spark):
    def broken():
        raise OSError("gone")

    good = spark.createDataFrame([(NOW, 1.0)], "ts timestamp, v double")
    rows, failed = monitor.run_monitor({"a": (lambda: good, "ts", ["v"]), "b": (broken, "ts", [])}, F.lit(NOW))
    assert {r["table_name"] for r in rows.collect()} == {"a"} and failed == {"b": "gone"}


# --- drift, Avro, contracts --------------------------------------------------


def f(i, name, kind):
    return drift.Field(i, name, kind)


@pytest.mark.parametrize("old, new, want", [
    ([f(1, "a", "int")], [f(1, "a", "int")], []),
    ([f(1, "a", "int")], [f(1, "a", "int"), f(2, "b", "int")], [("COLUMN_ADDED", "info", True)]),
    ([f(1, "a", "int"), f(2, "b", "int")], [f(1, "a", "int")], [("COLUMN_DROPPED", "warning", True)]),
    ([f(1, "a", "int")], [f(1, "z", "int")], [("RENAME", "info", True)]),
    ([f(1, "a", "int")], [f(1, "a", "bigint")], [("TYPE_CHANGED", "warning", True)]),
    ([f(1, "a", "bigint")], [f(1, "a", "int")], [("TYPE_CHANGED", "error", False)]),
    ([f(1, "a", "decimal(9,2)")], [f(1, "a", "decimal(12,2)")], [("TYPE_CHANGED", "warning", True)]),
    ([f(1, "a", "decimal(9,2)")], [f(1, "a", "decimal(12,3)")], [("TYPE_CHANGED", "error", False)]),
    ([f(1, "a", "int")], [f(1, "z", "bigint")], [("TYPE_CHANGED", "warning", True)]),
])
def test_drift(old, new, want):
    assert [(e[2], e[3], e[9]) for e in drift.diff("t", old, new, NOW)] == want


def test_drift_detection_keeps_snapshots(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "schemas"))
    first = drift.with_ids(T.StructType([T.StructField("a", T.IntegerType())]))
    second = drift.with_ids(T.StructType([*first.fields, T.StructField("b", T.StringType())]))
    assert drift.detect(spark, table, "t", first, NOW) == []
    assert [e[2] for e in drift.detect(spark, table, "t", second, NOW + timedelta(hours=1))] == ["COLUMN_ADDED"]
    assert drift.detect(spark, table, "t", second, NOW + timedelta(hours=2)) == []


def record(*fields):
    return {"type": "record", "name": "r", "fields": list(fields)}


def test_avro_to_struct(spark):
    schema = record({"name": "id", "type": {"type": "string", "logicalType": "uuid"}}, {"name": "at", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "v", "type": "string", "default": "1.0"}, {"name": "n", "type": ["null", "int"], "default": None}, {"name": "xs", "type": {"type": "array", "items": record({"name": "q", "type": "int"})}}, {"name": "op", "type": {"type": "enum", "name": "o", "symbols": ["A"]}})
    assert avro.to_struct(schema).simpleString() == "struct<id:string,at:timestamp,v:string,n:int,xs:array<struct<q:int>>,op:string>"
    assert avro.enum_values(schema, "op") == ["A"]
    raw = spark.createDataFrame([('{"id": "x", "xs": [{"q": 3}], "op": "A"}',)], "value string")
    row = avro.decoded(raw, schema).first()
    assert (row["id"], row["v"], row["n"], row["xs"][0]["q"]) == ("x", "1.0", None, 3)
    with pytest.raises(ValueError):
        avro.to_struct(record({"name": "m", "type": {"type": "map", "values": "int"}}))


def test_backward_transitive():
    v1 = record({"name": "a", "type": "int"})
    v2 = record({"name": "a", "type": "long"}, {"name": "b", "type": "string", "default": ""})
    v3 = record({"name": "z", "type": "long", "aliases": ["a"]})
    assert avro.check_backward_transitive([v1, v2, v3]) == []
    assert avro.check_backward_transitive([v1, record({"name": "a", "type": "string"})]) == ["version 2 reading version 1: a: int became string"]
    assert avro.check_backward_transitive([v1, record({"name": "b", "type": "int"})]) == ["version 2 reading version 1: b: new field without a default"]


def test_contract_checks(tmp_path):
    (tmp_path / "order.avsc").write_text(json.dumps(record({"name": "a", "type": "int"})))
    product = {"source": {"schema": "order.avsc", "kafka_retention_days": 30}, "slas": {"gold_freshness": {}}, "gold_tables": [{"name": "g"}], "dead_letter": {"retention_days": 90}}
    assert contracts.validate(product, tmp_path, {"g"}) == []
    assert len(contracts.validate({**product, "slas": {}, "source": {"schema": "none.avsc"}}, tmp_path, set())) == 3
    assert contracts.retention_days(product) == {"topic": 30, "dead_letters": 90}


def test_gold_meets_its_contract(spark, sf_dir):
    from siltstone.plans import order_events

    view = gold.contract_view(order_events.gold_summary(spark, sf_dir))
    assert contracts.conform(view, gold.DAILY_SUMMARY) is view
    with pytest.raises(ValueError):
        contracts.conform(view.drop("currency"), gold.DAILY_SUMMARY)


# --- snapshots ---------------------------------------------------------------


def test_snapshot_table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        t.read()
    ids = lambda df: sorted(r["id"] for r in df.collect())
    t.commit(spark.range(3), committed_at="2024-01-01T00:00:00")
    t.commit(spark.range(3, 5).withColumn("extra", F.lit("x")), committed_at="2024-01-03T00:00:00", transaction=("stream", 7))
    assert t.commit(spark.range(9), transaction=("stream", 7)) is None and t.commit(spark.range(9), transaction=("stream", 6)) is None
    assert ids(t.read()) == [0, 1, 2, 3, 4] and t.read().columns == ["id", "extra"]
    assert ids(t.read(as_of="2024-01-02T00:00:00")) == [0, 1, 2]
    with pytest.raises(LookupError):
        t.read(as_of="2023-12-31T00:00:00")
    t.commit(spark.range(1), mode="replace", committed_at="2024-01-05T00:00:00")
    assert ids(t.read()) == [0]
    t.rollback(1)
    assert ids(t.read()) == [0, 1, 2, 3, 4]
    t.compact(1)
    assert ids(t.read()) == [0, 1, 2, 3, 4] and len(t.current().folders) == 1
    assert t.expire("2024-01-04T00:00:00") == [0, 1]
    assert ids(t.read()) == [0, 1, 2, 3, 4]
    with pytest.raises(LookupError):
        t.read(number=0)
    with pytest.raises(ValueError):
        t.commit(spark.range(1).select(F.col("id").cast("string").alias("id")))


def test_moved_table_is_readable(spark, tmp_path):
    SnapshotTable(spark, str(tmp_path / "a")).commit(spark.range(2))
    (tmp_path / "a").rename(tmp_path / "b")
    assert SnapshotTable(spark, str(tmp_path / "b")).read().count() == 2


def test_of_two_writers_one_wins(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.commit(spark.range(1))
    taken = t.current()
    taken.number += 1
    assert t._create(taken) and not t._create(taken)


def test_gold_refresh_is_idempotent(spark, tmp_path):
    schema = "order_id string, customer_id string, occurred_at timestamp, currency string, total_amount_cents long, item_count int, _is_valid boolean"
    rows = [(str(i), str(i % 3), datetime(2024, 1, 1 + i % 4, 5), "EUR", 100 * i, 1, True) for i in range(20)]
    all_rows = spark.createDataFrame(rows, schema)
    t = SnapshotTable(spark, str(tmp_path / "gold"))
    at = F.lit(NOW).cast("timestamp")
    gold.refresh(t, all_rows.where("order_id <> '7'"), all_rows.where("order_id <> '7'"), at)
    for _ in range(2):
        gold.refresh(t, all_rows, all_rows.where("order_id = '7'"), at)
    want = gold.contract_view(gold.daily_summary(all_rows, at))
    assert sorted(t.read().collect()) == sorted(want.collect())


# --- lineage, service levels, change data ------------------------------------


def test_emitter_records_runs(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "events"))
    posted = []

    def post(row):
        posted.append(row["event_type"])
        raise OSError("no network")

    e = lineage.Emitter(spark, t.commit, "ns", "job", lineage.SILVER_TO_GOLD, post)
    with e.run("r1") as counts:
        counts["read"], counts["written"] = 10, 9
    with pytest.raises(ValueError), e.run("r2"):
        raise ValueError("boom")
    rows = {(r["run_id"], r["event_type"]): r for r in t.read().collect()}
    assert set(rows) == {("r1", "START"), ("r1", "COMPLETE"), ("r2", "START"), ("r2", "FAIL")} and posted == ["START", "COMPLETE", "START", "FAIL"]
    assert rows["r2", "FAIL"]["error_message"] == "boom" and rows["r1", "COMPLETE"]["row_count_output"] == 9
    assert lineage.backward_trace(t.read(), "p95_order_cents").count() == 1


def test_burn_rates(spark):
    assert slo.error_budget_minutes() == pytest.approx(43.2)
    minutes = spark.createDataFrame([(NOW - timedelta(minutes=m), m >= 60 or m % 2 == 0) for m in range(360)], "at timestamp, good boolean")
    got = {r["window_hours"]: (r["burn_rate"], r["firing"]) for r in slo.burn_rates(minutes, F.lit(NOW)).collect()}
    assert got[1] == (pytest.approx(500), True) and got[6] == (pytest.approx(1000 * 30 / 360, abs=1e-3), True)


def test_availability_of_nothing(spark):
    assert slo.availability(spark.createDataFrame([], "at timestamp, lag_seconds int")).first()["availability_pct"] is None


def test_envelopes(spark):
    image = (5, 1, "w", None)
    rows = [("1", "INSERT", NOW, "s", None, image, ("d", "s", "t", 1, None, "c")), ("2", "UPDATE", NOW, "s", image, (7, 1, "w", None), ("d", "s", "t", 2, None, "c")), ("3", "DELETE", NOW, "x", image, None, ("d", "s", "t", 9, None, "c")), ("4", "READ", NOW, "x", None, image, ("d", "s", "t", 3, None, "c")), ("5", "NOPE", NOW, "y", None, None, None), ("6", "INSERT", NOW, "y", image, image, None)]
    df = spark.createDataFrame(rows, cdc.INVENTORY_UPDATED)
    verdict = {r["event_id"]: r["v"] for r in df.select("event_id", cdc.invalid_envelope(F.col("operation"), F.col("before"), F.col("after")).alias("v")).collect()}
    assert verdict == {"1": None, "2": None, "3": None, "4": None, "5": "unknown_operation", "6": "unexpected_image"}
    state = cdc.latest_state(cdc.unwrap(df.where("event_id < '5'")), ["sku"], F.col("lsn")).collect()
    assert [(r["sku"], r["quantity_on_hand"]) for r in state] == [("s", 7)]


def test_bad_records_go_to_dead_letters(spark):
    good, dead = cdc.parsed(spark.createDataFrame([('{"a": 1}',), ("{oops",), (None,)], "value string"), T.StructType([T.StructField("a", T.IntegerType())]))
    assert [r["a"] for r in good.collect()] == [1]
    assert [(r["failure_reason"], r["failure_stage"]) for r in dead.collect()] == [("schema_mismatch", "bronze_validation")] * 2


def test_field_ids_survive_a_rename(spark, tmp_path):
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    try:
        old = drift.with_ids(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())]))
        spark.createDataFrame([(1, "x")], old).write.parquet(str(tmp_path / "p"))
        fields = [T.StructField("renamed", T.LongType(), True, old[0].metadata), T.StructField("new", T.StringType(), True, {drift.FIELD_ID: 9})]
        assert spark.read.schema(T.StructType(fields)).parquet(str(tmp_path / "p")).collect() == [(1, None)]
    finally:
        spark.conf.unset("spark.sql.parquet.fieldId.read.enabled")


def test_replace_never_loses_an_append(spark, tmp_path):
    """An append between the base of a replace and its commit makes the replace fail, and compaction too."""
    from siltstone.sources.snapshots import CommitConflict, SnapshotTable

    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.commit(spark.range(10))
    base = table.current().number
    table.commit(spark.range(10, 15))
    with pytest.raises(CommitConflict):
        table.commit(spark.range(3), mode="replace", base=base)
    assert table.read().count() == 15

    class Disturbed(SnapshotTable):
        def commit(self, df, **options):
            SnapshotTable(self.spark, self.path).commit(self.spark.range(100, 105))
            return super().commit(df, **options)

    with pytest.raises(CommitConflict):
        Disturbed(spark, table.path).compact()
    assert table.read().count() == 20
    table.compact()
    assert sorted(r["id"] for r in table.read().collect()) == [*range(15), *range(100, 105)]
    assert not [x for x in (tmp_path / "t" / "_log").iterdir() if "tmp" in x.name and not x.name.endswith(".crc")]


def test_time_bounded_join_in_buckets(spark):
    """Every pair within the bound once, also over bucket borders and before 1970."""
    import datetime

    from siltstone.streaming import windows

    zero = datetime.datetime(1969, 12, 31, 20)
    left = [(1, zero + datetime.timedelta(minutes=37 * k)) for k in range(60)]
    right = [(1, zero + datetime.timedelta(minutes=53 * k, seconds=k)) for k in range(60)]
    for kind in ("timestamp", "timestamp_ntz"):
        a = spark.createDataFrame(left, "u long, t timestamp_ntz").withColumn("t", F.col("t").cast(kind))
        b = spark.createDataFrame(right, "u long, s timestamp_ntz").withColumn("s", F.col("s").cast(kind))
        got = windows.time_bounded_join(a, b, "u", "t", "s", "2 HOURS").select("t", "s").count()
        assert got == sum(datetime.timedelta(0) <= y - x <= datetime.timedelta(hours=2) for _, x in left for _, y in right)


def test_lineage_reaches_through_any_number_of_jobs(spark, monkeypatch):
    """A chain of 14 columns that ends in a cycle."""
    from siltstone.operators import lineage

    pairs = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(14)] + [("c14", "c0")], "source_field string, output_column string")
    monkeypatch.setattr(lineage, "edges", lambda events: pairs)
    got = {r["column"]: r["hops"] for r in lineage.reachable(pairs, "c0").collect()}
    assert got == {**{f"c{k}": k for k in range(1, 15)}, "c0": 15}


def test_retention_and_orphans(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    old, new = datetime(2020, 1, 1, tzinfo=UTC), datetime.now(UTC) + timedelta(days=30)
    table.commit(spark.range(3).toDF("id"), committed_at=old)
    table.commit(spark.range(5).toDF("id"), mode="replace", committed_at=new - timedelta(days=200))
    table.commit(spark.range(2).toDF("id"), committed_at=new - timedelta(days=1))
    spark.range(9).write.parquet(f"{table.path}/data/left_behind")
    assert table.remove_orphans(datetime.now(UTC) - timedelta(hours=1)) == []  # it may belong to a commit under way
    assert table.maintain("silver", new) == ([0], ["data/left_behind"])
    assert table.maintain("silver", new) == ([], [])
    assert table.read().count() == 7 and table.maintain("bronze", new)[0] == [1] and table.read().count() == 7
