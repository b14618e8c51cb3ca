from __future__ import annotations

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sedimenta.config import KEY_TABLE_SCHEMA, Layer, LoadSpec, MasterLookup, RunContext, history_schema
from sedimenta.operators import scd2
from sedimenta.operators.ingest import ColumnMapping, conversion_text, ingest, loaded_rows, rejected_rows
from sedimenta.operators.surrogate import ensure_key_table
from sedimenta.plans.load import LoadCounts, load_delta, load_history, load_with_log, read_runs, read_steps
from sedimenta.sources import workspace
from sedimenta.sources.bucketed import BucketedTable
from sedimenta.sources.jdbc import extract, extract_query
from sedimenta.sources.tables import scan, table_path
from sedimenta.sources.versioned import VersionedTable
from sedimenta.sources.workspace import folder, remove_older, scope, stash

CTX = RunContext("2024-02-01 00:00:00", run_id=3)
LATER = RunContext("2024-03-01 00:00:00", run_id=4)
SPEC = LoadSpec(business_key=["k"], sk_column="K_SK", domain="D")


def test_versions_of_a_history_table(spark, tmp_path):
    source = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    target = VersionedTable(str(tmp_path / "hist"), history_schema(source.schema, "K_SK"))
    keys = str(tmp_path / "keys")
    ensure_key_table(spark, CTX).write.parquet(keys)
    assert target.version(spark) == 0 and target.read(spark).count() == 0

    first = load_history(spark, source, target, SPEC, CTX, keys)
    assert first == LoadCounts(rows_read=2, rows_inserted=2)
    batch = spark.createDataFrame([(1, "x"), (2, "b"), (3, "c")], "k long, v string")
    second = load_history(spark, batch, target, SPEC, LATER, keys)
    assert second == LoadCounts(rows_read=3, rows_inserted=2, rows_updated=1)
    assert target.version(spark) == 2
    assert rows(target.read(spark).select("K_SK", "k", "v", "IS_CURRENT")) == [
        (0, 1, "a", "N"), (0, 1, "x", "Y"), (1, 2, "b", "Y"), (2, 3, "c", "Y"),
    ]
    assert target.closed(spark).count() == 1
    third = load_history(spark, batch, target, SPEC, LATER, keys)
    assert third.rows_inserted == 0 and target.read(spark).count() == 4

    reload = load_history(spark, source, target, SPEC, LATER, keys, initial=True)
    assert reload.rows_inserted == 2
    assert rows(target.read(spark).select("K_SK", "k", "IS_CURRENT")) == [(0, 1, "Y"), (1, 2, "Y")]
    assert spark.read.schema(KEY_TABLE_SCHEMA).parquet(keys).count() == 4


def test_empty_load_publishes_an_empty_version(spark, tmp_path):
    none = spark.createDataFrame([], "k long, v string")
    target = VersionedTable(str(tmp_path / "hist"), history_schema(none.schema, None))
    spec = LoadSpec(business_key=["k"], surrogate=None)
    assert load_history(spark, none, target, spec, CTX) == LoadCounts()
    assert target.version(spark) == 1 and target.read(spark).count() == 0
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    assert load_history(spark, one, target, spec, LATER).rows_inserted == 1
    assert target.current(spark).count() == 1 and target.closed(spark).count() == 0


def test_two_layers(spark, tmp_path):
    """RAW file to a discoverable history, then to a reusable one with keys from the view."""
    raw = table_path(str(tmp_path), Layer.RAW, "person")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(raw)
    staging = scan(spark, str(tmp_path), Layer.RAW, "person", ["k", {"name": "v", "expression": "upper(v)"}])
    disc = VersionedTable(table_path(str(tmp_path), Layer.DISCOVERABLE, "person"), history_schema(staging.schema, "K_SK"))
    keys = str(tmp_path / "keys")
    ensure_key_table(spark, CTX, seed=False).write.parquet(keys)
    load_history(spark, staging, disc, SPEC, CTX, keys)

    view = disc.current(spark).select("K_SK", "k", "v")
    spec = LoadSpec(business_key=["k"], columns=["k", "v"], surrogate="staging", sk_column="K_SK", close_mode="not_closed")
    reus = VersionedTable(table_path(str(tmp_path), Layer.REUSABLE, "person"), disc.schema)
    load_history(spark, view, reus, spec, CTX)
    assert rows(reus.read(spark).select("K_SK", "k", "v")) == [(1, 1, "A"), (2, 2, "B")]


def test_ingest_appends_and_splits(spark, tmp_path):
    source = spark.createDataFrame(
        [("1", "2024-01-05", "3.5"), ("x", "2024-01-05", "1"), (None, "soon", "1"), ("4", None, None)],
        "id string, day string, amount string",
    )
    mapping = [
        ColumnMapping("id", "ID", "BIGINT", nullable=False),
        ColumnMapping("day", "DAY", "DATE"),
        ColumnMapping("amount", "AMOUNT", "DECIMAL(10,2)"),
    ]
    target = str(tmp_path / "raw")
    for ctx in (CTX, CTX, LATER):  # a repeated load replaces its own rows
        counts = ingest(source, mapping, target, ctx, audit=True)
        assert counts == {"rows_read": 4, "rows_loaded": 2, "rows_rejected": 2}
    loaded = loaded_rows(spark, target)
    assert loaded.columns == ["ID", "DAY", "AMOUNT", "ETL_LOAD_ID", "ETL_LOAD_TIMESTAMP", "load_id"]
    assert rows(loaded.select("ID", F.col("DAY").cast("string"), "load_id")) == [
        (1, "2024-01-05", 3), (1, "2024-01-05", 4), (4, None, 3), (4, None, 4),
    ]
    assert rows(rejected_rows(spark, target).select("failed_columns", "load_id")) == [
        ("ID", 3), ("ID", 4), ("ID,DAY", 3), ("ID,DAY", 4),
    ]
    good = source.where("id = '1'")
    assert ingest(good, mapping, target, CTX, audit=True) == {"rows_read": 1, "rows_loaded": 1, "rows_rejected": 0}
    assert rejected_rows(spark, target).where("load_id = 3").count() == 0
    assert ingest(source.limit(0), mapping, target, LATER)["rows_read"] == 0
    assert loaded_rows(spark, target).count() == 1


def test_extract_query():
    columns = [
        ColumnMapping("id", "ID"),
        ColumnMapping("guid", "GUID", convert_expression="CONVERT(VARCHAR({len}), [{col}])", source_length=36),
    ]
    text = "SELECT [id], CONVERT(VARCHAR(36), [guid]) AS guid FROM dbo.person"
    assert extract_query("person", columns) == text
    assert extract_query("hr.person", columns).endswith("FROM hr.person")
    assert extract_query("person", columns, "hr").endswith("FROM hr.person")


def test_unsafe_templates_are_refused():
    for template in ("[{col}]; DROP TABLE x", "[{col}] -- x", "/* */ [{col}]"):
        with pytest.raises(ValueError):
            conversion_text(ColumnMapping("a", "A", convert_expression=template))


def test_partitioned_extract_needs_bounds(spark):
    with pytest.raises(ValueError):
        extract(spark, "jdbc:none", "t", [ColumnMapping("a", "A")], partition_column="a")


def test_log_rows_of_good_and_failed_runs(spark, tmp_path):
    log = str(tmp_path / "log")
    load_with_log(spark, log, 1, 10, [(100, lambda: LoadCounts(5, 3, 1)), (101, LoadCounts)])

    def broken():
        raise RuntimeError("no space")

    with pytest.raises(RuntimeError):
        load_with_log(spark, log, 2, 10, [(100, broken), (101, LoadCounts)])
    runs, steps = read_runs(spark, log), read_steps(spark, log)
    assert rows(runs.select("run_id", "status", "error_message")) == [
        (1, "SUCCESS", None), (2, "FAILED", "no space"),
    ]
    assert rows(steps.select("run_id", "step_id", "status", "rows_inserted")) == [
        (1, 100, "SUCCESS", 3), (1, 101, "SUCCESS", 0), (2, 100, "FAILED", 0),
    ]


def test_counts_are_rows_written(spark, tmp_path):
    """Repeated rows, a parent with two keys and a row without a key; the key table is new."""
    parent = spark.createDataFrame([("p", -1), ("p", 7)], "pk string, sk long")
    spec = LoadSpec(
        business_key=["k"], sk_column="K_SK", domain="D", null_keys="reject",
        foreign_keys=[MasterLookup("P_SK", "fk", parent, "pk", "sk")],
    )
    source = spark.createDataFrame([(1, "a", "p")], "k long, v string, fk string")
    columns = spark.createDataFrame([], "k long, v string, fk string, P_SK long").schema
    target, keys = VersionedTable(str(tmp_path / "hist"), history_schema(columns, "K_SK")), str(tmp_path / "keys")
    assert load_history(spark, source, target, spec, CTX, keys) == LoadCounts(1, 1, 0)
    batch = [(1, "x", "p"), (1, "x", "p"), (2, "b", "p"), (None, "n", "p")]
    batch = spark.createDataFrame(batch, "k long, v string, fk string")
    assert load_history(spark, batch, target, spec, LATER, keys) == LoadCounts(4, 2, 1)
    assert target.read(spark).count() == 3


def test_run_is_logged_before_its_steps(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []

    def step():
        seen.append(rows(read_runs(spark, log).select("run_id", "status")))
        return LoadCounts(1, 1)

    clock = lambda: datetime(2024, 2, 1)
    load_with_log(spark, log, 5, 10, [(100, step)], now=clock)
    assert seen == [[(5, "RUNNING")]]
    run = read_runs(spark, log).select("run_id", "status", "end_time").collect()
    assert [tuple(r) for r in run] == [(5, "SUCCESS", datetime(2024, 2, 1))]


def test_a_run_goes_on_behind_its_last_good_step(spark, tmp_path):
    log, calls = str(tmp_path / "log"), []
    ticks = iter(datetime(2024, 2, 1, 0, 0, s) for s in range(60))

    def step(name, fails=False):
        def run():
            calls.append(name)
            if fails and calls.count(name) == 1:
                raise RuntimeError("lost")
            return LoadCounts(rows_read=len(calls))

        return run

    steps = [(1, step("a")), (2, step("b", fails=True)), (3, step("c"))]
    with pytest.raises(RuntimeError):
        load_with_log(spark, log, 9, 1, steps, now=lambda: next(ticks))
    assert rows(read_runs(spark, log).select("status")) == [("FAILED",)]
    for _ in range(2):
        assert load_with_log(spark, log, 9, 1, steps, now=lambda: next(ticks)) == "SUCCESS"
    assert calls == ["a", "b", "b", "c"]
    assert rows(read_steps(spark, log).select("step_id", "status", "rows_read")) == [(1, "SUCCESS", 1), (2, "SUCCESS", 3), (3, "SUCCESS", 4)]
    assert rows(read_runs(spark, log).select("run_id", "status")) == [(9, "SUCCESS")]


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def _buckets(spark, tmp_path, **kw):
    source = spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    spec = LoadSpec(business_key=["k"], surrogate=None)
    target = BucketedTable(str(tmp_path / "hist"), history_schema(source.schema, None), ["k"], **kw)
    assert load_delta(spark, source, target, spec, RunContext("2024-01-01 00:00:00", run_id=1)) == LoadCounts(200, 200, 0)
    return target, spec


def test_only_touched_buckets_are_written(spark, tmp_path):
    target, spec = _buckets(spark, tmp_path, buckets=20, width=10)
    before = _files(tmp_path / "hist" / "open")
    batch = spark.createDataFrame([(11, "x"), (12, "a"), (13, "y"), (57, "a"), (500, "new"), (None, "n")], "k long, v string")
    assert load_delta(spark, batch, target, spec, CTX) == LoadCounts(6, 4, 2)
    after = _files(tmp_path / "hist" / "open")
    kept = {f for f in before if after.get(f) == before[f]}
    assert {f.split("/")[0] for f in after if f not in kept} == {"key_bucket=1", "key_bucket=10"}
    assert len(kept) == len(before) - 2
    assert rows(target.closed(spark).select("k", "v", "IS_CURRENT")) == [(11, "a", "N"), (13, "a", "N")]
    assert target.current(spark).count() == 202 and target.keyless(spark).count() == 1


def test_buckets_equal_a_full_rewrite(spark, tmp_path):
    target, spec = _buckets(spark, tmp_path, buckets=7)
    plain = VersionedTable(str(tmp_path / "plain"), target.schema)
    load_history(spark, spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")), plain, spec, RunContext("2024-01-01 00:00:00", run_id=1))
    for ctx, items in ((CTX, [(1, "b"), (2, "a"), (300, "c"), (300, "c"), (None, "d")]), (LATER, [(1, "c"), (300, "a"), (None, "d")])):
        batch = spark.createDataFrame(items, "k long, v string")
        assert load_delta(spark, batch, target, spec, ctx) == load_history(spark, batch, plain, spec, ctx)
        assert rows(target.read(spark)) == rows(plain.read(spark))
    assert load_delta(spark, batch, target, spec, LATER) == LoadCounts(3, 3, 2)  # through already
    assert rows(target.read(spark)) == rows(plain.read(spark))
    again = load_delta(spark, batch, target, spec, RunContext("2024-04-01 00:00:00", run_id=5), initial=True)
    assert again == LoadCounts(3, 3, 0) and target.read(spark).count() == 3


@pytest.mark.parametrize("stop", ["open", "half", "log"])
def test_a_load_that_died_is_completed(spark, tmp_path, monkeypatch, stop):
    """Killed before the open rows, in the middle of their buckets, and before its marker."""
    target, spec = _buckets(spark, tmp_path, buckets=6)
    batch = spark.range(0, 250, 2).select(F.col("id").alias("k"), F.lit("b").alias("v"))
    write = BucketedTable._write

    def dies(self, rows_, part, *by):
        if part == "open" and stop == "half":
            write(self, rows_.where("key_bucket < 3"), part, *by)
        if part == stop or (part, stop) in (("open", "half"), ("loads", "log")):
            raise RuntimeError("killed")
        write(self, rows_, part, *by)

    monkeypatch.setattr(BucketedTable, "_write", dies)
    with pytest.raises(RuntimeError):
        load_delta(spark, batch, target, spec, CTX)
    monkeypatch.setattr(BucketedTable, "_write", write)
    load_delta(spark, batch, target, spec, CTX)
    got = rows(target.read(spark).select("k", "v", "IS_CURRENT"))
    want = [(k, "a", "N" if k % 2 == 0 else "Y") for k in range(200)] + [(k, "b", "Y") for k in range(0, 250, 2)]
    assert got == sorted(want, key=repr)


def test_buckets_need_a_run_and_their_key(spark, tmp_path):
    target, spec = _buckets(spark, tmp_path, buckets=2)
    batch = spark.createDataFrame([(1, "b")], "k long, v string")
    with pytest.raises(ValueError):
        load_delta(spark, batch, target, spec, RunContext("2024-02-01 00:00:00"))
    with pytest.raises(ValueError):
        load_delta(spark, batch, target, LoadSpec(business_key=["v"], surrogate=None), CTX)


def test_history_of_another_form_is_adopted(spark, tmp_path):
    target, spec = _buckets(spark, tmp_path, buckets=5)
    load_delta(spark, spark.createDataFrame([(1, "b"), (None, "n")], "k long, v string"), target, spec, CTX)
    other = BucketedTable(str(tmp_path / "other"), target.schema, ["k"], buckets=3)
    other.adopt(target.read(spark), scd2.open_rows(target.read(spark), spec))
    assert rows(other.read(spark)) == rows(target.read(spark))
    assert other.closed(spark).count() == 1 and other.keyless(spark).count() == 1


def test_finished_loads_leave_no_folder(spark, tmp_path, monkeypatch):
    root = tmp_path / "checkpoint"
    monkeypatch.setattr(workspace, "_root", lambda _: str(root))
    _buckets(spark, tmp_path, buckets=4)
    assert list(root.iterdir()) == []
    with pytest.raises(ZeroDivisionError), scope(spark):
        assert stash(spark.range(3)).count() == 3
        raise ZeroDivisionError
    assert list(root.iterdir()) == []
    spark.range(1).write.parquet(folder(spark, "lost"))
    assert remove_older(spark, 1) == 0
    assert remove_older(spark, -1) == 1 and remove_older(spark, -1) == 0
