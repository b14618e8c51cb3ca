from __future__ import annotations

import random
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sedimenta.config import Action, LoadSpec, MasterLookup, RunContext, Scd2Config, history_schema
from sedimenta.functions.text import record_hash
from sedimenta.operators import scd2
from sedimenta.operators.foreign_keys import resolve_foreign_keys
from sedimenta.operators.keyed_join import one_per_key, only_keys_of
from sedimenta.operators.merge import merge_from_view
from sedimenta.operators.stats import table_statistics

BATCH = "k long, v string"
SPEC = LoadSpec(business_key=["k"], surrogate=None)
CTX = RunContext("2024-02-01 00:00:00")
LATER = RunContext("2024-03-01 00:00:00")


def batch(spark, *items):
    return spark.createDataFrame(list(items), BATCH)


def empty_history(spark):
    return spark.createDataFrame([], history_schema(batch(spark).schema, None))


def load(spark, history, items, ctx=CTX, spec=SPEC, **kw):
    return scd2.apply(history, batch(spark, *items), spec, ctx, **kw)


def actions(spark, history, items, spec=SPEC, **kw):
    return rows(scd2.classify(batch(spark, *items), history, spec, **kw).select("k", "v", scd2.ACTION))


def test_first_load_and_rerun(spark):
    first = load(spark, empty_history(spark), [(1, "a"), (2, "b")]).history
    assert first.count() == 2
    again = load(spark, first, [(1, "a"), (2, "b")], LATER)
    assert again.inserted.count() == 0 and again.closed.count() == 0
    assert rows(again.history) == rows(first)


def test_change_closes_and_opens_without_gap(spark):
    first = load(spark, empty_history(spark), [(1, "a"), (2, "b")]).history
    second = load(spark, first, [(1, "x")], LATER).history
    versions = rows(second.filter("k = 1").select("v", F.col("VALID_FROM").cast("string"),
                                                   F.col("VALID_TO").cast("string"), "IS_CURRENT"))
    assert versions == [
        ("a", "2024-02-01 00:00:00", "2024-03-01 00:00:00", "N"),
        ("x", "2024-03-01 00:00:00", "9999-12-31 23:59:59.999999", "Y"),
    ]
    # A key missing from the batch stays current.
    assert second.filter("k = 2 AND IS_CURRENT = 'Y'").count() == 1


def test_reopened_key_is_new(spark):
    first = load(spark, empty_history(spark), [(1, "a")]).history
    closed = first.withColumn("IS_CURRENT", F.lit("N"))
    assert actions(spark, closed, [(1, "a")]) == [(1, "a", Action.NEW)]


def test_null_stored_hash_never_changes(spark):
    first = load(spark, empty_history(spark), [(1, "a")]).history
    unknown = first.withColumn("RECORD_HASH", F.lit(None).cast("binary"))
    assert actions(spark, unknown, [(1, "z")]) == [(1, "z", Action.UNCHANGED)]
    # Next to a known hash the unknown one does not hide a change.
    both = first.unionByName(unknown)
    assert actions(spark, both, [(1, "z")]) == [(1, "z", Action.CHANGED)]


def test_null_key_is_new_on_every_run(spark):
    first = load(spark, empty_history(spark), [(None, "a")]).history
    second = load(spark, first, [(None, "a")], LATER)
    assert second.inserted.count() == 1 and second.closed.count() == 0
    rejecting = replace(SPEC, null_keys="reject")
    assert load(spark, first, [(None, "a")], LATER, rejecting).inserted.count() == 0


def test_duplicates_in_a_batch(spark):
    result = load(spark, empty_history(spark), [(1, "a"), (1, "a"), (1, "b")])
    assert rows(result.inserted.select("k", "v", "IS_CURRENT")) == [(1, "a", "Y"), (1, "b", "Y")]


def test_several_current_rows_do_not_multiply(spark):
    twice = load(spark, empty_history(spark), [(1, "a"), (1, "b")]).history
    tagged = actions(spark, twice, [(1, "a"), (1, "b"), (1, "c")])
    assert tagged == [(1, v, Action.CHANGED) for v in "abc"]
    result = load(spark, twice, [(1, "c")], LATER)
    assert result.closed.count() == 2 and result.inserted.count() == 1


def test_empty_batch_changes_nothing(spark):
    first = load(spark, empty_history(spark), [(1, "a")]).history
    assert rows(load(spark, first, []).history) == rows(first)


def test_close_modes(spark):
    first = load(spark, empty_history(spark), [(1, "a")]).history
    odd = first.withColumn("IS_CURRENT", F.lit("X"))
    none = first.withColumn("IS_CURRENT", F.lit(None).cast("string"))
    h = first.unionByName(odd).unionByName(none)
    changed = batch(spark, (1, "b"))
    by_mode = {}
    for mode in ("current", "not_closed"):
        closed = scd2.close_versions(h, changed, replace(SPEC, close_mode=mode), LATER)
        by_mode[mode] = sorted(str(r[0]) for r in closed.select("IS_CURRENT").collect())
    assert by_mode == {"current": ["N", "None", "X"], "not_closed": ["N", "N", "None"]}


def test_parent_versions_do_not_multiply_children(spark):
    parent = spark.createDataFrame([(1, 10, "Y"), (1, 10, "N"), (2, 20, "N")], "bk long, sk long, IS_CURRENT string")
    children = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None)], "k long, bk long")
    fk = MasterLookup("SK_FK", "bk", parent, "bk", "sk")
    from sedimenta.operators.foreign_keys import resolve_foreign_keys

    assert rows(resolve_foreign_keys(children, [fk]).select("k", "SK_FK")) == [(1, 10), (2, 20), (3, -1), (4, -1)]
    current = replace(fk, current_only=Scd2Config())
    assert rows(resolve_foreign_keys(children, [current]).select("k", "SK_FK")) == [(1, 10), (2, -1), (3, -1), (4, -1)]


def test_spec_is_checked():
    with pytest.raises(ValueError):
        LoadSpec(business_key=[])
    with pytest.raises(ValueError):
        LoadSpec(business_key=["k"], close_mode="other")


def test_history_schema_drops_repeated_names(spark):
    source = batch(spark).schema.add("valid_from", "string")
    names = history_schema(source, "K_SK", ["P_SK_FK"]).fieldNames()
    assert names[:4] == ["K_SK", "k", "v", "valid_from"] and names[4] == "P_SK_FK"
    assert "VALID_FROM" not in names and names[-1] == "LAST_UPDATED_BY"


def test_hash_encoding_tells_values_apart(spark):
    df = spark.createDataFrame(
        [(None, "a"), ("a", None), ("", "a"), ("ab", "c"), ("a", "bc"), (None, None)], "x string, y string"
    )
    assert df.select(record_hash(df, ["x", "y"]).alias("h")).distinct().count() == 6


def test_random_loads_follow_a_plain_model(spark):
    rng = random.Random(5)
    history, model = empty_history(spark), []
    for n, ctx in enumerate([CTX, LATER, RunContext("2024-04-01 00:00:00")]):
        items = list({(k, rng.choice("abc")) for k in rng.sample(range(60), 40)})
        history = load(spark, history, items, ctx).history
        for k, v in items:
            open_rows = [m for m in model if m["k"] == k and m["to"] is None]
            if open_rows and all(m["v"] == v for m in open_rows):
                continue
            for m in open_rows:
                m["to"] = n
            model.append({"k": k, "v": v, "from": n, "to": None})
    stamps = {"2024-02-01 00:00:00": 0, "2024-03-01 00:00:00": 1, "2024-04-01 00:00:00": 2}
    got = sorted(
        (r["k"], r["v"], stamps[str(r["VALID_FROM"])], stamps.get(str(r["VALID_TO"]), -1), r["IS_CURRENT"])
        for r in history.collect()
    )
    want = sorted(
        (m["k"], m["v"], m["from"], -1 if m["to"] is None else m["to"], "Y" if m["to"] is None else "N") for m in model
    )
    assert got == want
    total = {r["metric_name"]: r["metric_value"] for r in table_statistics(history).collect()}
    assert total["Total Records"] == total["Current Records"] + total["Historical Records"]


@pytest.fixture
def settings(spark):
    """Session settings for one test."""
    before = {}

    def put(**values):
        for name, value in values.items():
            name = f"spark.sql.{name.replace('__', '.')}"
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_shuffles_lie_directly_under_joins_with_aggregates(spark, settings):
    """That is what lets adaptive execution split a hot or missing key."""
    settings(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    left, right = spark.range(50).withColumnRenamed("id", "k"), spark.range(20).selectExpr("id % 5 AS k", "id")
    joined = left.join(one_per_key(right, ["k"], F.max("id").alias("m")), "k", "left")
    text = [x.strip(" :+-*()0123456789") for x in joined._jdf.queryExecution().executedPlan().toString().splitlines()]
    at = [i for i, x in enumerate(text) if x.startswith("Sort [k")]
    assert len(at) == 2 and all("ENSURE_REQUIREMENTS" in text[i + 1] for i in at)
    assert rows(joined) == rows(left.join(right.groupBy("k").agg(F.max("id").alias("m")), "k", "left"))


def test_hot_and_missing_keys_are_split(spark, settings):
    settings(
        autoBroadcastJoinThreshold="-1", adaptive__advisoryPartitionSizeInBytes="8k",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="8k", adaptive__skewJoin__skewedPartitionFactor="1.5",
    )
    hot = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id"))
    left = spark.range(0, 60_000, 1, 8).select(hot.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    joined = left.join(one_per_key(left, ["k"], F.count("*").alias("n")), "k", "left")
    placed = joined.select("k", "v", "n", F.spark_partition_id().alias("p")).collect()
    assert len({r["p"] for r in placed if r["k"] == 7}) > 1
    assert len({r["p"] for r in placed if r["k"] is None}) > 1
    assert {r["n"] for r in placed if r["k"] == 7} == {20_001}  # and the row of its own


@pytest.mark.parametrize(("kind", "other"), [("long", "int"), ("int", "long"), ("string", "string"), ("double", "long"), ("decimal(9,2)", "int")])
def test_rows_of_wanted_keys_are_never_lost(spark, kind, other):
    rows_ = spark.range(3000).select(F.col("id").cast(kind).alias("k"), "id")
    wanted = spark.range(0, 3000, 7).select(F.col("id").cast(other).alias("k"))
    left = only_keys_of(rows_, ["k"], wanted)
    assert left.columns == ["k", "id"]
    assert left.join(wanted, "k", "left_semi").count() == wanted.count()
    assert wanted.count() <= left.count() < 500
    few = only_keys_of(rows_, ["k"], wanted, words=2)
    assert few.join(wanted, "k", "left_semi").count() == wanted.count()


def test_zeros_and_missing_keys_pass(spark):
    side = spark.createDataFrame([(0.0, 1), (-0.0, 2), (None, 3), (5.0, 4)], "k double, id long")
    wanted = spark.createDataFrame([(-0.0,)], "k double")
    assert rows(only_keys_of(side, ["k"], wanted).select("id")) == [(1,), (2,)]


def test_rows_entering_a_classification_follow_the_batch(spark):
    before = load(spark, empty_history(spark), [(k, "a") for k in range(4000)]).history
    small = batch(spark, (1, "x"), (2, "a"), (9000, "n"))
    text = plan(scd2.classify(small, before, SPEC))
    assert "_bits" in text and text.index("_low0") < text.index("_bits")
    kept = only_keys_of(scd2.current_rows(before).select("k"), ["k"], small)
    assert kept.count() <= 10
    assert rows(scd2.identify_new(small, before, SPEC)) == [(9000, "n")]


def test_no_job_runs_while_plans_are_built(spark):
    before = load(spark, empty_history(spark), [(1, "a"), (2, "b")]).history
    parent = spark.createDataFrame([(1, 10), (1, -1), (2, 20)], "pk long, sk long")
    view = before.withColumn("VIEW_SK", F.lit(1))
    context = spark.sparkContext
    context.setJobGroup("building", "nothing may run")
    try:
        tagged = scd2.classify(batch(spark, (1, "x")), before, SPEC)
        scd2.identify_new(batch(spark, (1, "x")), before, SPEC)
        scd2.mark_closed(before, tagged, SPEC, CTX)
        resolve_foreign_keys(tagged, [MasterLookup("P", "k", parent, "pk", "sk")])
        merge_from_view(view, before, "k", ["v"], "VIEW_SK", "SK", CTX)
        assert context.statusTracker().getJobIdsForGroup("building") == []
    finally:
        context._jsc.clearJobGroup()


def test_plans_of_very_many_partitions(spark, settings):
    settings(shuffle__partitions="200000")
    before = load(spark, empty_history(spark), [(1, "a")], durable=False).rows
    assert "Join" in plan(scd2.classify(batch(spark, (1, "x")), before, SPEC))


def test_load_with_hot_key_equals_plain_load(spark):
    items = [(1, f"v{i}") for i in range(300)] + [(1, "same")] * 300 + [(None, f"n{i}") for i in range(300)]
    items += [(k, "x") for k in range(2, 100)]
    before = load(spark, empty_history(spark), [(1, "a"), (5, "x"), (6, "old")]).history
    plain = load(spark, before, items, LATER)
    lazy = load(spark, before, items, LATER, durable=False)
    assert rows(lazy.history) == rows(plain.history)
    assert actions(spark, before, items) == actions(spark, before, items)


def test_durable_load_equals_lazy_load(spark):
    before = load(spark, empty_history(spark), [(1, "a"), (2, "b")]).history
    lazy = load(spark, before, [(1, "x"), (3, "c")], LATER)
    durable = load(spark, before, [(1, "x"), (3, "c")], LATER, durable=True)
    assert rows(durable.history) == rows(lazy.history)
