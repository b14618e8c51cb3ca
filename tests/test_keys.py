from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from sedimenta.config import BridgeLookup, KeyLookup, MasterLookup, RunContext
from sedimenta.functions.text import natural_key
from sedimenta.operators.foreign_keys import resolve_foreign_keys
from sedimenta.operators.surrogate import ensure_key_table, generate_surrogate_keys, number_distinct

CTX = RunContext("2024-02-01 00:00:00")


def numbers(df):
    return [r[0] for r in df.orderBy("SURROGATE_KEY").select("SURROGATE_KEY").collect()]


def test_first_key_depends_on_the_default_member(spark):
    source = spark.range(5).withColumnRenamed("id", "k")
    seeded = generate_surrogate_keys(source, ensure_key_table(spark, CTX), ["k"], "D", CTX)
    bare = generate_surrogate_keys(source, ensure_key_table(spark, CTX, seed=False), ["k"], "D", CTX)
    assert numbers(seeded) == [0, 1, 2, 3, 4] and numbers(bare) == [1, 2, 3, 4, 5]


def test_numbering_continues_over_all_domains(spark):
    keys = ensure_key_table(spark, CTX)
    keys = keys.unionByName(
        generate_surrogate_keys(spark.range(5).withColumnRenamed("id", "k"), keys, ["k"], "A", CTX)
    )
    more = generate_surrogate_keys(spark.range(3).withColumnRenamed("id", "k"), keys, ["k"], "B", CTX)
    assert numbers(more) == [5, 6, 7]
    none = generate_surrogate_keys(spark.range(3).withColumnRenamed("id", "k"), keys, ["k"], "A", CTX)
    assert none.count() == 0
    assert {r[0] for r in more.select("CREATED_BY").collect()} == {"ETL_KEY_GEN_B"}


def test_null_part_makes_a_composite_key_null(spark):
    df = spark.createDataFrame([(" a ", "b"), ("a", None), (None, "b")], "x string, y string")
    assert rows(df.select(natural_key(df, ["x", "y"]))) == [("a~|~b",), (None,), (None,)]
    fresh = generate_surrogate_keys(df, ensure_key_table(spark, CTX, seed=False), ["x", "y"], "D", CTX)
    assert rows(fresh.select("SURROGATE_KEY", "NATURAL_KEY_VALUE")) == [(1, "a~|~b")]


def test_key_text_forms(spark):
    df = spark.createDataFrame([("A " + "x" * 400, 1.5)], "t string, d double")
    single, composite = df.select(natural_key(df, ["t"], cut=True), natural_key(df, ["t", "d"], cut=True)).first()
    assert len(single) == 255 and composite == "A " + "x" * 98 + "~|~1.500000"
    single, composite = df.select(natural_key(df, ["t"]), natural_key(df, ["t", "d"])).first()
    assert single == "A " + "x" * 400 and composite == "A " + "x" * 400 + "~|~1.500000"
    df = spark.createDataFrame([("Ab  ",)], "t string")
    assert df.select(natural_key(df, ["t"], normalise=True)).first()[0] == "AB"


def test_positions_equal_dense_rank(spark):
    values = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("v"))
    want = list(enumerate(sorted(r[0] for r in values.collect()), start=1))
    numbered = number_distinct(values, "v")
    assert [tuple(r) for r in numbered.orderBy("v").select("position", "v").collect()] == want


def test_no_values_give_no_positions(spark):
    none = spark.range(0).select(F.col("id").alias("v"))
    assert number_distinct(none, "v").count() == 0


def test_bridge_takes_the_smallest_key(spark):
    keys = spark.createDataFrame(
        [(9, "p1", "D"), (4, "p2", "D"), (1, "p2", "OTHER")],
        "SURROGATE_KEY long, NATURAL_KEY_VALUE string, NATURAL_KEY_DOMAIN string",
    )
    bridge = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "p3")], "b long, p string")
    child = spark.createDataFrame([(1,), (2,), (3,)], "b long")
    fks = [
        BridgeLookup("VIA", "b", bridge, "b", ["p"], keys, "D"),
        KeyLookup("OWN", ["b"], keys, "D"),
    ]
    assert rows(resolve_foreign_keys(child, fks)) == [(1, 4, -1), (2, -1, -1), (3, -1, -1)]
    many = spark.range(3000).select(F.when(F.col("id") > 1000, 1).otherwise(2).cast("long").alias("b"))
    salted = resolve_foreign_keys(many, fks[:1]).groupBy("b", "VIA").count()
    assert rows(salted) == [(1, 4, 1999), (2, -1, 1001)]


def test_long_keys_stay_apart(spark):
    df = spark.createDataFrame([("k" * 255 + "a",), ("k" * 255 + "b",)], "k string")
    table = ensure_key_table(spark, CTX, seed=False)
    assert generate_surrogate_keys(df, table, ["k"], "D", CTX).count() == 2
    assert generate_surrogate_keys(df, table, ["k"], "D", CTX, cut=True).count() == 1


def test_parent_with_an_unknown_key_gives_one_row(spark):
    parent = spark.createDataFrame([("p", -1), ("p", 7), ("q", -1)], "pk string, sk long")
    child = spark.createDataFrame([("p",), ("q",), (None,)], "fk string")
    fk = MasterLookup("P_SK", "fk", parent, "pk", "sk")
    assert rows(resolve_foreign_keys(child, [fk])) == [("p", 7), ("q", -1), (None, -1)]
