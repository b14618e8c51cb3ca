"""View texts, type names and spark types."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions import viewtext
from sedimenta.functions.types import spark_type, type_name
from sedimenta.operators import lineage

SOURCES = [
    ("SELECT * FROM a.t1, t2 x, b.t3 AS y WHERE x.i = 1", {("A", "T1"), (None, "T2"), ("B", "T3")}),
    ("SELECT * FROM a.t1 LEFT OUTER JOIN a.t2 ON t1.x = t2.x", {("A", "T1"), ("A", "T2")}),
    ("SELECT * FROM cat.a.t1", {("A", "T1")}),
    ('SELECT * FROM "My Db"."My Table"', {("MY DB", "MY TABLE")}),
    ("SELECT * FROM (DB.A a JOIN DB.B b ON a.x = b.x)", {("DB", "A"), ("DB", "B")}),
    ("SELECT * FROM DB.Kündigung k, DB.\"a,b\" AS c, DB.\"a.b\"", {("DB", "KÜNDIGUNG"), ("DB", "A,B"), ("DB", "A.B")}),
    ("SELECT * FROM ((SELECT * FROM a.t1) q JOIN a.t2 ON 1 = 1)", {("A", "T1"), ("A", "T2")}),
    ("SELECT 'it''s FROM x.y' FROM a.t1 -- FROM b.no\n", {("A", "T1")}),
    ("SELECT EXTRACT(DAY FROM d), TRIM(BOTH ' ' FROM n) FROM a.t1", {("A", "T1")}),
    ("SELECT * FROM (SELECT * FROM a.inner_t) q", {("A", "INNER_T")}),
    ("SELECT * FROM TABLE(f(1)) t", set()),
    ("WITH c AS (SELECT * FROM a.t1), d (x) AS (SELECT x FROM c) SELECT * FROM c JOIN d ON 1 = 1", {("A", "T1")}),
    ("SELECT * FROM v JOIN self.v ON 1 = 1 JOIN other.v ON 1 = 1", {("OTHER", "V")}),
    ("SELECT a FROM x.t UNION ALL SELECT b FROM x.u", {("X", "T"), ("X", "U")}),
    ("", set()),
]


@pytest.mark.parametrize("number", range(len(SOURCES)))
def test_sources(spark, number):
    ddl, want = SOURCES[number]
    df = spark.createDataFrame([(1, "SELF", "V", ddl)], "view_id long, db_name string, view_name string, ddl string")
    assert {tuple(r) for r in lineage.view_sources(df).select("source_db", "source_name").collect()} == want


def test_texts_that_may_miss_sources(spark):
    texts = [
        (1, "SELECT * FROM (SELECT a FROM DB.P) s, DB.Q"),
        (2, "SELECT * FROM DB.P p, (SELECT a FROM DB.Q) s (x), DB.R"),
        (3, "SELECT * FROM DB.P p, DB.Q q"),
        (4, "SELECT f(x) y, z FROM (SELECT a FROM DB.P) s WHERE z IN (1, 2)"),
        (5, None),
    ]
    df = spark.createDataFrame(texts, "view_id long, ddl string")
    assert sorted(rows(lineage.unread_views(df))) == [(1,), (2,)]


def test_long_literal_does_not_overflow(spark):
    ddl = "SELECT '" + "x''" * 50_000 + "' AS big, a FROM db.t -- " + "y" * 100_000
    df = spark.createDataFrame([(1, "D", "V", ddl)], "view_id long, db_name string, view_name string, ddl string")
    assert rows(lineage.view_sources(df)) == [(1, "DB", "T")]
    items = spark.createDataFrame([(1, 1, "'" + "x''" * 50_000 + "'", "big"), (1, 2, "a", "a")], "view_id long, position int, expression string, target_column string")
    mapped = lineage.view_columns(df, items).orderBy("position").collect()
    assert [(r["target_column"], r["transform_type"], len(r["sources"])) for r in mapped] == [("big", "COMPUTED", 0), ("a", "DIRECT", 1)]


def test_reading_lists_takes_time_in_proportion(spark):
    text = "SELECT * FROM " + "(SELECT a FROM (SELECT b FROM " * 20_000
    df = spark.createDataFrame([(1, text), (2, text + " (SELECT 1) x, db.t"), (3, None)], "view_id long, ddl string")
    assert rows(lineage.unread_views(df)) == [(2,)]


def test_type_names(spark):
    given = [
        ("DA", None, None, None, "DATE"),
        ("D", None, 10, 0, "DECIMAL(10,0)"),
        ("CV", 0, None, None, "VARCHAR(255) CHARACTER SET UNICODE"),
        ("TIME(15)", None, None, 9, "TIME(6)"),
        ("NVARCHAR(5) CHARACTER SET LATIN", None, None, None, "NVARCHAR(5) CHARACTER SET LATIN"),
        ("PERIOD(DATE)", None, None, None, "PERIOD(DATE)"),
    ]
    df = spark.createDataFrame(given, "c string, l int, p int, s int, want string")
    named = df.select("want", type_name(F.col("c"), F.col("l"), F.col("p"), F.col("s")).alias("got"))
    assert named.filter("want <> got").collect() == []


@pytest.mark.parametrize(
    "name, want",
    [
        ("BIGINT", T.LongType()),
        ("DECIMAL(10,0)", T.DecimalType(10, 0)),
        ("NUMBER(7)", T.DecimalType(7, 0)),
        ("DECIMAL", T.DecimalType(18, 2)),
        ("VARCHAR(30) CHARACTER SET UNICODE", T.StringType()),
        ("TIMESTAMP(6)", T.TimestampNTZType()),
        ("TIMESTAMP(6) WITH TIME ZONE", T.TimestampType()),
        ("TIME(3)", T.StringType()),
        ("VARBYTE(20)", T.BinaryType()),
        ("INTERVAL DAY TO SECOND", T.DayTimeIntervalType(0, 3)),
        ("INTERVAL YEAR TO MONTH", T.YearMonthIntervalType(0, 1)),
        ("GEOMETRY", T.StringType()),
    ],
)
def test_spark_types(name, want):
    assert spark_type(name) == want


def test_period_is_a_pair():
    assert spark_type("PERIOD(DATE)").fieldNames() == ["begin", "end"]
