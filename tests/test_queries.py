"""Every sample query against its SQL on a second engine."""

from __future__ import annotations

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from samples.support import ORACLES as SQL
from samples.support import QUERIES, TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    assert {r["action"] for r in entry.entry(spark).collect()} == {"NEW", "CHANGED", "UNCHANGED"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(str(r[i]) for i in order) for r in result.fetchall())
    assert got == want
