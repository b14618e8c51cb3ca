"""Registry of sample queries and the small SQL vocabulary they share.

Inputs that the test tables do not hold (histories, key tables, run logs, catalogues) are
derived from whole test tables by SQL that both engines run; the operators then work on the
Spark frames while the second engine runs its own SQL for the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.config import RunContext
from sedimenta.functions.text import TIMESTAMP_TEXT

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
RUN_TS = "2024-02-01 00:00:00"
AS_OF = "2024-01-30 00:00:00"
CTX = RunContext(run_ts=RUN_TS, user="etl", run_id=7)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FIXTURES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a sample query under its function name, with its SQL if it has any."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_fixtures(sql)
        return fn

    return register


def _used(sql: str) -> list[str]:
    """Fixtures a text refers to, directly or through others, in dependency order."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in found:
                visit(FIXTURES[name])
                found.append(name)

    visit(sql)
    return found


def _ctes(names: list[str]) -> str:
    return ",\n".join(f"{n} AS (\n{FIXTURES[n].strip()}\n)" for n in names)


def with_fixtures(sql: str) -> str:
    """Put the fixtures in front of a text as common table expressions, in the oracle's dialect."""
    names = _used(sql)
    text = sql.strip()
    if names:
        recursive = text.upper().startswith("WITH RECURSIVE")
        body = re.sub(r"(?i)^WITH\s+(RECURSIVE\s+)?", "", text) if text.upper().startswith("WITH") else None
        head = "WITH RECURSIVE " if recursive else "WITH "
        text = head + _ctes(names) + (",\n" + body if body is not None else "\n" + text)
    return text.replace("$TS", "TIMESTAMP")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a Spark frame."""
    names = _used(f"SELECT * FROM {name}")
    text = f"WITH {_ctes(names)} SELECT * FROM {name}".replace("$TS", "TIMESTAMP_NTZ")
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def hash_sql(**columns: str) -> str:
    """Record hash in the oracle's dialect; each keyword gives a column's kind."""
    parts = []
    for name, kind in columns.items():
        text = {
            "text": f"CAST({name} AS VARCHAR)",
            "number": f"CAST(CAST({name} AS DECIMAL(38,6)) AS VARCHAR)",
            "time": f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')",
        }[kind]
        parts.append(f"CASE WHEN {name} IS NULL THEN 'N' ELSE 'V' || length({text}) || ':' || {text} END")
    return "sha256(" + " || ".join(parts) + ")"


def ts_sql(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {alias or column}"


def ts_text(column: str | Column, alias: str | None = None) -> Column:
    """Timestamps leave a query as text, which both engines print alike."""
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, TIMESTAMP_TEXT).alias(alias or column)


def hex_text(column: str, alias: str | None = None) -> Column:
    return F.lower(F.hex(column)).alias(alias or column)


def portable(df: DataFrame) -> DataFrame:
    """Timestamps and binaries as text."""
    out = []
    for name, dtype in df.dtypes:
        if dtype.startswith("timestamp"):
            out.append(ts_text(name))
        elif dtype == "binary":
            out.append(hex_text(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
