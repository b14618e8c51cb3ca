"""Extraction from a relational source system."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from sedimenta.operators.ingest import ColumnMapping, conversion_text

DEFAULT_SCHEMA = "dbo"


def extract_query(table: str, columns: Sequence[ColumnMapping], default_schema: str | None = None) -> str:
    """SELECT text for the source: projected columns, conversions applied there."""
    full_name = table if "." in table else f"{default_schema or DEFAULT_SCHEMA}.{table}"
    items = []
    for c in columns:
        if c.convert_expression:
            items.append(f"{conversion_text(c)} AS {c.source_name}")
        else:
            items.append(f"[{c.source_name}]")
    return f"SELECT {', '.join(items)} FROM {full_name}"


def extract(
    spark: SparkSession,
    url: str,
    table: str,
    columns: Sequence[ColumnMapping],
    default_schema: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    sessions: int = 4,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read a source table over several parallel sessions, split by ``partition_column``."""
    query = extract_query(table, columns, default_schema)
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    if partition_column is None:
        return reader.option("query", query).load()
    if bounds is None:
        raise ValueError("a partitioned extract needs the bounds of its partition column")
    return (
        reader.option("dbtable", f"({query}) AS src")
        .option("partitionColumn", partition_column)
        .option("lowerBound", bounds[0])
        .option("upperBound", bounds[1])
        .option("numPartitions", sessions)
        .load()
    )
