"""Scans of layered tables and business views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.config import Layer

# The folder of each layer below the warehouse root.
LAYER_FOLDER = {Layer.RAW: "raw", Layer.DISCOVERABLE: "disc", Layer.REUSABLE: "reus", Layer.CONSUMABLE: "cons"}


def table_path(root: str, layer: Layer, table: str) -> str:
    return f"{root.rstrip('/')}/{LAYER_FOLDER[layer]}/{table}"


def select_columns(df: DataFrame, columns: Sequence[str | Mapping[str, str]] | None) -> DataFrame:
    """Project plain names, or ``{"name": ..., "expression": ...}`` items."""
    if columns is None:
        return df
    chosen = []
    for item in columns:
        if isinstance(item, str):
            chosen.append(F.col(item))
        elif item.get("expression"):
            chosen.append(F.expr(item["expression"]).alias(item["name"]))
        else:
            chosen.append(F.col(item["name"]))
    return df.select(*chosen)


def scan(
    spark: SparkSession,
    root: str,
    layer: Layer,
    table: str,
    columns: Sequence[str | Mapping[str, str]] | None = None,
) -> DataFrame:
    """Scan a layer table with a chosen column list; only those columns are read."""
    return select_columns(spark.read.parquet(table_path(root, layer, table)), columns)


def scan_view(
    spark: SparkSession, view: str, columns: Sequence[str | Mapping[str, str]] | None = None
) -> DataFrame:
    """Scan a registered business view."""
    return select_columns(spark.table(view), columns)
