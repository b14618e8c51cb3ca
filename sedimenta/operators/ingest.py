"""Bulk load into the raw layer: map, cast, split off rejected rows.

A load target is a folder with one folder per load, and in it one per outcome: the same write
stores loaded and rejected rows, and a repeated load replaces its own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.config import RunContext
from sedimenta.functions.text import timestamp
from sedimenta.functions.types import spark_type

ERRORS = "_errors"
LOADED, REJECTED = "loaded", "rejected"
_SAFE_TEMPLATE = re.compile(r"[\w\s(),.'{}\[\]+*/-]*")


@dataclass(frozen=True)
class ColumnMapping:
    """One source column, the target column it fills and the target type.

    ``convert_expression`` is a template with ``[{col}]`` for the column and ``{len}`` for
    ``source_length``.
    """

    source_name: str
    target_name: str
    target_type: str = "VARCHAR(255)"
    nullable: bool = True
    convert_expression: str | None = None
    source_length: int | None = None


def conversion_text(mapping: ColumnMapping, quote: str = "[{}]") -> str:
    """Fill a conversion template. Anything but a plain expression is refused."""
    template = mapping.convert_expression or "[{col}]"
    if not _SAFE_TEMPLATE.fullmatch(template) or "--" in template or "/*" in template:
        raise ValueError(f"conversion template not allowed: {template!r}")
    text = template.replace("[{col}]", quote.format(mapping.source_name))
    return text.replace("{len}", str(mapping.source_length or 0))


def _source_value(df: DataFrame, mapping: ColumnMapping) -> Column:
    if mapping.convert_expression:
        return F.expr(conversion_text(mapping, quote="`{}`"))
    return df[mapping.source_name]


def typed(source: DataFrame, mappings: Sequence[ColumnMapping]) -> DataFrame:
    """Target columns plus ``_errors``, the list of columns a row fails on, and ``_source``.

    A value fails when it is given but cannot be cast, or is missing where it must not be.
    """
    values, errors = [], []
    for m in mappings:
        raw = _source_value(source, m)
        dtype = spark_type(m.target_type)
        if isinstance(dtype, T.StructType):
            raise ValueError(f"{m.target_name}: no single column can be cast to {m.target_type}")
        value = raw.cast("string") if isinstance(dtype, T.StringType) else raw.try_cast(dtype)
        values.append(value.alias(m.target_name))
        failed = raw.isNotNull() & value.isNull()
        if not m.nullable:
            failed = failed | raw.isNull()
        errors.append(F.when(failed, F.lit(m.target_name)))
    texts = [source[m.source_name].cast("string").alias(m.source_name) for m in mappings]
    original = F.to_json(F.struct(*texts), {"ignoreNullFields": "false"})
    flagged = F.array_compact(F.array(*errors))
    return source.select(
        *values, flagged.alias(ERRORS), F.when(F.size(flagged) > 0, original).alias("_source")
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size(ERRORS) == 0).drop(ERRORS, "_source")


def rejected(rows: DataFrame) -> DataFrame:
    """Error rows: the failing columns and the source row as it came."""
    return rows.filter(F.size(ERRORS) > 0).select(
        F.array_join(ERRORS, ",").alias("failed_columns"), F.col("_source").alias("source_row")
    )


def load_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows_read"),
        F.count_if(F.size(ERRORS) == 0).alias("rows_loaded"),
        F.count_if(F.size(ERRORS) > 0).alias("rows_rejected"),
    )


def with_load_audit(rows: DataFrame, ctx: RunContext) -> DataFrame:
    return rows.withColumns(
        {
            "ETL_LOAD_ID": F.lit(ctx.run_id).cast("long"),
            "ETL_LOAD_TIMESTAMP": timestamp(ctx.run_ts),
        }
    )


def ingest(
    source: DataFrame,
    mappings: Sequence[ColumnMapping],
    target: str,
    ctx: RunContext,
    audit: bool = False,
) -> dict[str, int]:
    """Store the good and the bad rows of a load below ``target`` and count them, in one job.

    The folder belongs to the load id: the same load again replaces its rows and adds none,
    and a load that died halfway is simply repeated.
    """
    if ctx.run_id is None:
        raise ValueError("a load needs a run id, by which it can be repeated")
    rows = typed(source, mappings)
    if audit:
        rows = with_load_audit(rows, ctx)
    bad = F.size(ERRORS) > 0
    seen = Observation()
    counted = rows.observe(
        seen, F.count("*").alias("rows_read"), F.count_if(~bad).alias("rows_loaded"), F.count_if(bad).alias("rows_rejected")
    )
    values = [F.when(~bad, F.col(c)).alias(c) for c in rows.columns if c not in (ERRORS, "_source")]
    split = counted.select(
        *values, F.when(bad, F.array_join(ERRORS, ",")).alias("failed_columns"), F.col("_source").alias("source_row"),
        F.when(bad, REJECTED).otherwise(LOADED).alias("outcome"),
    )
    split.write.mode("overwrite").partitionBy("outcome").parquet(f"{target}/load_id={ctx.run_id}")
    return seen.get


def _outcome(spark: SparkSession, target: str, outcome: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(target).where(F.col("outcome") == outcome).drop("outcome")


def loaded_rows(spark: SparkSession, target: str) -> DataFrame:
    """The good rows of all loads, with ``load_id``. Loads with other columns fill in nulls."""
    return _outcome(spark, target, LOADED).drop("failed_columns", "source_row")


def rejected_rows(spark: SparkSession, target: str) -> DataFrame:
    """The error rows of all loads: load_id, failed_columns, source_row."""
    return _outcome(spark, target, REJECTED).select("load_id", "failed_columns", "source_row")
