"""Surrogate keys: key tables, numbering at scale, generation of new keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.config import KEY_TABLE_SCHEMA, UNKNOWN_SK, RunContext
from sedimenta.functions.text import key_hash, natural_key, timestamp
from sedimenta.sources.workspace import stash

# monotonically_increasing_id keeps the row number of a partition in its lower 33 bits.
_ROW_BITS = 33


def ensure_key_table(
    spark: SparkSession,
    ctx: RunContext,
    existing: DataFrame | None = None,
    seed: bool = True,
) -> DataFrame:
    """The existing key table, or a new one; a new one may start with the default member -1.

    With the default member the first generated key is 0, without it 1.
    """
    if existing is not None:
        return existing
    table = spark.createDataFrame([], KEY_TABLE_SCHEMA)
    if not seed:
        return table
    member = spark.range(1).select(
        F.lit(UNKNOWN_SK).cast("long").alias("SURROGATE_KEY"),
        F.lit("UNKNOWN").alias("NATURAL_KEY_VALUE"),
        F.lit("SYSTEM").alias("NATURAL_KEY_DOMAIN"),
        F.lit(None).cast("binary").alias("NATURAL_KEY_HASH"),
        F.lit("N").alias("IS_MASKED"),
        F.lit(None).cast("string").alias("MASKED_VALUE"),
        timestamp(ctx.run_ts).alias("CREATED_TIMESTAMP"),
        F.lit("SYSTEM").alias("CREATED_BY"),
    )
    return table.unionByName(member)


def number_distinct(df: DataFrame, *columns: str, position: str = "position") -> DataFrame:
    """Positions 1..n of the rows of a frame, in the order of columns that tell them apart.

    Equals ``dense_rank`` over the whole frame, without a window that puts all rows into one
    task: rows are range-partitioned and sorted, written once so that the sampled range
    bounds stay fixed, and each row adds the size of the partitions before its own to its
    number within the partition. The frame is stored first: sampling the bounds and dealing
    the rows out both read it. The window runs over one count per partition.
    """
    row_id = F.monotonically_increasing_id()
    stored = stash(df, "unranked")
    ordered = stored.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_id", row_id)
    fixed = stash(ordered, "ranked")
    part = F.shiftrightunsigned("_id", _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    row = F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        fixed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(position, F.col("_start") + row + 1)
        .drop("_part", "_start", "_id")
    )


def new_natural_keys(
    source: DataFrame,
    key_table: DataFrame,
    business_key: Sequence[str],
    domain: str,
    normalise: bool = False,
    cut: bool = False,
) -> DataFrame:
    """Distinct non-null natural keys of the source that the key table lacks for this domain."""
    known = key_table.filter(F.col("NATURAL_KEY_DOMAIN") == domain).select(
        F.col("NATURAL_KEY_VALUE").alias("natural_key")
    )
    return (
        source.select(natural_key(source, business_key, normalise, cut).alias("natural_key"))
        .filter(F.col("natural_key").isNotNull())
        .distinct()
        .join(known, "natural_key", "left_anti")
    )


def generate_surrogate_keys(
    source: DataFrame,
    key_table: DataFrame,
    business_key: Sequence[str],
    domain: str,
    ctx: RunContext,
    from_staging: bool = True,
    normalise: bool = False,
    cut: bool = False,
) -> DataFrame:
    """Key-table rows for the natural keys of ``source`` that are not registered yet.

    Numbering continues after the largest key of the whole table, all domains included.
    One run at a time may generate keys for a table.
    """
    top = key_table.agg(F.coalesce(F.max("SURROGATE_KEY"), F.lit(0))).first()[0]
    fresh = new_natural_keys(source, key_table, business_key, domain, normalise, cut)
    numbered = number_distinct(fresh, "natural_key")
    creator = f"ETL_KEY_GEN_{domain}" if from_staging else "ETL_KEY_GEN"
    return numbered.select(
        (F.lit(top) + F.col("position")).alias("SURROGATE_KEY"),
        F.col("natural_key").alias("NATURAL_KEY_VALUE"),
        F.lit(domain).alias("NATURAL_KEY_DOMAIN"),
        key_hash(F.col("natural_key")).alias("NATURAL_KEY_HASH"),
        F.lit(None).cast("string").alias("IS_MASKED"),
        F.lit(None).cast("string").alias("MASKED_VALUE"),
        timestamp(ctx.run_ts).alias("CREATED_TIMESTAMP"),
        F.lit(creator).alias("CREATED_BY"),
    )
