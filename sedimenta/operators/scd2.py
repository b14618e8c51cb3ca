"""Slowly changing dimensions, type 2: classify a batch, close old versions, add new ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.config import HIGH_DATE, Action, LoadSpec, RunContext, Scd2Config
from sedimenta.functions.text import record_hash, timestamp
from sedimenta.operators.foreign_keys import lookup_surrogate_key, resolve_foreign_keys
from sedimenta.operators.keyed_join import one_per_key, only_keys_of
from sedimenta.sources.workspace import stash

ACTION = "_action"
CLOSED_NOW = "_closed_now"
INSERTED_NOW = "_inserted_now"


def current_rows(history: DataFrame, cfg: Scd2Config = Scd2Config()) -> DataFrame:
    return history.filter(F.col(cfg.current_flag) == cfg.current_value)


def historical_rows(history: DataFrame, cfg: Scd2Config = Scd2Config()) -> DataFrame:
    return history.filter(F.col(cfg.current_flag) == cfg.closed_value)


def hash_differs(incoming: Column, stored: Column) -> Column:
    """Unknown when either side is null, so a null stored hash never counts as a change."""
    return incoming != stored


def digests(stored: Column) -> list[Column]:
    """A stored hash as two numbers of 64 bits, which aggregate without a sort; null stays null."""
    return [F.when(stored.isNotNull(), F.xxhash64(*salt, stored)) for salt in ([], [F.lit(1)])]


def open_rows(history: DataFrame, spec: LoadSpec) -> Column:
    """Rows a load may close. A null flag is unknown and stays out."""
    flag = F.col(spec.scd2.current_flag)
    return flag == spec.scd2.current_value if spec.close_mode == "current" else flag != spec.scd2.closed_value


def _staged(staging: DataFrame, spec: LoadSpec) -> DataFrame:
    if spec.null_keys == "reject":
        return staging.dropna(how="any", subset=list(spec.business_key))
    return staging


def classify(
    staging: DataFrame, history: DataFrame, spec: LoadSpec
) -> DataFrame:
    """Staging rows with their record hash and an action: NEW, CHANGED or UNCHANGED.

    Of the current side only rows whose key may be in the batch are shuffled. They shrink to
    one row per key before the join: smallest and largest digests of the stored hash. Some
    current row differs from a batch row exactly when one of these does (128 bits in all), so
    several current rows of one key neither multiply the batch nor lose a change.
    """
    cfg, keys = spec.scd2, list(spec.business_key)
    staging = _staged(staging, spec)
    columns = spec.hash_columns or spec.columns or staging.columns
    hashed = staging.withColumn(cfg.record_hash, record_hash(staging, columns, spec.hash_truncate))
    parts = list(enumerate(digests(F.col(cfg.record_hash))))
    current = current_rows(history, cfg).select(*keys, cfg.record_hash).dropna(how="any", subset=keys)
    stored = one_per_key(
        only_keys_of(current, keys, staging),
        keys,
        *[F.min(p).alias(f"_low{i}") for i, p in parts],
        *[F.max(p).alias(f"_high{i}") for i, p in parts],
        F.count("*").alias("_known"),
    )
    joined = hashed.join(stored, keys, "left")
    differs = [hash_differs(part, F.col(f"{end}{i}")) for i, part in parts for end in ("_low", "_high")]
    action = (
        F.when(F.col("_known").isNull(), Action.NEW)
        .when(reduce(Column.__or__, differs), Action.CHANGED)
        .otherwise(Action.UNCHANGED)
    )
    return joined.withColumn(ACTION, action).select(*hashed.columns, ACTION)


def identify_new(
    staging: DataFrame, history: DataFrame, spec: LoadSpec
) -> DataFrame:
    """Staging rows without a current version. Keys whose versions are all closed are new again."""
    keys, staging = list(spec.business_key), _staged(staging, spec)
    known = only_keys_of(current_rows(history, spec.scd2).select(*keys), keys, staging)
    return staging.join(known, keys, "left_anti")


def identify_changed(staging: DataFrame, history: DataFrame, spec: LoadSpec) -> DataFrame:
    """Staging rows, with their hash, whose key has a current version with another hash."""
    return classify(staging, history, spec).filter(F.col(ACTION) == Action.CHANGED).drop(ACTION)


def mark_closed(
    history: DataFrame,
    changed: DataFrame,
    spec: LoadSpec,
    ctx: RunContext,
) -> DataFrame:
    """History with the open versions of the changed keys closed, plus ``_closed_now``."""
    cfg, keys = spec.scd2, list(spec.business_key)
    hit = one_per_key(changed.select(*keys).dropna(how="any"), keys, F.count("*").alias("_hit"))
    joined = history.join(hit, keys, "left").select(*history.columns, "_hit")
    closes = F.coalesce(F.col("_hit").isNotNull() & open_rows(history, spec), F.lit(False))
    now = timestamp(ctx.run_ts)
    updates = {
        cfg.current_flag: F.lit(cfg.closed_value),
        cfg.valid_to: now,
        cfg.updated_at: now,
        cfg.updated_by: F.lit(ctx.user),
    }
    out = [F.when(F.col("_now"), updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
           for c in history.columns]
    return joined.withColumn("_now", closes).select(*out, F.col("_now").alias(CLOSED_NOW))


def close_versions(history: DataFrame, changed: DataFrame, spec: LoadSpec, ctx: RunContext) -> DataFrame:
    return mark_closed(history, changed, spec, ctx).drop(CLOSED_NOW)


def new_versions(
    rows: DataFrame, spec: LoadSpec, ctx: RunContext, key_table: DataFrame | None = None
) -> DataFrame:
    """History rows for classified batch rows: keys resolved, technical columns set.

    Exact duplicates collapse first, as in a target table that is a set; afterwards nothing
    regroups the rows, so the lookups may split skewed partitions freely.
    """
    cfg = spec.scd2
    columns = list(spec.columns or [c for c in rows.columns if c not in (ACTION, cfg.record_hash)])
    sources = _lookup_columns(spec)
    kept = list(dict.fromkeys([*columns, *spec.business_key, *sources]))
    if spec.surrogate == "staging" and spec.sk_column not in kept:
        kept.append(spec.sk_column)
    df = rows.select(*kept, cfg.record_hash).distinct()
    if spec.surrogate == "key_table":
        if key_table is None:
            raise ValueError("this load looks its key up in a key table, but none was given")
        df = lookup_surrogate_key(df, spec.business_key, key_table, spec.domain, spec.sk_column, spec.cut_keys)
    df = resolve_foreign_keys(df, spec.foreign_keys, spec.cut_keys)
    now = timestamp(ctx.run_ts)
    technical = {
        cfg.record_hash: F.col(cfg.record_hash),
        cfg.valid_from: now,
        cfg.valid_to: timestamp(HIGH_DATE),
        cfg.current_flag: F.lit(cfg.current_value),
        cfg.created_at: now,
        cfg.updated_at: now,
        cfg.created_by: F.lit(ctx.user),
        cfg.updated_by: F.lit(ctx.user),
    }
    key = [spec.sk_column] if spec.surrogate else []
    leading = list(dict.fromkeys([*key, *columns, *(fk.sk_column for fk in spec.foreign_keys)]))
    return df.select(*leading, *[technical[c].alias(c) for c in cfg.technical_columns])


def _lookup_columns(spec: LoadSpec) -> list[str]:
    names: list[str] = []
    for fk in spec.foreign_keys:
        names += list(fk.columns) if hasattr(fk, "columns") else [fk.column]
    return names


@dataclass(frozen=True)
class Scd2Result:
    """Outcome of a load.

    ``rows`` holds every row that was open before plus the inserted ones, with booleans
    ``_closed_now`` and ``_inserted_now``; it comes from one pass over the open rows and can be
    written in one job, split by the first. ``past`` are the rows the load leaves as they are.
    """

    rows: DataFrame
    inserted: DataFrame
    past: DataFrame

    @property
    def closed(self) -> DataFrame:
        """Versions to append to the historical rows."""
        return self.rows.filter(CLOSED_NOW).drop(CLOSED_NOW, INSERTED_NOW)

    @property
    def current(self) -> DataFrame:
        """Rows that replace the open rows."""
        return self.rows.filter(~F.col(CLOSED_NOW)).drop(CLOSED_NOW, INSERTED_NOW)

    @property
    def history(self) -> DataFrame:
        return self.past.unionByName(self.rows.drop(CLOSED_NOW, INSERTED_NOW))


def combine(
    tagged: DataFrame,
    history: DataFrame,
    spec: LoadSpec,
    ctx: RunContext,
    key_table: DataFrame | None = None,
) -> Scd2Result:
    """Close and insert versions for a classified batch."""
    tagged = tagged.filter(F.col(ACTION) != Action.UNCHANGED)
    changed = tagged.filter(F.col(ACTION) == Action.CHANGED)
    is_open = F.coalesce(open_rows(history, spec), F.lit(False))
    marked = mark_closed(history.filter(is_open), changed, spec, ctx)
    inserted = new_versions(tagged, spec, ctx, key_table)
    rows = marked.withColumn(INSERTED_NOW, F.lit(False)).unionByName(
        inserted.withColumns({CLOSED_NOW: F.lit(False), INSERTED_NOW: F.lit(True)})
    )
    return Scd2Result(rows=rows, inserted=inserted, past=history.filter(~is_open))


def apply(
    history: DataFrame,
    staging: DataFrame,
    spec: LoadSpec,
    ctx: RunContext,
    key_table: DataFrame | None = None,
    durable: bool = True,
) -> Scd2Result:
    """One SCD-2 load as a plan over history and batch.

    Only open rows take part in joins; with a history partitioned by its flag the closed
    versions are never read. ``durable`` (the default) writes the new and changed batch rows once to
    the shared folder, so that closing and inserting do not repeat the classification.
    """
    tagged = classify(staging, history, spec).filter(F.col(ACTION) != Action.UNCHANGED)
    if durable:
        tagged = stash(tagged, "classified")
    return combine(tagged, history, spec, ctx, key_table)


def full_reload(
    history: DataFrame,
    staging: DataFrame,
    spec: LoadSpec,
    ctx: RunContext,
    key_table: DataFrame | None = None,
) -> Scd2Result:
    """Initial load: as :func:`apply` on an emptied target. Key tables stay as they are."""
    empty = history.sparkSession.createDataFrame([], history.schema)
    return apply(empty, staging, spec, ctx, key_table)


def action_counts(classified: DataFrame) -> DataFrame:
    """Rows per action, one pass."""
    return classified.groupBy(F.col(ACTION).alias("action")).agg(F.count("*").alias("row_count"))


def duplicate_keys(staging: DataFrame, business_key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once in a batch, with their counts; empty when all is well."""
    return staging.groupBy(*business_key).agg(F.count("*").alias("row_count")).filter("row_count > 1")
