"""Names, flag values and load descriptions shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

# Fixed values the results depend on.
HIGH_DATE = "9999-12-31 23:59:59.999999"
UNKNOWN_SK = -1
KEY_SEPARATOR = "~|~"
SINGLE_KEY_LENGTH = 255
COMPOSITE_PART_LENGTH = 100


class Layer(IntEnum):
    RAW = 1
    DISCOVERABLE = 2
    REUSABLE = 3
    CONSUMABLE = 4


class Action:
    """Tags set by the change classification."""

    NEW = "NEW"
    CHANGED = "CHANGED"
    UNCHANGED = "UNCHANGED"


class RunStatus:
    RUNNING = "RUNNING"
    SUCCESS = "SUCCESS"
    FAILED = "FAILED"
    SKIPPED = "SKIPPED"
    PAUSED = "PAUSED"
    CANCELLED = "CANCELLED"


@dataclass(frozen=True)
class Scd2Config:
    """Technical column names and flag values of a history table."""

    valid_from: str = "VALID_FROM"
    valid_to: str = "VALID_TO"
    current_flag: str = "IS_CURRENT"
    current_value: str = "Y"
    closed_value: str = "N"
    record_hash: str = "RECORD_HASH"
    created_at: str = "CREATED_TIMESTAMP"
    updated_at: str = "LAST_UPDATED_TIMESTAMP"
    created_by: str = "CREATED_BY"
    updated_by: str = "LAST_UPDATED_BY"

    @property
    def technical_columns(self) -> list[str]:
        return [
            self.record_hash,
            self.valid_from,
            self.valid_to,
            self.current_flag,
            self.created_at,
            self.updated_at,
            self.created_by,
            self.updated_by,
        ]


@dataclass(frozen=True)
class RunContext:
    """One timestamp and one user for everything a load writes.

    ``run_ts`` is a timestamp text such as ``2024-02-01 00:00:00``; a single value for
    the whole run leaves no gap between a closed version and its successor.
    """

    run_ts: str
    user: str = "etl"
    run_id: int | None = None


@dataclass(frozen=True)
class KeyLookup:
    """Foreign key resolved through a key table by (natural key, domain)."""

    sk_column: str
    columns: Sequence[str]
    key_table: DataFrame
    domain: str


@dataclass(frozen=True)
class MasterLookup:
    """Foreign key resolved through the business key of a parent history.

    With ``current_only`` the parent is restricted to its current versions; otherwise all
    versions take part, reduced to distinct (business key, surrogate key) pairs.
    """

    sk_column: str
    column: str
    parent: DataFrame
    parent_bk: str
    parent_sk: str
    current_only: Scd2Config | None = None


@dataclass(frozen=True)
class BridgeLookup:
    """Foreign key whose natural key is reached through another table."""

    sk_column: str
    column: str
    bridge: DataFrame
    bridge_key: str
    bridge_natural_key: Sequence[str]
    key_table: DataFrame
    domain: str


ForeignKey = KeyLookup | MasterLookup | BridgeLookup


@dataclass(frozen=True)
class LoadSpec:
    """Describes one SCD-2 load.

    ``surrogate`` chooses where the own surrogate key comes from: ``"key_table"`` looks it
    up, ``"staging"`` expects it among the staging columns, ``None`` writes no key.
    ``close_mode`` is ``"current"`` (close rows flagged current) or ``"not_closed"`` (close
    every row whose flag differs from the closed value). ``null_keys`` is ``"insert"`` (a
    row without a complete key is new on every run) or ``"reject"``. ``cut_keys`` shortens natural
    keys as :func:`sedimenta.functions.text.natural_key` states, in key generation and all lookups.
    """

    business_key: Sequence[str]
    columns: Sequence[str] | None = None
    hash_columns: Sequence[str | Column] | None = None
    surrogate: str | None = "key_table"
    sk_column: str = "SURROGATE_KEY"
    domain: str = ""
    foreign_keys: Sequence[ForeignKey] = ()
    scd2: Scd2Config = field(default_factory=Scd2Config)
    close_mode: str = "current"
    null_keys: str = "insert"
    hash_truncate: int | None = None
    cut_keys: bool = False

    def __post_init__(self) -> None:
        if not self.business_key:
            raise ValueError("a load needs at least one business key column")
        if self.surrogate not in ("key_table", "staging", None):
            raise ValueError(f"unknown surrogate mode {self.surrogate!r}")
        if self.close_mode not in ("current", "not_closed"):
            raise ValueError(f"unknown close mode {self.close_mode!r}")
        if self.null_keys not in ("insert", "reject"):
            raise ValueError(f"unknown null key mode {self.null_keys!r}")


KEY_TABLE_SCHEMA = T.StructType(
    [
        T.StructField("SURROGATE_KEY", T.LongType(), False),
        T.StructField("NATURAL_KEY_VALUE", T.StringType(), False),
        T.StructField("NATURAL_KEY_DOMAIN", T.StringType(), False),
        T.StructField("NATURAL_KEY_HASH", T.BinaryType()),
        T.StructField("IS_MASKED", T.StringType()),
        T.StructField("MASKED_VALUE", T.StringType()),
        T.StructField("CREATED_TIMESTAMP", T.TimestampNTZType()),
        T.StructField("CREATED_BY", T.StringType()),
    ]
)

JOB_RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("job_id", T.LongType(), False),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("duration_seconds", T.DecimalType(18, 6)),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("error_stack", T.StringType()),
        T.StructField("execution_mode", T.StringType()),
        T.StructField("control_flag", T.StringType()),
    ]
)

STEP_RUN_SCHEMA = T.StructType(
    [
        T.StructField("step_run_id", T.LongType(), False),
        T.StructField("run_id", T.LongType(), False),
        T.StructField("step_id", T.LongType(), False),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("duration_seconds", T.DecimalType(18, 6)),
        T.StructField("status", T.StringType()),
        T.StructField("rows_read", T.LongType()),
        T.StructField("rows_inserted", T.LongType()),
        T.StructField("rows_updated", T.LongType()),
        T.StructField("rows_deleted", T.LongType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("was_skipped", T.StringType()),
        T.StructField("skip_reason", T.StringType()),
    ]
)

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("column_id", T.LongType(), False),
        T.StructField("table_id", T.LongType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("position", T.IntegerType()),
        T.StructField("column_type", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("nullable", T.StringType()),
    ]
)

VIEW_LINEAGE_SCHEMA = T.StructType(
    [
        T.StructField("view_id", T.LongType(), False),
        T.StructField("source_id", T.LongType()),
        T.StructField("source_db", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("ddl_hash", T.StringType()),
        T.StructField("parsed_at", T.TimestampNTZType()),
    ]
)


def history_schema(
    source: T.StructType,
    sk_column: str | None,
    fk_columns: Sequence[str] = (),
    cfg: Scd2Config | None = None,
) -> T.StructType:
    """Schema of a history table: key, source columns, foreign keys, technical columns.

    A name that appears twice (compared without case) keeps its first position.
    """
    cfg = cfg or Scd2Config()
    ts = T.TimestampNTZType()
    tail_types = {
        cfg.record_hash: (T.BinaryType(), True),
        cfg.valid_from: (ts, False),
        cfg.valid_to: (ts, True),
        cfg.current_flag: (T.StringType(), True),
        cfg.created_at: (ts, False),
        cfg.updated_at: (ts, True),
        cfg.created_by: (T.StringType(), True),
        cfg.updated_by: (T.StringType(), True),
    }
    fields = []
    if sk_column:
        fields.append(T.StructField(sk_column, T.LongType(), False))
    fields += source.fields
    fields += [T.StructField(name, T.LongType()) for name in fk_columns]
    fields += [T.StructField(name, *tail_types[name]) for name in cfg.technical_columns]
    seen: set[str] = set()
    unique = []
    for f in fields:
        if f.name.upper() not in seen:
            seen.add(f.name.upper())
            unique.append(f)
    return T.StructType(unique)
