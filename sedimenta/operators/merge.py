"""Incremental merge of a business view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.config import UNKNOWN_SK, RunContext, Scd2Config
from sedimenta.functions.text import timestamp


def merge_from_view(
    view: DataFrame,
    target: DataFrame,
    business_key: str,
    columns: Sequence[str],
    source_sk: str,
    sk_column: str,
    ctx: RunContext,
    cfg: Scd2Config = Scd2Config(),
) -> DataFrame:
    """Rows to append: view rows whose (business key, valid-from) the target lacks.

    Existing rows are never updated. The versions come from the view as they are. Only the
    two key columns of the target are read.
    """
    on = [business_key, cfg.valid_from]
    now = timestamp(ctx.run_ts)
    missing = view.join(target.select(*on), on, "left_anti")
    return missing.select(
        F.coalesce(F.col(source_sk), F.lit(UNKNOWN_SK)).cast("long").alias(sk_column),
        *columns,
        cfg.valid_from,
        cfg.valid_to,
        cfg.current_flag,
        now.alias(cfg.created_at),
        now.alias(cfg.updated_at),
        F.coalesce(F.lit(ctx.run_id).cast("long"), F.lit(-1)).alias("ETL_JOB_RUN_ID"),
    )
