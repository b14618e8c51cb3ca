"""Table statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.config import Scd2Config


def table_statistics(history: DataFrame, cfg: Scd2Config = Scd2Config()) -> DataFrame:
    """Current, historical and total row counts as (metric_name, metric_value).

    One pass for all three; only the flag column is read. A row with any other flag counts
    in the total alone.
    """
    flag = F.col(cfg.current_flag)
    counts = history.agg(
        F.count_if(flag == cfg.current_value).alias("cur"),
        F.count_if(flag == cfg.closed_value).alias("his"),
        F.count("*").alias("tot"),
    )
    return counts.select(
        F.expr(
            "stack(3, 'Current Records', cur, 'Historical Records', his, 'Total Records', tot)"
            " as (metric_name, metric_value)"
        )
    )


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("row_count"))
