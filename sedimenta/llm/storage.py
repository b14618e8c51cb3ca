"""Tables that cut lineage in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sedimenta.sources.workspace import folder


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a frame and read it back, so that a lost executor costs no recomputation."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame, taken: str = "row_key") -> str:
    """A column name that the frame doesn't have."""
    names = {c.lower() for c in df.columns}
    while taken.lower() in names:
        taken = f"_{taken}"
    return taken
