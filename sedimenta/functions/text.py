"""Engine-independent text forms, natural keys and hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.config import COMPOSITE_PART_LENGTH, KEY_SEPARATOR, SINGLE_KEY_LENGTH

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def canonical_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a value that does not depend on an engine's number or date formatting."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # Values outside the decimal range (and NaN) keep their plain text.
        return F.coalesce(col.try_cast("decimal(38,6)").cast("string"), col.cast("string"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, TIMESTAMP_TEXT)
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"no canonical text for nested type {dtype.simpleString()}")
    return col.cast("string")


def _typed(df: DataFrame, column: str | Column) -> tuple[Column, T.DataType]:
    if isinstance(column, str):
        return F.col(column), df.schema[column].dataType
    return column, df.select(column.alias("c")).schema["c"].dataType


def hash_input(df: DataFrame, columns: Sequence[str | Column], truncate: int | None = None) -> Column:
    """Injective encoding of a column list: ``N`` for null, else ``V<length>:<text>``.

    The length tag keeps ``('ab', 'c')`` apart from ``('a', 'bc')`` and a null apart from
    an empty string. ``truncate`` cuts every text first.
    """
    parts = []
    for column in columns:
        text = canonical_text(*_typed(df, column))
        if truncate is not None:
            text = F.left(text, F.lit(truncate))
        tagged = F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(tagged, F.lit("N")))
    return F.concat(*parts)


def record_hash(df: DataFrame, columns: Sequence[str | Column], truncate: int | None = None) -> Column:
    """SHA-256 over a column list, as 32 bytes."""
    return F.unhex(F.sha2(hash_input(df, columns, truncate), 256))


def key_hash(natural_key: Column) -> Column:
    """SHA-256 of a natural key, as 32 bytes. Stored for reference, never used for lookup."""
    return F.unhex(F.sha2(natural_key, 256))


def natural_key(df: DataFrame, columns: Sequence[str], normalise: bool = False, cut: bool = False) -> Column:
    """Text form of a business key.

    A single column is cast, a composite key trims each part and joins them by a separator.
    ``cut`` shortens a single key to 255 characters and each part of a composite key to 100,
    for key tables that were filled that way; keys that differ later then count as one. ``concat`` is used because it turns null when any part is null.
    ``normalise`` makes keys compare without case and trailing blanks.
    """
    texts = [canonical_text(*_typed(df, c)) for c in columns]
    if normalise:
        texts = [F.upper(F.rtrim(t)) for t in texts]
    if len(texts) == 1:
        return F.left(texts[0], F.lit(SINGLE_KEY_LENGTH)) if cut else texts[0]
    parts: list[Column] = []
    for i, text in enumerate(texts):
        if i:
            parts.append(F.lit(KEY_SEPARATOR))
        parts.append(F.trim(F.left(text, F.lit(COMPOSITE_PART_LENGTH)) if cut else text))
    return F.concat(*parts)


def timestamp(text: str) -> Column:
    """A timestamp literal without time zone."""
    return F.lit(text).cast("timestamp_ntz")
