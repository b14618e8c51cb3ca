"""Table name rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT_TOKEN = 4


def core_name(table_name: Column, prefixes: Sequence[str] = ()) -> Column:
    """Core of a table name: the first of some prefixes is cut, else a first token of at most 4 letters."""
    cut = F.when(table_name.isNull(), F.lit(""))
    for prefix in prefixes:
        cut = cut.when(
            F.startswith(F.upper(table_name), F.lit(prefix.upper())),
            F.substring(table_name, len(prefix) + 1, 2**31 - 1),
        )
    short_first_token = table_name.rlike(rf"^[^_]{{0,{SHORT_TOKEN}}}_")
    cut = cut.when(short_first_token, F.regexp_replace(table_name, r"(?s)^[^_]*_(.*)$", "$1"))
    return cut.otherwise(table_name)
