"""Surrogate-key lookups: own key, foreign keys through key, master and bridge tables.

Each lookup is a left join whose right side has one row per key and lies directly behind the
join's shuffle, so adaptive execution can broadcast a small side by its measured size and
split a hot or null key of the left side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.config import UNKNOWN_SK, BridgeLookup, ForeignKey, KeyLookup, MasterLookup
from sedimenta.functions.text import natural_key
from sedimenta.operators.keyed_join import one_per_key


def _domain_keys(key_table: DataFrame, domain: str) -> DataFrame:
    return key_table.filter(F.col("NATURAL_KEY_DOMAIN") == domain).select(
        F.col("NATURAL_KEY_VALUE").alias("_nk"), F.col("SURROGATE_KEY").alias("_sk")
    )


def _lookup(df: DataFrame, key: Column, pairs: DataFrame, sk_column: str) -> DataFrame:
    """Add ``sk_column`` from (``_nk``, ``_sk``) pairs; -1 where nothing matches."""
    keyed = df.withColumn("_key", key)
    joined = keyed.join(pairs, keyed["_key"] == pairs["_nk"], "left")
    found = F.coalesce(F.col("_sk"), F.lit(UNKNOWN_SK)).cast("long")
    return joined.withColumn(sk_column, found).drop("_key", "_nk", "_sk")


def lookup_surrogate_key(
    df: DataFrame, columns: Sequence[str], key_table: DataFrame, domain: str, sk_column: str,
    cut: bool = False,
) -> DataFrame:
    """Own surrogate key by (natural key, domain)."""
    return _lookup(df, natural_key(df, columns, cut=cut), _domain_keys(key_table, domain), sk_column)


def master_pairs(fk: MasterLookup, cut: bool = False) -> DataFrame:
    """One surrogate key per parent key: the smallest that is not -1, else -1."""
    parent = fk.parent
    if fk.current_only is not None:
        parent = parent.filter(F.col(fk.current_only.current_flag) == fk.current_only.current_value)
    known = F.min(F.when(F.col("_sk") != UNKNOWN_SK, F.col("_sk")))
    pairs = parent.select(natural_key(parent, [fk.parent_bk], cut=cut).alias("_nk"), F.col(fk.parent_sk).alias("_sk"))
    return one_per_key(pairs.where(F.col("_nk").isNotNull()), ["_nk"], F.coalesce(known, F.lit(UNKNOWN_SK)).alias("_sk"))


def bridge_pairs(fk: BridgeLookup, cut: bool = False) -> DataFrame:
    """One surrogate key per bridge key: the smallest one its rows lead to."""
    bridge = fk.bridge.select(
        F.col(fk.bridge_key).alias("_bridge"), natural_key(fk.bridge, fk.bridge_natural_key, cut=cut).alias("_bk")
    )
    keys = _domain_keys(fk.key_table, fk.domain)
    met = bridge.join(keys, bridge["_bk"] == keys["_nk"]).select(F.col("_bridge").alias("_nk"), "_sk")
    return one_per_key(met, ["_nk"], F.min("_sk").alias("_sk"))


def resolve_foreign_keys(
    df: DataFrame, foreign_keys: Sequence[ForeignKey], cut: bool = False
) -> DataFrame:
    """Add one surrogate-key column per definition. Rows are kept; unresolved keys become -1."""
    for fk in foreign_keys:
        if isinstance(fk, KeyLookup):
            df = lookup_surrogate_key(df, fk.columns, fk.key_table, fk.domain, fk.sk_column, cut)
        elif isinstance(fk, MasterLookup):
            df = _lookup(df, natural_key(df, [fk.column], cut=cut), master_pairs(fk, cut), fk.sk_column)
        else:
            df = _lookup(df, F.col(fk.column), bridge_pairs(fk, cut), fk.sk_column)
    return df
