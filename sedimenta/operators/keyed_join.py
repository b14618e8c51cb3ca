"""Small helpers that keep joins on keys balanced and narrow.

Adaptive execution splits a skewed partition only when the shuffle lies directly under the
join. That holds for stored tables; :func:`one_per_key` makes it hold for aggregates too, so a
hot or missing key of the left side never needs to be looked for beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of 64 bits in the filter of only_keys_of: at most 2 MB of words and bits are broadcast.
FILTER_WORDS = 1 << 17


def one_per_key(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row per key with aggregates, for the right side of a join on the keys.

    The rows are also grouped by a hash of the keys. That changes no group, but the join can't
    use the grouping's shuffle and puts its own, of one row per key, directly under itself.
    """
    return df.groupBy(*keys, F.xxhash64(*keys).alias("_spread")).agg(*aggregates).drop("_spread")


def _slot(df: DataFrame, keys: Sequence[str], like: DataFrame, slots: int) -> Column:
    """A number for the keys that is the same on both sides of a join, whose key types may differ."""
    values = []
    for k in keys:
        kind = like.schema[k].dataType
        value = F.col(k) if df.schema[k].dataType == kind else F.col(k).try_cast(kind)
        values.append(value + 0 if isinstance(kind, T.FractionalType) else value)  # one zero, not two
    return F.pmod(F.xxhash64(*values), F.lit(slots))


def mark_keys_of(df: DataFrame, keys: Sequence[str], wanted: DataFrame, mark: str, words: int = FILTER_WORDS) -> DataFrame:
    """``df`` with a boolean: whether a row's key may occur in ``wanted``, found without a shuffle of ``df``.

    A bitmap over hashes of the wanted keys is broadcast. It has at most ``words`` rows of 64
    bits, however many keys there are; beyond a few million keys it marks ever more other rows
    too. Every row with a wanted key is marked.
    """
    def parts(side: DataFrame) -> tuple[Column, Column]:
        slot = _slot(side, keys, df, 64 * words)
        return F.shiftright(slot, 6), slot.bitwiseAND(63).cast("int")

    word, bit = parts(wanted)
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bitmap = wanted.select(word.alias("_word"), flag.alias("_flag")).groupBy("_word").agg(F.bit_or("_flag").alias("_bits"))
    word, bit = parts(df)
    met = df.join(F.broadcast(bitmap), word == F.col("_word"), "left")
    hit = F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(1) == 1
    return met.select(*[f"`{c}`" for c in df.columns], F.coalesce(hit, F.lit(False)).alias(mark))


def only_keys_of(df: DataFrame, keys: Sequence[str], wanted: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Rows of ``df`` whose key may occur in ``wanted`` (:func:`mark_keys_of`); callers join by the keys afterwards."""
    return mark_keys_of(df, keys, wanted, "_wanted", words).where("_wanted").drop("_wanted")
