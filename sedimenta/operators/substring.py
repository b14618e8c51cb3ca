"""Which of many texts contain which of many patterns, by an index of letter groups.

A text can only match a pattern if it holds every letter group of the pattern's plain parts.
So each pattern meets only the texts that hold its rarest group, and the pattern itself is
checked there. A part of up to :data:`GRAM` letters is a group as a whole, a longer one gives
all its runs of that length: however many texts there are, a pattern meets few that don't match.

Only groups that some pattern has are looked for in the texts, of the lengths that occur, and
those found are stored, so plans know their true number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.keyed_join import one_per_key, only_keys_of
from sedimenta.sources.workspace import stash

GRAM = 16


def _grams(part: Column) -> Column:
    """A part without its wildcards as a whole, or all runs of the greatest length."""
    size = F.least(F.length(part), F.lit(GRAM))
    starts = F.sequence(F.lit(1), F.length(part) - size + 1)
    return F.transform(starts, lambda i: F.substring(part, i, size))


def _postings(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``id, text, gram`` of the texts' groups that patterns have, each group once a text, and a few others."""
    # A small file is one task; what its texts are taken apart into is not small.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = texts.where(F.col("text").isNotNull()).select("id", "text").repartition(parts, "id", "text")
    sizes = keys.agg(F.collect_set(F.length("gram"))).scalar()
    sized = spread.select("id", "text", F.explode(sizes).alias("_size")).where(F.length("text") >= F.col("_size"))
    starts = F.sequence(F.lit(1), F.when(F.col("_size") == 0, 1).otherwise(F.length("text") - F.col("_size") + 1))
    each = sized.select("id", "text", "_size", F.explode(starts).alias("_at"))
    each = each.withColumn("gram", F.substring("text", F.col("_at"), F.col("_size")))
    found = only_keys_of(each, ["gram"], keys.select("gram"))
    first = (F.col("_size") == 0) | (F.position("gram", "text") == F.col("_at"))
    return stash(found.where(first).select("id", "text", "gram"), "postings")


def _met(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, id, text`` of texts that hold the pattern's rarest group, to be checked."""
    # A backslash escapes what follows, so a pattern with one has no parts that are surely plain.
    plain = F.when(F.contains("pattern", F.lit("\\")), F.array().cast("array<string>")).otherwise(F.split("pattern", "[%_]"))
    grams = F.flatten(F.transform(F.filter(plain, lambda p: p != ""), _grams))
    grams = F.when(F.size(grams) > 0, F.array_distinct(grams)).otherwise(F.array(F.lit("")))
    wanted = patterns.where(F.col("pattern").isNotNull()).select("pattern").distinct()
    keys = stash(wanted.select("pattern", F.explode(grams).alias("gram")), "pattern-grams")
    postings = _postings(texts, keys)
    # Stored texts are packed many to a byte; neither they nor their counts go to all tasks, however small the files.
    counts = one_per_key(postings, ["gram"], F.count("*").alias("n")).hint("merge")
    rarest = keys.join(counts, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key"))
    return rarest.select("pattern", F.col("key.gram").alias("gram")).join(postings.hint("merge"), "gram").select("pattern", "id", "text")


def matching_pairs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows ``pattern, id`` of patterns that stand anywhere in a text; ``%`` and ``_`` are wildcards.

    ``texts`` has ``id`` and ``text``, ``patterns`` has ``pattern``. Null texts and patterns
    match nothing. A pattern of wildcards only matches every text that is long enough.
    """
    # A pattern that changes from row to row is costly to prepare, so plain ones are looked for as they are.
    anywhere = F.like("text", F.concat(F.lit("%"), F.col("pattern"), F.lit("%")))
    hit = F.when(F.col("pattern").rlike(r"[%_\\]"), anywhere).otherwise(F.contains("text", "pattern"))
    return _met(texts, patterns).where(hit).select("pattern", "id")
