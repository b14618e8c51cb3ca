"""Quality rules with thresholds that follow each language and source.

Counts come from built-in functions over whole texts. For each ratio, a mergeable quantile
sketch (KLL) is built per language and source; sketches of a language merge into one for
groups that are too small, and all of them into one for the rest. A document fails where a
ratio lies beyond its group's upper fence: the group's upper quantile plus a multiple of its
spread, whatever the fence of all documents is. Documents meet their thresholds through a join.

Cases: a null text has no words and fails the base rule. A null language or source is a group
of its own. A constant ratio makes the fence that constant plus the least slack. Repeated rows
each count. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.storage import stash

BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Smallest group with thresholds of its own.
MIN_GROUP = 200
MIDDLE, UPPER_QUANTILE, SPREADS = 0.5, 0.75, 3.0
# Slack of each ratio where a group has no spread: shares of words, characters or lines.
SLACK = {"symbol_share": 0.1, "word_length": 4.0, "dup_line_share": 0.5, "repeat_share": 0.28}


def word_array(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+", -1))


def with_counts(docs: DataFrame, stats: str = "rule_counts") -> DataFrame:
    """The documents with a struct of the base counts, all computed within the row.

    Repeated windows are found by sorting their hashes together with their places: no search
    within a search, whatever a text repeats.
    """
    body = F.coalesce("text", F.lit(""))
    work = docs.withColumns({"_w": word_array(body), "_l": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # Hashes of 2, 4 and 8 words in a row, each from two of the size before.
    work = work.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        later = F.slice(F.col("_h"), step + 1, F.greatest(F.lit(0), F.size("_h") - step))
        now = F.slice(F.col("_h"), 1, F.greatest(F.lit(0), F.size("_h") - step))
        work = work.withColumn("_h", F.zip_with(now, later, lambda a, b: F.xxhash64(a, b)))
    work = work.withColumn("_repeats", F.size(F.array_distinct("_h")) < F.size("_h"))
    place = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    work = work.withColumn("_s", F.when(F.col("_repeats"), F.sort_array(place)))
    near = F.filter(
        F.zip_with(
            F.slice("_s", 1, F.size("_s") - 1), F.slice("_s", 2, F.size("_s") - 1),
            lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)),
        ),
        lambda x: x.isNotNull(),
    )
    work = work.withColumn("_p", F.when(F.col("_repeats"), F.sort_array(F.array_distinct(F.flatten(near)))))
    gaps = F.zip_with(
        F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.size("_p") - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))
    )
    covered = F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, x: s + x)
    counts = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(body, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.when(F.col("_repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return work.withColumn(stats, counts).drop("_w", "_l", "_h", "_repeats", "_s", "_p")


def base_failed(stats: str = "rule_counts", min_words: int = 20, repeat_percent: int = 30) -> Column:
    c = F.col(stats)
    return (c.n_words < min_words) | (100 * c.n_repeat_words > repeat_percent * c.n_words)


def ratios(stats: str = "rule_counts") -> dict[str, Column]:
    c = F.col(stats)
    words = F.greatest(c.n_words, F.lit(1))
    return {
        "symbol_share": c.n_symbols / words,
        "word_length": c.word_chars / words,
        "dup_line_share": c.n_dup_lines / F.greatest(c.n_lines, F.lit(1)),
        "repeat_share": c.n_repeat_words / words,
    }


def _fence(sketch: str, slack: float) -> Column:
    at = lambda q: F.expr(f"kll_sketch_get_quantile_double({sketch}, {q}D)")
    upper = at(UPPER_QUANTILE)
    return upper + F.greatest(SPREADS * (upper - at(MIDDLE)), F.lit(slack))


def thresholds(rows: DataFrame, lang: str, source: str, stats: str, min_group: int = MIN_GROUP) -> DataFrame:
    """Upper fences for every language and source that occurs: a table of groups, not of documents.

    A group of fewer than ``min_group`` documents takes the fence of its language, and that of
    all documents where the language has no more either.
    """
    names = list(SLACK)
    values = rows.select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), *[v.alias(k) for k, v in ratios(stats).items()])
    sketches = values.groupBy("g_lang", "g_source").agg(
        F.count("*").alias("n"), *[F.expr(f"kll_sketch_agg_double({k})").alias(k) for k in names]
    )
    sketches = stash(sketches, "sketches")
    merge = [F.expr(f"kll_merge_agg_double({k})").alias(k) for k in names]
    by_lang = sketches.groupBy("g_lang").agg(F.sum("n").alias("n"), *merge)
    # Without rows there is no sketch to ask.
    overall = sketches.agg(F.sum("n").alias("all_n"), *[F.expr(f"kll_merge_agg_double({k})").alias(f"all_{k}") for k in names]).where("all_n > 0")
    fences = lambda df, tag, *keys: df.select(*keys, F.col("n").alias(f"{tag}_n"), *[_fence(k, SLACK[k]).alias(f"{tag}_{k}") for k in names])
    own = fences(sketches, "own", "g_lang", "g_source")
    lang_wide = fences(by_lang, "lang", F.col("g_lang").alias("l_lang"))
    every = overall.select(*[_fence(f"all_{k}", SLACK[k]).alias(f"all_{k}") for k in names])
    joined = own.join(lang_wide, F.col("g_lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(every))

    def chosen(k: str) -> Column:
        group = F.when(F.col("own_n") >= min_group, F.col(f"own_{k}")).when(F.col("lang_n") >= min_group, F.col(f"lang_{k}"))
        return F.coalesce(group, F.col(f"all_{k}"))

    return joined.select("g_lang", "g_source", *[chosen(k).alias(f"max_{k}") for k in names])


def apply_rules(docs: DataFrame, lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """The documents without their text, with ``rule_counts``, ``base_failed`` and ``kept``.

    Input columns with one of these three names are replaced; all others pass, whatever their names.
    """
    stats, added = "rule_counts", ("rule_counts", "base_failed", "kept")
    names = [c for c in docs.columns if c != "text" and c not in added]
    # A row's own columns travel in one struct, apart from the names that the work needs.
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text", F.col(lang).alias("in_lang"), F.col(source).alias("in_source")
    )
    rows = stash(with_counts(packed, stats).drop("text"), "counts")
    limits = stash(thresholds(rows, "in_lang", "in_source", stats, min_group), "thresholds")
    met = rows.join(limits, F.col("in_lang").eqNullSafe(F.col("g_lang")) & F.col("in_source").eqNullSafe(F.col("g_source")), "left")
    within = F.lit(True)
    for k, value in ratios(stats).items():
        within = within & (value <= F.coalesce(F.col(f"max_{k}"), F.lit(float("inf"))))
    failed = base_failed(stats)
    own = [F.col("row").getField(c).alias(c) for c in names]
    return met.select(*own, stats, failed.alias("base_failed"), (~failed & within).alias("kept"))
