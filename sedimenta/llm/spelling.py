"""Spelling variants: words one edit apart, found by dense tiles of code-point matrices.

Two words differ by one inserted, deleted or replaced code point exactly when their common
prefix and common suffix together reach the longer length less one. With lengths ``c`` and
``c`` or ``c + 1`` the prefix length falls into one of a few bands of 0 to ``c``, and in each band both words share the
prefix up to the band's start and the suffix from its end on. So words meet only where both
agree; there padded matrices of their code points are compared tile by tile, and only in the
columns that the band leaves open. A key with more words than a block holds is cut into
blocks, and every two blocks make a task. Tiles give a count and the best neighbour of each
word, never pairs.

Cases: null and empty texts hold no words. Rows without a doc_id damage words as an empty id
would. Repeated rows count again. Words of any length are compared whole. An empty table gives
an empty result. Other columns of the documents aren't read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.line_dedup import LOWER, UPPER
from sedimenta.llm.storage import stash

#: Fixed value: the letters of words.
LETTERS = "A-Za-zÀ-ÿ"
BANDS = 3
BLOCK_CELLS = 1 << 15  # code points in a block of one key, two words at least
TILE = 512  # words on each side of a tile
BUCKET_ROWS = 5000  # rows of small keys that share a task's group


def damaged(word: Column, doc_id: Column, every: int = 199) -> Column:
    """The word as some documents spell it: one of ``every`` (document, word) pairs loses a code point."""
    draw = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (draw % F.length(word)).cast("int")
    cut = F.concat(F.left(word, at), F.substring(word, at + 2, F.length(word)))
    return F.when(draw % every == 0, cut).otherwise(word)


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, every: int | None = 199) -> DataFrame:
    """Rows ``word, n`` of all words with enough code points and occurrences."""
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))
    low = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))
    words = low.select((F.col("word") if every is None else damaged(F.col("word"), F.col("doc_id"), every)).alias("word"))
    counted = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


# --- tiles ---------------------------------------------------------------------------------


def _matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points aligned at the first and at the last one, the rest filled with zeros."""
    codes = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, width)
    back = np.frombuffer("".join(w[::-1].ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, width)
    kind = np.uint8 if codes.max(initial=0) < 256 else np.uint32
    return np.ascontiguousarray(codes.T.astype(kind)), np.ascontiguousarray(back.T.astype(kind))


def _shared(a: np.ndarray, b: np.ndarray, first: int, last: int) -> np.ndarray:
    """Columns from ``first`` up to ``last`` that agree before the first difference, for all pairs."""
    same = np.ones((a.shape[1], b.shape[1]), bool)
    out = np.zeros(same.shape, np.int32)
    for x, y in zip(a[first:last], b[first:last]):
        same &= x[:, None] == y[None, :]
        if not same.any():
            break
        out += same
    return out


def _tiles(words: list[str], short: int, band: tuple[int, int], sides: tuple[np.ndarray, np.ndarray]):
    """Near words of a key: yields (row, count, best row) for the two sides given by row numbers.

    Rows are in the order of preference, so the best neighbour is the first one. ``band`` has
    the bounds of the common prefix; ``short`` is the smaller length.
    """
    low, high = band
    front, back = _matrices(words, short + 1)
    long_ = np.array([len(w) for w in words]) > short
    left, right = sides
    for i in range(0, len(left), TILE):
        a = left[i : i + TILE]
        for j in range(0, len(right), TILE):
            b = right[j : j + TILE]
            longer = long_[a][:, None] | long_[b][None, :]
            prefix = low + _shared(front[:, a], front[:, b], low, high + 1)
            known = short - high
            suffix = known + _shared(back[:, a], back[:, b], known, short - low + 1)
            near = (prefix + suffix >= short - 1 + longer) & ~(long_[a][:, None] & long_[b][None, :]) & (a[:, None] != b[None, :])
            # The last band goes on to the end of the shorter word.
            near &= prefix <= high if high == short else prefix < high
            for rows, others, hits in ((a, b, near), (b, a, near.T)):
                some = np.flatnonzero(hits.any(axis=1))
                yield rows[some], hits[some].sum(axis=1), others[hits[some].argmax(axis=1)]
                if left is right:
                    break  # the other half comes from the mirrored tile


def _band_edges(short: int, bands: int) -> list[int]:
    return [i * short // bands for i in range(bands + 1)]


def compare_group(words: list[str], counts: list[int], short: int, band: int, blocks: list[int] | None = None, bands: int = BANDS):
    """Near counts and best neighbours of the words that share a key: (word, n_near, best word, its n).

    With ``blocks``, 0 or 1 for each word, only words of different blocks are compared.
    """
    rank = sorted(range(len(words)), key=lambda r: (-counts[r], words[r]))
    ordered = [words[r] for r in rank]
    edges = _band_edges(short, bands)
    every = np.arange(len(words))
    sides = (every, every)
    if blocks is not None:
        block = np.array(blocks)[rank]
        sides = (every[block == 0], every[block == 1])
    total, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for rows, n, first in _tiles(ordered, short, (edges[band], edges[band + 1]), sides):
        total[rows] += n
        best[rows] = np.minimum(best[rows], first)
    for r in np.flatnonzero(total).tolist():
        yield ordered[r], int(total[r]), ordered[best[r]], counts[rank[best[r]]]


def _compare_bucket(bands: int):
    def run(table: pa.Table) -> pa.Table:
        groups: dict[tuple, dict[str, tuple[int, int]]] = defaultdict(dict)
        i, j = (table["group"][0][f].as_py() for f in "ij")
        for word, n, short, band, part in zip(*(table[c].to_pylist() for c in ("word", "n", "short", "band", "part"))):
            edges = _band_edges(short, bands)
            tail = word[len(word) - (short - edges[band + 1]) :]
            groups[short, band, word[: edges[band]], tail][word] = (n, part)
        found = []
        for (short, band, _, _), members in groups.items():
            if len(members) > 1:
                counts, parts = zip(*members.values())
                blocks = [int(p == j) for p in parts] if i != j else None
                found += compare_group(list(members), list(counts), short, band, blocks, bands)
        names = ["word", "near", "best", "best_n"]
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)

    return run


# --- the whole -----------------------------------------------------------------------------


def _keys(words: DataFrame, bands: int) -> DataFrame:
    """Each word as the shorter and as the longer one of a pair, in every band, with the key it meets others under."""
    size = F.length("word")
    each = words.withColumn("short", F.explode(F.array(size, size - 1))).where(F.col("short") >= F.lit(bands))
    each = each.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    edge = lambda i: F.floor(i * F.col("short") / bands).cast("int")
    head = F.left("word", edge(F.col("band")))
    tail = F.right("word", F.col("short") - edge(F.col("band") + 1))
    return each.withColumn("key", F.xxhash64("short", "band", head, F.lit("\0"), tail))


def near_words(words: DataFrame, bands: int = BANDS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Rows ``word, n_near, best`` of words with near words; best has the near word that occurs most.

    ``words`` has distinct ``word`` of at least ``bands`` code points and ``n``.
    """
    keyed = _keys(words, bands)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.max("short").alias("short"))
    per_block = F.greatest(F.lit(2), F.floor(F.lit(block_cells) / F.col("short")))
    large = sizes.where(F.col("rows") > per_block).select("key", F.ceil(F.col("rows") / per_block).cast("int").alias("blocks"))
    large = stash(large, "large-keys")
    buckets = F.lit(words.count() * 2 * bands // BUCKET_ROWS + 1)
    whole = keyed.join(large, "key", "left_anti").withColumn("part", F.lit(0))
    whole = whole.withColumn("group", F.struct(F.pmod("key", buckets).alias("k"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda p: F.struct(F.col("key").alias("k"), F.least("part", p).alias("i"), F.greatest("part", p).alias("j")),
    )
    split = keyed.join(large, "key").withColumn("part", own).withColumn("group", F.explode(pairs)).drop("blocks")
    rows = whole.unionByName(split).select("group", "word", "n", "short", "band", "part")
    compared = rows.groupBy("group").applyInArrow(_compare_bucket(bands), "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    return compared.groupBy("word").agg(F.sum("near").alias("n_near"), best)


def _roots(forms: DataFrame) -> DataFrame:
    """Rows ``word, root`` of words that have a form: the end of the chain, in doubling steps."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stash(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        moved = now.where(F.col("next").isNotNull()).isEmpty()
        now = now.drop("next")
        if moved:
            return now


def group_variants(words: DataFrame, ratio: int = 5, bands: int = BANDS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """The words with ``n_near``, ``form``, ``form_n`` and ``root``.

    A word's form is its near word that occurs most (ties: the smallest), if that occurs at
    least ``ratio`` times as often as the word itself.
    """
    words = stash(words.select("word", "n"), "words")
    near = stash(near_words(words, bands, block_cells), "near")
    joined = words.join(near, "word", "left")
    often = -F.col("best.less") >= ratio * F.col("n")
    formed = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"),
    )
    formed = stash(formed, "forms")
    roots = _roots(formed.where(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
