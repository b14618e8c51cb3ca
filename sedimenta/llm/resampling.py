"""Importance resampling towards a target: bucket gains, noisy scores, ranks by radix sort.

Features (runs of words) fall into a fixed number of buckets. The log ratio of target to
source counts of each bucket is its gain; a document's weight is the sum of the gains of its
features, looked up in one array. With Gumbel noise from a hash of its id a document's score
makes the highest ones a draw without replacement in proportion to exp(weight).

Ranks come from a distributed least-significant-digit radix sort: rows lie in blocks of equal
numbers of positions; each pass counts a digit per block, prefix sums over (digit, block) give
the place where each block's rows with that digit go, and a row's place there is its number
among them. Equal digits keep their order, so after the last digit the position is the rank.
Blocks hold positions, not values, so repeated keys never make one larger. Digits that are
the same in all rows cost no pass.

Cases: null texts hold no words. Documents with too few words are scored but not drawn. Ties go to the smaller id;
rows without an id come last among equals, rows that are equal in all columns are interchangeable but have
ranks of their own. Empty tables give empty results, an empty target gains from its smoothing alone. Texts of any length are
read in pieces cut between words. Other columns aren't carried.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.storage import stash
from sedimenta.llm.textbytes import LOWER, buffers, chunks

PIECE_BYTES = 1 << 20
DIGIT_BITS = 12
_SPACE = 0x20
_LONG_WORD = 64  # bytes; longer features are summed one by one
_TABLE = np.array(
    [reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)], np.uint32
)
#: Bytes of words, before lower-casing: digits, letters, all that isn't ASCII.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, all spans at once."""
    out = np.empty(len(starts), np.uint32)
    sizes = ends - starts
    for i in np.flatnonzero(sizes > _LONG_WORD).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    short = np.flatnonzero(sizes <= _LONG_WORD)
    order = short[np.argsort(-sizes[short], kind="stable")]
    begin, left = starts[order], np.bincount(sizes[order], minlength=1)
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    open_ = len(order)
    for k in range(len(left) - 1):
        open_ -= left[k]
        crc[:open_] = _TABLE[(crc[:open_] ^ data[begin[:open_] + k]) & 0xFF] ^ (crc[:open_] >> 8)
    out[order] = crc ^ 0xFFFFFFFF
    return out


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds of texts); a long text comes in several pieces, cut between words."""
    row = 0
    for chunk in chunks(batch, "text", PIECE_BYTES):
        data, offsets = buffers(chunk["text"])
        if len(data) <= PIECE_BYTES:
            yield row, data, offsets
        else:
            at = 0
            while at < len(data):
                end = at + PIECE_BYTES
                while end < len(data):  # on to the next byte that is in no word
                    gap = np.flatnonzero(~_SOLID[data[end : end + PIECE_BYTES]])
                    if len(gap):
                        end += int(gap[0])
                        break
                    end += PIECE_BYTES
                part = data[at:end]
                yield row, part, np.array([0, len(part)])
                at = end
        row += chunk.num_rows


def feature_buckets(data: np.ndarray, bounds: np.ndarray, width: int, n_buckets: int, carry: bytes = b""):
    """Text number and bucket of each feature, the words of each text, and what the next piece of the last text needs.

    ``carry`` holds the last ``width - 1`` words of the piece before; features that end in it are not given again.
    """
    solid = _SOLID[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first = solid & (edge[:-1] | ~np.append(False, solid[:-1]))
    last = solid & (edge[1:] | ~np.append(solid[1:], False))
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(bounds, starts, "right") - 1
    low = LOWER[data]
    if width == 1:
        return text, crc32_of(low, starts, ends) % n_buckets, np.bincount(text, minlength=len(bounds) - 1), b""
    # Words side by side with one space between, so that a feature is a span too.
    sizes = ends - starts + 1
    joined = np.full(int(sizes.sum()), _SPACE, np.uint8)
    put = np.cumsum(sizes) - sizes
    inside = np.repeat(starts - put, sizes) + np.arange(len(joined))
    keep = np.repeat(put + sizes - 1, sizes) != np.arange(len(joined))
    joined[keep] = low[inside[keep]]
    head = np.frombuffer(carry, np.uint8)
    carried = carry.count(b" ")
    buffer_ = np.concatenate([head, joined])
    edges = np.flatnonzero(buffer_ == _SPACE)
    begin = np.concatenate([[0], edges[:-1] + 1]) if len(edges) else edges
    owner = np.concatenate([np.zeros(carried, np.int64), text])
    texts, found = [], []
    for run in range(1, width + 1):
        n = len(begin) - run + 1
        if n <= 0:
            break
        ok = (owner[:n] == owner[run - 1 :]) & (np.arange(n) + run - 1 >= carried)
        texts.append(owner[:n][ok])
        found.append(crc32_of(buffer_, begin[:n][ok], edges[run - 1 :][ok]) % n_buckets)
    of_last = begin[owner == len(bounds) - 2][-(width - 1) :]
    rest = buffer_[of_last[0] :].tobytes() if len(of_last) else b""
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *texts]), np.concatenate([none, *found]).astype(np.int64), np.bincount(text, minlength=len(bounds) - 1), rest


def _features(batch: pa.RecordBatch, width: int, n_buckets: int):
    """(first row, text numbers, buckets, words of each text) piece by piece."""
    row, carry = -1, b""
    for at, data, bounds in _pieces(batch):
        carry = carry if at == row else b""
        text, bucket, words, carry = feature_buckets(data, bounds, width, n_buckets, carry)
        row = at
        yield at, text, bucket, words
        if len(bounds) > 2:
            row = -1


def bucket_counts(texts: DataFrame, width: int = 1, n_buckets: int = 10_000) -> DataFrame:
    """Rows ``bucket, n``: features of the column ``text`` per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, _, bucket, _ in _features(batch, width, n_buckets):
                total += np.bincount(bucket, minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """1000 times the log ratio of smoothed target and source shares of each bucket, rounded down.

    Two arrays of ``n_buckets`` counts are all that reaches the driver.
    """
    both = []
    for counts in (source, target):
        array = np.zeros(n_buckets, np.int64)
        for r in counts.collect():
            array[r["bucket"]] = r["n"]
        both.append(array.tolist())
    big, small = float(sum(both[0]) + n_buckets), float(sum(both[1]) + n_buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * big / ((s + 1) * small))) for s, t in zip(*both)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, width: int = 1) -> DataFrame:
    """Rows ``doc_id, n_words, n_features, weight``, one per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for at, text, bucket, count in _features(batch, width, len(gain)):
                here = slice(at, at + len(count))
                words[here] += count
                n[here] += np.bincount(text, minlength=len(count))
                np.add.at(weight, at + text, gain[bucket])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(words), pa.array(n), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 2024) -> Column:
    """1000 times a Gumbel draw from the hash of seed and id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


# --- radix sort ----------------------------------------------------------------------------


def _unsigned(key: Column, ascending: bool) -> Column:
    """A long whose bits, read as an unsigned number, sort like the key; nulls are told apart by a digit of their own."""
    bits = F.coalesce(key.cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(2**63)))
    return bits if ascending else F.bitwise_not(bits)


def _pass(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable counting sort: ``_place`` becomes the row's place, from 0, in the order of the digit."""
    rows = rows.withColumn("_digit", digit)
    hist = rows.groupBy("_block", "_digit").agg(F.count("*").alias("n"))
    # Rows with smaller digits, over all blocks; then rows with this digit in blocks before.
    ahead = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    totals = hist.groupBy("_digit").agg(F.sum("n").alias("n"))
    totals = totals.select("_digit", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"))
    earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select("_block", "_digit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_ahead"))
    offsets = offsets.join(totals, "_digit").select("_block", "_digit", (F.col("_before") + F.col("_ahead")).alias("_offset"))
    number = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_place"))
    placed = rows.withColumn("_number", number).join(offsets, ["_block", "_digit"])
    return placed.withColumn("_place", F.col("_offset") + F.col("_number") - 1).drop("_digit", "_number", "_offset")


def radix_rank(
    rows: DataFrame, keys: list[tuple[str, bool]], rank: str = "rank", digit_bits: int = DIGIT_BITS, blocks: int | None = None
) -> DataFrame:
    """The rows with their rank, from 1, in the order of long keys given as (column, ascending), nulls last.

    ``blocks`` (twice the shuffle partitions) is how many pieces of equal size a pass works on.
    """
    spark = rows.sparkSession
    names = [f"_key{i}" for i in range(len(keys))]
    flags = [f"_null{i}" for i in range(len(keys))]
    keyed = rows.select(
        "*", *[_unsigned(F.col(c), up).alias(k) for (c, up), k in zip(keys, names)],
        *[F.col(c).isNull().cast("long").alias(f) for (c, _), f in zip(keys, flags)],
    )
    # A row's first place is its place in the stored files; only its being fixed matters.
    now = stash(keyed, "radix")
    parts = [*names, *flags]
    seen = now.agg(
        F.count("*").alias("n"), *[F.coalesce(F.expr(f"bit_or({c}) ^ bit_and({c})"), F.lit(0)).alias(c) for c in parts]
    ).first()
    blocks = blocks or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, -(-seen["n"] // blocks))
    digits = []
    for key, flag in reversed(list(zip(names, flags))):
        varies = seen[key] & (2**64 - 1)
        for at in range(0, 64, digit_bits):
            if varies >> at & ((1 << digit_bits) - 1):
                digits.append(F.shiftrightunsigned(F.col(key), at).bitwiseAND((1 << digit_bits) - 1))
        if seen[flag]:
            digits.append(F.col(flag))
    now = now.withColumn("_place", F.monotonically_increasing_id())
    now = now.withColumn("_block", F.pmod(F.xxhash64("_place"), F.lit(blocks)))
    if not digits:
        digits = [F.lit(0).cast("long")]
    for digit in digits:
        now = _pass(now, digit)
        now = stash(now.withColumn("_block", F.floor(F.col("_place") / F.lit(size))), "radix")
    return now.withColumn(rank, F.col("_place") + 1).drop("_place", "_block", *parts)


def draw(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, width: int = 1, n_buckets: int = 10_000,
    seed: int = 2024,
) -> DataFrame:
    """Rows ``doc_id, n_features, weight, score, rank``; the rank is null for documents that aren't drawn.

    Of the documents with enough words, ``percent`` in a hundred are drawn, the highest scores first.
    """
    gain = gains(bucket_counts(docs, width, n_buckets), bucket_counts(target, width, n_buckets), n_buckets)
    scored = weights(docs, gain, width).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stash(scored, "scores")
    fit = scored.where(F.col("n_words") >= min_words)
    wanted = fit.count() * percent // 100
    ranked = radix_rank(fit, [("score", False), ("doc_id", True)])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("n_words")
