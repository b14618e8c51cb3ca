"""Removal of long repeated byte strings with run-length compressed suffix indexes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the
corpus, in the same text or another. No index of the whole corpus is ever in one place:

1. Every start of a string belongs to the smallest hash of the short grams inside the string,
   its anchor. Equal strings have equal anchors, so starts with different anchors never need
   to meet, and anchors seen once are done with. Neighbouring starts with one anchor make one
   segment; equal segments collapse to one with a count.
2. The different segments of some anchors fill a bucket of bounded size. Each bucket gets a
   suffix index: the run-compressed Burrows-Wheeler transform, with the suffix positions at
   run ends as samples. Match lengths are computed at the samples only; between them the
   matching statistics stream along the text, one byte less at each step. An anchor with more
   segments than a bucket may hold is cut in parts, and every two parts share a bucket.
3. Long matches are marked in segments, carried to the texts, merged and cut out.

Results are exact up to collisions of 64-bit hashes of segments that share an anchor.

Cases: a null or empty text counts as empty and stays as it is; texts shorter than ``length``
lose nothing. Repeated rows are documents of their own, so their texts repeat. Rows without a
doc_id are worked on like others. An empty table gives an empty result. Texts of any length are read in pieces.
Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.storage import row_key, stash
from sedimenta.llm.textbytes import buffers, chunks

DETAIL = "repeats"
GRAM = 32  # bytes of a gram, a power of two
PIECE_BYTES = 1 << 20  # of text that a task works on at once
SEGMENT_STARTS = 1024  # a longer stretch with one anchor is cut
BUCKET_BYTES = 1 << 20  # of segments that share an index
END = 0xFF  # stands behind each segment; no byte of UTF-8
_TEXT = ["_t1", "_t2"]
_INTERVALS = "_t1 long, _t2 long, start long, size int, anchor long, hash long, again boolean"


# --- anchors -------------------------------------------------------------------------------


def _join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def intervals(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text number, first start, number of starts, anchor and hash of the segments of some texts.

    A segment of ``n`` starts holds ``n + length - 1`` bytes. The last array tells segments
    whose starts go on behind a gram that is their anchor: only these can repeat a string in themselves.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    grams, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:
        grams = _join_hashes(grams[:-size], grams[size:])
        size *= 2
    anchors = _window_min(grams, length - GRAM + 1)
    passed = np.concatenate([[0], np.cumsum(grams[: len(anchors)] == anchors)])
    block = 1 << (length.bit_length() - 1)
    while size < block:
        grams = _join_hashes(grams[:-size], grams[size:])
        size *= 2
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchors)]
    at = np.arange(len(anchors))
    valid = at + length <= bounds[1:][text]
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(anchors)))
    first, count = first[valid[first]], count[valid[first]]
    again = passed[first + count - 1] > passed[first]
    cuts = (count + SEGMENT_STARTS - 1) // SEGMENT_STARTS
    which = np.repeat(np.arange(len(first)), cuts)
    step = (np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * SEGMENT_STARTS
    first, count = first[which] + step, np.minimum(count[which] - step, SEGMENT_STARTS)
    last = first + count + length - 1 - block
    value, place = count.astype(np.uint64), first.copy()
    open_ = np.arange(len(first))
    while len(open_):
        value[open_] = _join_hashes(value[open_], grams[np.minimum(place[open_], last[open_])])
        place[open_] += block
        open_ = open_[place[open_] < last[open_] + block]
    return text[first], first - bounds[text[first]], count, anchors[first], value, again[which]


def _intervals_of(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _INTERVALS.split(", ")]
        for batch in batches:
            for chunk in chunks(batch, "text", PIECE_BYTES):
                data, offsets = buffers(chunk["text"])
                keys = [np.asarray(chunk[c]) for c in _TEXT]
                # A chunk of more than a piece is a single text; its pieces share length - 1 bytes.
                for base in range(0, max(1, len(data) - length + 1), PIECE_BYTES):
                    whole = len(data) <= PIECE_BYTES
                    part = data if whole else data[base : base + PIECE_BYTES + length - 1]
                    bounds = offsets if whole else np.array([0, len(part)])
                    text, start, size, anchor, value, again = intervals(part, bounds, length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[0][text]), pa.array(keys[1][text]), pa.array(start + base),
                         pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(value.view(np.int64)), pa.array(again)],
                        names=names,
                    )
                    if whole:
                        break

    return run


# --- index ---------------------------------------------------------------------------------


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number that sorts like them."""
    key = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    for step in (1, 2, 4):
        key = (key[:-step] << np.uint64(8 * step)) | key[step:]
    return key[: len(data)]


def suffix_array(data: np.ndarray, eights: np.ndarray) -> np.ndarray:
    """Sorted suffix positions by prefix doubling; only suffixes still tied are sorted again."""
    n = len(data)
    order = np.argsort(eights, kind="stable")
    key = eights[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, np.int64)  # behind the end: 0, before all others
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    alone = new & np.append(new[1:], True)
    tied = np.flatnonzero(~alone)  # places in the order
    span = 8
    while len(tied):
        at = order[tied]
        group = rank[at]
        key = (group << 32) | rank[np.minimum(at + span, n)]
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))] + 1
        tied = tied[~(new & np.append(new[1:], True))]
        span *= 2
    return order


def _common(eights: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, at most ``limit``."""
    out = np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(limit > 0)
    n = len(eights)
    while len(open_):
        x, y = a[open_] + out[open_], b[open_] + out[open_]
        inside = (x < n) & (y < n)
        differ = np.where(inside, eights[np.minimum(x, n - 1)] ^ eights[np.minimum(y, n - 1)], np.uint64(1 << 63))
        same = np.full(len(open_), 8)
        for k in range(8):
            same[(differ >> np.uint64(8 * k)) != 0] = 7 - k
        out[open_] += same
        open_ = open_[(same == 8) & (out[open_] < limit[open_])]
    return np.minimum(out, limit)


def matching_statistics(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each segment begins, and for each byte how long a string from there on occurs elsewhere too.

    Strings end with their segment. The last and the first suffix of each run of the
    transform are the samples: the nearest neighbours of all others follow from them.
    """
    sizes = np.array([len(s) for s in segments])
    data = np.frombuffer(bytes([END]).join([*segments, b""]), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    rest = np.repeat(starts + sizes, sizes + 1) - np.arange(len(data))  # bytes up to the end of the segment
    eights = _eights(data)
    order = suffix_array(data, eights)
    before = data[order - 1]  # the transform
    before[order == 0] = END
    ends = before[1:] != before[:-1]
    longest = np.zeros(len(data), np.int64)
    # Samples: run ends, and the first byte of each segment.
    sampled = ends | (before[1:] == END) | (before[:-1] == END)
    for here, there, edge in ((order[1:], order[:-1], order[0]), (order[:-1], order[1:], order[-1])):
        at, other = here[sampled], there[sampled]
        reach = np.full(len(data), -1, np.int64)
        reach[edge] = edge  # has no neighbour on this side
        reach[at] = at + _common(eights, at, other, rest[at])
        last = np.maximum.accumulate(np.where(reach >= 0, np.arange(len(data)), 0))
        longest = np.maximum(longest, reach[last] - np.arange(len(data)))
    return starts, np.minimum(longest, rest)


def long_matches(segments: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment the (from, to) byte ranges that strings found elsewhere too cover."""
    starts, found = matching_statistics(segments)
    out = []
    for begin, text, n in zip(starts, segments, copies):
        hit = np.ones(len(text) - length + 1, bool) if n > 1 else found[begin : begin + len(text) - length + 1] >= length
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        out.append(edge.reshape(-1, 2) + [0, length - 1])
    return out


def _index_bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.stack([np.asarray(table["anchor"]), np.asarray(table["hash"])], axis=1)
        _, pick = np.unique(keys, axis=0, return_index=True)
        body = table["body"].combine_chunks()
        found = long_matches([body[i].as_py() for i in pick.tolist()], np.asarray(table["copies"])[pick], length)
        rows = np.repeat(pick, [len(f) for f in found])
        ranges = np.concatenate(found) if len(found) else np.zeros((0, 2), np.int64)
        return pa.table({"anchor": keys[rows, 0], "hash": keys[rows, 1], "low": ranges[:, 0].astype(np.int64),
                         "high": ranges[:, 1].astype(np.int64)})

    return run


# --- the whole -----------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("_t1"), F.crc32(F.col("text").cast("binary")).alias("_t2"), "text")


def _cut_segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()  # copies of a text give its segments once
        for batch in batches:
            texts, wanted = batch["text"].cast(pa.large_binary()), batch["wanted"]
            for i, key in enumerate(zip(batch["_t1"].to_pylist(), batch["_t2"].to_pylist())):
                if key in done:
                    continue
                done.add(key)
                view, list_ = memoryview(texts[i].as_buffer()), wanted[i].values
                start, size = (np.asarray(list_.field(f)) for f in ("start", "size"))
                body = [bytes(view[a : a + n + length - 1]) for a, n in zip(start.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [list_.field("bucket"), list_.field("anchor"), list_.field("hash"), list_.field("copies"), pa.array(body, pa.binary())],
                    names=["bucket", "anchor", "hash", "copies", "body"],
                )

    return run


def _bucketed(segments: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """The segments with the buckets they go to: one, or one for every two parts of a large anchor."""
    size = F.col("size").cast("long") + length
    total = segments.agg(F.sum(size)).first()[0] or 0
    large = (
        segments.groupBy("anchor").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > bucket_bytes)
        .select("anchor", F.ceil(F.col("bytes") * 2 / bucket_bytes).alias("parts"))
    )
    large = stash(large, "large-anchors")
    number = F.pmod(F.xxhash64("anchor"), F.lit(total // bucket_bytes + 1))
    plain = segments.join(large, "anchor", "left_anti").withColumn("bucket", F.struct(number.alias("a"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    own = F.pmod(F.xxhash64("hash"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts").cast("int") - 1),
        lambda p: F.struct(F.col("anchor").alias("a"), F.least(own, p).alias("i"), F.greatest(own, p).alias("j")),
    )
    split = segments.join(large, "anchor").withColumn("bucket", F.explode(pairs)).drop("parts")
    return plain.unionByName(split.select(*plain.columns))


def repeated_ranges(docs: DataFrame, length: int = 200, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows ``_t1, _t2, ranges``: for each text, by its hashes, the byte ranges that repeat, unsorted."""
    if length < 2 * GRAM:
        raise ValueError(f"strings must have at least {2 * GRAM} bytes")
    texts = _keyed(docs.select("text").where(F.octet_length("text") >= length))
    all_ = stash(texts.mapInArrow(_intervals_of(length), _INTERVALS), "intervals")
    seen = all_.groupBy("anchor").agg((F.count("*") + F.count_if("again")).alias("n")).where("n > 1")
    shared = stash(seen.select("anchor"), "shared-anchors")
    met = stash(all_.drop("again").join(shared, "anchor"), "shared-intervals")
    segments = (
        met.groupBy("anchor", "hash", "size")
        .agg(F.count("*").alias("copies"), F.min(F.struct(*_TEXT, "start")).alias("at"))
        .select("anchor", "hash", "size", "copies", "at.*")
    )
    segments = stash(segments, "segments")
    item = F.struct("start", "size", "bucket", "anchor", "hash", "copies")
    wanted = _bucketed(segments, length, bucket_bytes).groupBy(*_TEXT).agg(F.collect_list(item).alias("wanted"))
    wanted = stash(wanted, "wanted")
    cut = texts.join(wanted, _TEXT).mapInArrow(
        _cut_segments(length), "bucket struct<a: long, i: int, j: int>, anchor long, hash long, copies long, body binary"
    )
    found = cut.groupBy("bucket").applyInArrow(_index_bucket(length), "anchor long, hash long, low long, high long")
    found = stash(found, "long-matches")
    ranges = met.join(found, ["anchor", "hash"]).select(
        *_TEXT, (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")
    )
    return ranges.distinct().groupBy(*_TEXT).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


_CUT = T.StructType(
    [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]
)


def _without(text: bytes, ranges) -> tuple[int, int, bytes]:
    pairs = sorted((r["low"], r["high"]) for r in ranges)
    kept, end, spans = [], 0, 0
    for low, high in pairs:
        if low > end or not spans:
            kept.append(text[end:low])
            spans += 1
        end = max(end, high)
    kept.append(text[end:])
    left = b"".join(kept)
    return len(text) - len(left), spans, left


@F.pandas_udf(_CUT)
def _cut_out(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if t is None else _without(t, r) for t, r in zip(texts, ranges)]
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])


def deduplicate(docs: DataFrame, length: int = 200, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary) in a struct ``DETAIL``.

    If the documents have a column of that name, underscores go before the struct's.
    """
    # Stored, so that the join has a shuffle right under it and copies of one text can be split.
    ranges = stash(repeated_ranges(docs, length, bucket_bytes), "ranges")
    mark, names = row_key(docs, "row"), docs.columns
    body = F.coalesce("text", F.lit("")).cast("binary")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias(mark), F.xxhash64("text").alias("_t1"),
        F.crc32(F.col("text").cast("binary")).alias("_t2"), body.alias("_body"),
    )
    met = packed.join(ranges, _TEXT, "left")
    met = met.withColumn("_cut", _cut_out(F.when(F.col("ranges").isNotNull(), F.col("_body")), F.col("ranges")))
    none = F.lit(0).cast("long")
    detail = F.struct(
        F.octet_length("_body").cast("long").alias("n_bytes"),
        F.coalesce("_cut.n_removed", none).alias("n_removed"),
        F.coalesce("_cut.n_spans", none).alias("n_spans"),
        F.when(F.col("ranges").isNull(), F.col("_body")).otherwise(F.col("_cut.kept")).alias("kept"),
    )
    detail_name = row_key(docs, DETAIL)
    return met.select(*[F.col(mark).getField(c).alias(c) for c in names], detail.alias(detail_name))
