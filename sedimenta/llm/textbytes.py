"""Numpy on the bytes of Arrow text columns: words, shingles and their hashes.

Everything here is a pure function of the bytes, so a repeated task gives the same rows.
Batches are cut into chunks of bounded size first; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD1B54A32D192ED03)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets between them; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, or a single row."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch[column])
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = max(start + 1, min(end, batch.num_rows))
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _common_powers() -> tuple[np.ndarray, np.ndarray]:
    return _make_powers(CHUNK_BYTES)


def _make_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and its inverse; a worker keeps those for a usual chunk only."""
    return _common_powers() if size <= CHUNK_BYTES else _make_powers(size)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes hash alike wherever they stand."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the bounds of each text in the list of words."""
    solid = ~WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text's first byte starts a word even if the text before ends in one
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` lower-cased words, and the bounds of each text.

    A text with fewer words gives its whole sequence as one shingle, one without words none.
    """
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets)
    words = span_hashes(low, starts, ends)
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - bounds[:-1][doc]
    for size in range(1, width + 1):
        pick = counts[doc] >= width if size == width else counts[doc] == size
        begin = np.flatnonzero(pick & (place < np.where(counts[doc] >= width, counts[doc] - width + 1, 1)))
        if not len(begin):
            continue
        value = np.full(len(begin), np.uint64(size))
        for k in range(size):
            value = mix(value * _STEP + words[begin + k])
        out[out_bounds[:-1][doc[begin]] + place[begin]] = value
    return out, out_bounds
