"""The pieces that byte-level BPE works on, found on the bytes of many texts at once.

Each distinct piece is encoded once per worker and remembered up to a bound; texts are then
put together from the remembered pieces by array operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from sedimenta.llm import textbytes as tb

# The splitting pattern, and its white space spelt out (Unicode's White_Space).
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE = "".join(map(chr, _SPACES))
SPLIT = regex.compile(
    "|".join(CONTRACTIONS) + rf"| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_OTHER, _LETTER, _DIGIT, _BLANK, _UNKNOWN = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[32, *range(9, 14)]] = _BLANK
_KIND[128:] = _UNKNOWN
# Pieces that a worker remembers before it starts anew.
REMEMBERED = 500_000


def _kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte; two-byte letters of Latin-1 are known, all else beyond ASCII is not."""
    kinds = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, int)
    tail = data[lead + 1]
    lead = lead[(tail >= 0x80) & (tail != 0x97) & (tail != 0xB7)]
    kinds[lead] = kinds[lead + 1] = _LETTER
    return kinds


def _plain_starts(data: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks of piece starts for texts of known kinds."""
    size = len(data)
    border = np.zeros(size + 1, bool)
    border[offsets] = True
    change = np.ones(size, bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change |= border[:-1]
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], size)
    starts = change.copy()
    # A run of blanks before something else in its text gives its last blank away.
    gives = (kinds[runs] == _BLANK) & ~border[ends]
    last = ends[gives] - 1
    starts[last] = True
    starts[last[data[last] == 32] + 1] = False
    # A lone apostrophe that starts a piece takes the ending of a contraction along.
    quote = runs[(data[runs] == 39) & (ends - runs == 1) & starts[runs] & ~border[ends]]
    quote = quote[kinds[quote + 1] == _LETTER]
    run_end = ends[np.searchsorted(runs, quote + 1)]
    first = data[quote + 1]
    second = np.where(quote + 2 < run_end, data[np.minimum(quote + 2, size - 1)], 0)
    for ending in CONTRACTIONS:
        fits = first == ord(ending[1])
        if len(ending) == 3:
            fits &= second == ord(ending[2])
        at, stop = quote[fits], run_end[fits]
        starts[at + 1] = False
        after = at + len(ending)
        starts[after[after < stop]] = True
    return starts


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pieces, and the bounds of each text in their list."""
    kinds = _kinds(data)
    starts = _plain_starts(data, kinds, offsets) if len(data) else np.zeros(0, bool)
    odd = np.concatenate([[0], np.cumsum(kinds == _UNKNOWN, dtype=np.int64)])
    for i in np.flatnonzero(odd[offsets[1:]] > odd[offsets[:-1]]):
        a, b = offsets[i], offsets[i + 1]
        starts[a:b] = False
        sizes = [len(m.encode()) for m in SPLIT.findall(data[a:b].tobytes().decode())]
        starts[a + np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.int64)]).astype(np.int64)] = True
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], len(data)) if len(begin) else begin
    return begin, end, np.searchsorted(begin, offsets)


class PieceEncoder:
    """Ids of pieces, from a function that encodes new pieces, as flat arrays."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.first = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        for key, ids in zip(hashes, self.encode(pieces)):
            slot = len(self.slots)
            if slot == len(self.first):
                self.first, self.count = np.resize(self.first, 2 * slot), np.resize(self.count, 2 * slot)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            self.first[slot], self.count[slot] = self.used, len(ids)
            self.used += len(ids)
            self.slots[key] = slot

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the bounds of each text in them."""
        begin, end, bounds = split(data, offsets)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        values, where, inverse = np.unique(tb.span_hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self.slots) > REMEMBERED:
            self.forget()
        keys, raw = values.tolist(), data.tobytes()
        new = [i for i, k in enumerate(keys) if k not in self.slots]
        self._learn([keys[i] for i in new], [raw[begin[where[i]] : end[where[i]]] for i in new])
        slot = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))[inverse]
        count = self.count[slot]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.first[slot] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[bounds]
