"""Byte-level BPE encoding and decoding as a reduction over a tree.

A piece of text is halved until its parts are short, the parts are encoded, and neighbours are
joined: the tokens around the seam are encoded again in a window that doubles until its
outermost tokens come out unchanged. A sequence of tokens is the encoding of its bytes if every
two neighbours are the encoding of theirs, so tokens outside such a window are final. Decoding
joins the bytes of the halves up the tree.

Cases: a null text counts as empty and has no tokens. Repeated rows get the same result. Text of
any length is whole; the window, not the text, bounds what is encoded again. Bytes that are no
valid text do not occur in Spark strings. Other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import textbytes as tb
from sedimenta.llm.pretokens import PieceEncoder

LEAF_BYTES = 24
_LEAF_IDS = 4096


class TreeCodec:
    """Encoder and decoder for a table of token ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Encoding of a short run of bytes: the pair of lowest rank is joined first, leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        scores = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            known = [s for s in scores if s is not None]
            if not known:
                return [self.ranks[p] for p in parts]
            i = scores.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = rank(parts[i] + parts[i + 1])
            if i:
                scores[i - 1] = rank(parts[i - 1] + parts[i])

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two neighbouring encoded runs."""
        size = 2
        while True:
            a, b = left[-size:], right[:size]
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, a + b)))
            left_done = len(a) == len(left) or window[0] == a[0]
            right_done = len(b) == len(right) or window[-1] == b[-1]
            if left_done and right_done:
                return left[: len(left) - len(a)] + window + right[len(b) :]
            size *= 2

    def reduce(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.reduce(piece[:half]), self.reduce(piece[half:]))

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token stays whole."""
        if not piece:
            return []
        own = self.ranks.get(piece)
        return [own] if own is not None else self.reduce(piece)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, concatenated up the tree."""
        if len(ids) <= _LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=1)
def codec(path: str) -> TreeCodec:
    """The codec of a rank file; read once per worker."""
    with open(path, "rb") as lines:
        return TreeCodec({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    own = codec(path)
    return PieceEncoder(lambda pieces: [own.encode(p) for p in pieces])


def encode(docs: DataFrame, path: str, out: str = "ids") -> DataFrame:
    """The documents without their text, with an array of ids."""
    return _run(docs, path, [(out, "array<int>")], lambda ids, _: (ids.astype(np.int32),))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """The documents without their text, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""

    def digest(ids: np.ndarray, own: TreeCodec) -> tuple:
        little = ids.astype("<u4").tobytes()
        return len(ids), hashlib.sha256(little).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _run(docs, path, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], digest)


def _run(docs: DataFrame, path: str, made: list[tuple[str, str]], each) -> DataFrame:
    new = [name for name, _ in made]
    names = [c for c in docs.columns if c != "text" and c not in new]
    like = docs.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(t).alias(n) for n, t in made])
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, own = _encoder(path), codec(path)
        for batch in batches:
            for part in tb.chunks(batch):
                ids, bounds = encoder(*tb.buffers(part["text"]))
                rows = [each(ids[bounds[i] : bounds[i + 1]], own) for i in range(part.num_rows)]
                columns = [pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names], *columns], names=[*names, *new])

    return docs.mapInArrow(run, like.schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Rows with a column of ids as text; a null or empty array gives an empty text."""

    @F.pandas_udf("string")
    def texts(values):
        own = codec(path)
        return values.map(lambda v: "" if v is None else own.decode(np.asarray(v)).decode("utf-8", "replace"))

    return rows.withColumn(out, texts(F.col(ids)))
