"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Pieces are dealt by hash to shards of a bounded expected size, so a third of all documents of
one kind is spread like any other. Each shard is one packing problem that several islands
evolve from different seeds: crossover injects whole well-filled bins of one parent into the
other, removes the bins that hold the same documents, and puts displaced documents back by best
fit. Between epochs the elite of each island migrates to the next; at the end the best island
of each shard stands.

Cases: a null text counts as empty, one end token. The tokenizer's added tokens keep their own
ids wherever a text holds them, the longest first, as the tokenizer does by default. Only longer texts than a sequence are cut;
their first piece may be shorter. Repeated rows are packed each for itself. An empty table gives
no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import textbytes as tb
from sedimenta.llm.pretokens import PieceEncoder
from sedimenta.llm.storage import stash

CAPACITY = 2048
SHARD_PIECES = 2000
ISLANDS, EPOCHS = 2, 2
POPULATION, CHILDREN = 3, 6
# Sequence numbers that each shard has to itself.
_BINS = 1 << 32


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    """Encodes single pieces by the tokenizer's model, which works on bytes shown as characters."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    # The usual table of byte-level BPE: printable bytes show as themselves, the others from 256 on.
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in shown)}

    def encode(pieces: list[bytes]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(p.decode("latin-1").translate(others))] for p in pieces]

    return PieceEncoder(encode)


@lru_cache(maxsize=1)
def _added(path: str) -> tuple[re.Pattern[bytes] | None, dict[bytes, int]]:
    """A pattern of the tokenizer's added tokens, and their ids."""
    with open(path, encoding="utf-8") as file:
        listed = json.load(file).get("added_tokens") or []
    if any(t.get(k) for t in listed for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what stands beside them are not supported")
    ids = {t["content"].encode(): t["id"] for t in listed}
    return (re.compile(b"|".join(re.escape(t) for t in sorted(ids, key=len, reverse=True))) if ids else None), ids


def _text_ids(encoder: PieceEncoder, path: str, texts: pa.Array) -> list[np.ndarray]:
    """Ids of each text: those of the parts between added tokens, and of the tokens themselves."""
    data, offsets = tb.buffers(texts)
    pattern, numbers = _added(path)
    whole = data.tobytes()
    if pattern is None or not pattern.search(whole):
        ids, bounds = encoder(data, offsets)
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]
    parts: list[bytes] = []
    marks: list[list[int]] = []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        text, at, met = whole[a:b], 0, []
        for m in pattern.finditer(text):
            parts.append(text[at : m.start()])
            met.append(numbers[m[0]])
            at = m.end()
        parts.append(text[at:])
        marks.append(met)
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    ids, bounds = encoder(np.array(bytearray(b"".join(parts)), np.uint8), ends)
    out, k = [], 0
    for met in marks:
        own = [ids[bounds[k] : bounds[k + 1]]]
        for i, number in enumerate(met, k + 1):
            own += [np.array([number], ids.dtype), ids[bounds[i] : bounds[i + 1]]]
        out.append(np.concatenate(own))
        k += len(met) + 1
    return out


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""
    schema = docs.select("doc_id").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for part in tb.chunks(batch):
                rows = []
                for i, ids in enumerate(_text_ids(encoder, path, part["text"])):
                    own = np.append(ids, end_id).astype("<u4")
                    first = (len(own) - 1) % capacity + 1
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    rows += [(i, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                place, piece, start, length, crc = (np.array(c) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(place)), pa.array(piece, pa.int32()),
                     *[pa.array(c, pa.int64()) for c in (start, length, crc)]],
                    names=schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Bins:
    """A packing: items and fill of each bin, and which bins have how much room."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def add(self, items: list[int], fill: int) -> None:
        self.items.append(items)
        self.fill.append(fill)

    def best_fit(self, loose: list[int]) -> None:
        """Put items, largest first, where the least room is left."""
        rooms: dict[int, list[int]] = {}
        mask = 0
        for b, f in enumerate(self.fill):
            if f < self.capacity:
                rooms.setdefault(self.capacity - f, []).append(b)
                mask |= 1 << (self.capacity - f)
        for item in loose:
            size = self.sizes[item]
            wide = mask >> size
            if wide:
                room = (wide & -wide).bit_length() - 1 + size
                b = rooms[room].pop()
                if not rooms[room]:
                    mask ^= 1 << room
                self.items[b].append(item)
                self.fill[b] += size
            else:
                b = len(self.items)
                self.add([item], size)
                room = self.capacity
            left = room - size
            if left:
                rooms.setdefault(left, []).append(b)
                mask |= 1 << left

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.fill), float(np.square(np.array(self.fill, float) / self.capacity).sum())


def first_packing(sizes: list[int], capacity: int, rng: np.random.Generator, noise: float) -> Bins:
    order = np.argsort(-np.array(sizes) * (1 + noise * rng.random(len(sizes))), kind="stable").tolist()
    out = Bins(sizes, capacity)
    out.best_fit(order)
    return out


def crossover(one: Bins, other: Bins, rng: np.random.Generator, share: float = 0.3) -> Bins:
    """The other's well-filled bins, the bins of ``one`` that share no item with them, the rest by best fit."""
    child = Bins(one.sizes, one.capacity)
    fill = np.array(other.fill)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    taken: set[int] = set()
    for b in rng.permutation(good)[: max(1, int(share * len(fill)))].tolist():
        child.add(list(other.items[b]), other.fill[b])
        taken.update(other.items[b])
    # A few of the least filled bins are opened as well, so that their items can move.
    open_below = np.quantile(np.array(one.fill), 0.05)
    loose: list[int] = []
    for items, f in zip(one.items, one.fill):
        if f <= open_below and f < one.capacity or not taken.isdisjoint(items):
            loose += [i for i in items if i not in taken]
        else:
            child.add(list(items), f)
    loose.sort(key=lambda i: -one.sizes[i])
    child.best_fit(loose)
    return child


def evolve(sizes: list[int], capacity: int, given: list[Bins], seed: int) -> Bins:
    """The best packing after one epoch on an island."""
    rng = np.random.default_rng(seed)
    people = list(given)
    while len(people) < POPULATION:
        people.append(first_packing(sizes, capacity, rng, 0.0 if not people and seed % ISLANDS == 0 else 0.15))
    floor = -(-sum(sizes) // capacity)
    for _ in range(CHILDREN):
        people.sort(key=Bins.fitness, reverse=True)
        if len(people[0].fill) <= floor:
            break
        a, b = rng.choice(len(people), 2, replace=False).tolist()
        child = crossover(people[min(a, b)], people[max(a, b)], rng)
        people = [*people[: POPULATION - 1], child]
    return max(people, key=Bins.fitness)


_EPOCH = "shard long, island int, row_id long, length long, bin int"


def _epoch(capacity: int, number: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(rows["shard"].iloc[0]), int(rows["island"].iloc[0])
        own = rows[rows["origin"] == island].sort_values("row_id")
        sizes = own["length"].tolist()
        given = []
        for _, solution in rows[rows["bin"] >= 0].groupby("origin"):
            bins = solution.sort_values("row_id")["bin"].to_numpy()
            packed = Bins(sizes, capacity)
            order = np.argsort(bins, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1):
                packed.add(part.tolist(), sum(sizes[i] for i in part.tolist()))
            given.append(packed)
        best = evolve(sizes, capacity, given, (shard * 7919 + number) * ISLANDS + island)
        where = np.zeros(len(sizes), np.int32)
        for b, items in enumerate(best.items):
            where[items] = b
        return pd.DataFrame({"shard": shard, "island": island, "row_id": own["row_id"], "length": sizes, "bin": where})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``row_id, sequence_id, offset`` for rows ``row_id, length``, whose ids are unique."""
    count = pieces.count()
    shards = max(1, -(-count // SHARD_PIECES))
    shard = F.pmod(F.xxhash64("row_id"), F.lit(shards))
    islands = F.array(*[F.lit(i) for i in range(ISLANDS)])
    rows = pieces.select(shard.alias("shard"), F.explode(islands).alias("island"), "row_id", "length").withColumns(
        {"origin": F.col("island"), "bin": F.lit(-1)}
    )
    for number in range(EPOCHS):
        solved = stash(rows.groupBy("shard", "island").applyInPandas(_epoch(capacity, number), _EPOCH), "epoch")
        # Each island's elite goes to itself and to the next island.
        to = F.explode(F.array(F.col("island"), (F.col("island") + 1) % ISLANDS))
        rows = solved.withColumn("origin", F.col("island")).withColumn("island", to)
    fills = solved.groupBy("shard", "island", "bin").agg(F.sum("length").alias("fill"))
    fit = fills.groupBy("shard", "island").agg(F.count("*").alias("bins"), F.sum(F.col("fill") * F.col("fill")).alias("square"))
    best = fit.groupBy("shard").agg(F.min(F.struct("bins", -F.col("square"), "island")).alias("b")).select(
        "shard", F.col("b.island").alias("island")
    )
    chosen = solved.join(best, ["shard", "island"])

    def lay_out(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bin", "row_id"])
        offset = rows["length"].cumsum() - rows["length"]
        offset -= offset.groupby(rows["bin"]).transform("min")
        number = rows["shard"] * _BINS + rows["bin"]
        return pd.DataFrame({"row_id": rows["row_id"], "sequence_id": number, "offset": offset})

    return chosen.groupBy("shard").applyInPandas(lay_out, "row_id long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    pieces = tokenised(docs, path, capacity).withColumn("row_id", F.monotonically_increasing_id())
    pieces = stash(pieces, "pieces")
    placed = pack(pieces.select("row_id", "length"), capacity)
    return pieces.join(placed, "row_id").drop("row_id")
