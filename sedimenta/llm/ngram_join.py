"""Size-aware heavy-light join of word n-gram sets under a Jaccard threshold, exact.

Two sets of sizes n and m link if they share need(n, m) shingles. Small sets enumerate their
subsets of that fixed size: sets with a subset in common are linked, without a check. Large
sets are found by inverted lists. The boundary is the size from which the subsets of a set
would cost more than its lists and the check of its candidates.

Lists work in two steps. First the shingles of a set are dealt by hash to more blocks than a
linked set can differ in, so linked sets have some filled block in common; only sets that share
a block with another set stay active. Then the lists of single shingles are scanned for active
sets, rarest shingles first: tokens before the first common one are all in one set only, so
the sum of both places is at most the difference that the threshold allows. Each list first
compares all its sets with one leader; what that leaves in different components is compared
pair by pair, pruned by size and place. No list is cut, no candidate is dropped.

Equal sets are one node: a document links to its copies through their set. Sets are told apart
by a 64-bit hash, shingles likewise.

Cases: null and blank texts have an empty set and are linked with nothing. Fewer words than a
shingle give the whole sequence as one shingle. Rows that share a doc_id count as the texts they
hold; a null doc_id never names a component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import textbytes as tb
from sedimenta.llm.components import components
from sedimenta.llm.storage import stash

# Cost of a list entry, and of a shingle that a check reads, against that of a subset.
LIST_COST, CHECK_COST = 1.0, 1.0
# Standard deviations between the expected number of filled blocks and the number needed.
MARGIN = 6.0
# Signatures that one task sorts at a time.
BUCKET_ENTRIES = 400_000
# Rows up to which the wanted sets are sent to all tasks; beyond, texts are shuffled instead.
BROADCAST_ROWS = 1_000_000
# Signatures and sets travel as 40 bits each; a bucket fixes further bits of the signature.
_ENTRY = np.dtype([("sig", "<u4"), ("sig_high", "u1"), ("set", "<u4"), ("set_high", "u1")])
_ID_BITS = 40
_ID_MASK = (1 << _ID_BITS) - 1


@dataclass(frozen=True)
class Window:
    """Sizes lo..hi whose sets share block signatures, and the number of blocks."""

    lo: int
    hi: int
    blocks: int


@dataclass(frozen=True)
class Threshold:
    """Two sets link if percent * union <= 100 * intersection; blocks can't tell sets apart below 75."""

    percent: int

    def __post_init__(self) -> None:
        if not 75 <= self.percent <= 100:
            raise ValueError("the threshold must be from 75 to 100 percent")

    def need(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))

    def partners(self, n: int) -> range:
        return range(max(1, -(-self.percent * n // 100)), 100 * n // self.percent + 1)

    def differ(self, total: int) -> int:
        """Most elements in one set only, for linked sets of this total size or less."""
        return max(t - 2 * -(-self.percent * t // (100 + self.percent)) for t in range(max(0, total - 2), total + 1))

    def subsets(self, n: int, below: int) -> int:
        return sum(comb(n, self.need(n, m)) for m in self.partners(n) if m < below)

    @property
    def boundary(self) -> int:
        """First size whose subsets cost more than its lists."""
        n = 1
        while self.subsets(n, 1 << 30) <= (LIST_COST + CHECK_COST) * n:
            n += 1
        return n

    def window(self, lo: int) -> Window:
        # Three steps of linkable sizes: wider windows need more blocks, narrower ones overlap more.
        hi = max(lo + 1, int(lo * (100 / self.percent) ** 3))
        wanted = self.differ(2 * hi) + 1
        blocks = wanted
        while True:
            load = lo / blocks
            spread = blocks * exp(-load) * max(0.0, 1 - (1 + load) * exp(-load))
            if blocks * (1 - exp(-load)) - MARGIN * sqrt(spread) >= wanted or blocks > 40 * lo:
                return Window(lo, hi, blocks)
            blocks += max(1, blocks // 64)

    @lru_cache(maxsize=4)  # noqa: B019
    def windows(self, most: int) -> list[Window]:
        """All windows that begin at a size or below; every two sizes that can link lie in one of them.

        A size lies in the same windows whatever the largest size is.
        """
        out = [self.window(max(1, -(-self.percent * self.boundary // 100)))]
        while True:
            hi = out[-1].hi
            lo = self.percent * hi // 100
            while 100 * lo // self.percent <= hi:
                lo += 1
            lo = max(lo, out[-1].lo + 1)
            if lo > most:
                return out
            out.append(self.window(lo))

    def column_need(self, n: Column, m: Column) -> Column:
        return F.ceil(F.lit(self.percent) * (n + m) / F.lit(100 + self.percent))

    def column_links(self, n: Column, m: Column, shared: Column) -> Column:
        return 100 * shared >= self.percent * (n + m - shared)


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, and their bounds."""
    raw, bounds = tb.shingles(data, offsets, width)
    parts = [np.unique(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else raw), np.concatenate([[0], np.cumsum(sizes)])


def _set_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(tokens ^ np.uint64(0xA5A5A5A5)))])
    return tb.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def _light_keys(tokens: np.ndarray, rule: Threshold, boundary: int) -> tuple[list[int], list[int]]:
    """Keys of all subsets through which a small set can link, and its side of each."""
    n = len(tokens)
    keys, sides = [], []
    mixed = tb.mix(tokens ^ np.uint64(0x5BD1E995))
    whole = int(mixed.sum(dtype=np.uint64))
    values = mixed.tolist()
    for m in rule.partners(n):
        c = rule.need(n, m)
        if m >= boundary or c > min(n, m) or (n == m == c):
            continue
        salt = (min(n, m) << 20 | max(n, m)) * 0x9E3779B97F4A7C15
        for out in combinations(values, n - c):
            keys.append((whole - sum(out) + salt) & (2**64 - 1))
            sides.append(0 if n < m else 1 if n > m else 2)
    return keys, sides


def _signatures(
    tokens: np.ndarray, bounds: np.ndarray, rule: Threshold, boundary: int, seed: int
) -> tuple[list[np.ndarray], np.ndarray]:
    """Block signatures of each set, and whether some set filled too few blocks to be sure of a match."""
    sizes = np.diff(bounds)
    found: list[list[np.ndarray]] = [[] for _ in sizes]
    weak = np.zeros(len(sizes), bool)
    top = int(sizes.max()) if len(sizes) else 0
    for w in rule.windows(1 << max(8, top.bit_length())):
        inside = np.flatnonzero((sizes >= w.lo) & (sizes <= w.hi))
        if not len(inside):
            continue
        count = sizes[inside]
        ends = np.cumsum(count)
        flat = tokens[np.repeat(bounds[inside] - (ends - count), count) + np.arange(ends[-1])]
        salted = tb.mix(flat ^ np.uint64((w.lo * 0x632BE59BD9B4E019 + seed * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        block = (salted % np.uint64(w.blocks)).astype(np.int64)
        place = np.repeat(np.arange(len(inside)), count) * w.blocks + block
        order = np.argsort(place, kind="stable")
        place, values = place[order], tb.mix(salted[order])
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sums = np.add.reduceat(values, start)
        own = place[start]
        sigs = tb.mix(sums + (own % w.blocks).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(w.lo))
        filled = np.searchsorted(own, np.arange(len(inside) + 1) * w.blocks)
        for k, i in enumerate(inside.tolist()):
            found[i].append(sigs[filled[k] : filled[k + 1]])
            n = int(sizes[i])
            weak[i] |= filled[k + 1] - filled[k] <= rule.differ(n + min(w.hi, 100 * n // rule.percent))
    return [np.concatenate(f) if f else np.zeros(0, np.uint64) for f in found], weak


_LISTS = "doc_id long, text_hash long, n long, set_id long, keys array<long>, sides array<int>, weak boolean"


def _summaries(docs: DataFrame, width: int, rule: Threshold, seed: int) -> DataFrame:
    boundary = rule.boundary

    def nested(parts, kind: pa.DataType) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate([np.asarray(p, kind.to_pandas_dtype()) for p in parts]) if parts else []
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.chunks(batch):
                tokens, bounds = _sets(*tb.buffers(part["text"]), width)
                sizes = np.diff(bounds)
                _, weak = _signatures(tokens, bounds, rule, boundary, seed)
                light = [
                    _light_keys(tokens[a:b], rule, boundary) if 0 < b - a < boundary and seed == 0 else ([], [])
                    for a, b in zip(bounds.tolist(), bounds[1:].tolist())
                ]
                keys = [np.array(k, np.uint64).view(np.int64) for k, _ in light]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].cast(pa.int64()), part["text_hash"], pa.array(sizes, pa.int64()),
                        pa.array(_set_ids(tokens, bounds).view(np.int64)),
                        nested(keys, pa.int64()),
                        nested([s for _, s in light], pa.int32()), pa.array(weak),
                    ],
                    names=["doc_id", "text_hash", "n", "set_id", "keys", "sides", "weak"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, _LISTS)


def _entries(sigs: np.ndarray, sets: np.ndarray) -> np.ndarray:
    out = np.empty(len(sigs), _ENTRY)
    for name, values in (("sig", sigs), ("set", sets)):
        out[name] = values & np.uint64(0xFFFFFFFF)
        out[f"{name}_high"] = (values >> np.uint64(32)) & np.uint64(0xFF)
    return out


def _column(entries: np.ndarray, name: str) -> np.ndarray:
    return entries[name].astype(np.uint64) | (entries[f"{name}_high"].astype(np.uint64) << np.uint64(32))


def _once_each(sigs: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry for each signature of a batch, and two that make a set active for sets that meet within it.

    A signature that a whole group of near copies shares thus travels once a batch, not once a set.
    """
    order = np.lexsort((sets, sigs))
    sigs, sets = sigs[order], sets[order]
    start = np.concatenate([[True], sigs[1:] != sigs[:-1]])
    other = np.concatenate([[False], (sigs[1:] == sigs[:-1]) & (sets[1:] != sets[:-1])])
    first = np.flatnonzero(start)
    met = np.repeat(np.add.reduceat(other.astype(np.int64), first) > 0, np.diff(np.append(first, len(sigs))))
    known = np.unique(sets[met])
    marks = tb.mix(known ^ np.uint64(0x7F4A7C15F39CC060))
    return np.concatenate([sigs[start], marks, marks]), np.concatenate([sets[start], known, known ^ np.uint64(_ID_MASK)])


def _active(docs: DataFrame, width: int, rule: Threshold, total: int, seed: int = 0) -> DataFrame:
    """``short_id`` of sets that share a block signature with another set; a few others may be among them.

    Signatures travel packed, dealt to buckets by hash; a bucket is sorted by one task and
    holds a bounded expected number.
    """
    boundary = rule.boundary
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // BUCKET_ENTRIES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.chunks(batch):
                tokens, bounds = _sets(*tb.buffers(part["text"]), width)
                each, _ = _signatures(tokens, bounds, rule, boundary, seed)
                sets = np.repeat(_set_ids(tokens, bounds) & np.uint64(_ID_MASK), [len(e) for e in each])
                sigs = np.concatenate(each)
                if not len(sigs):
                    continue
                sigs, sets = _once_each(sigs, sets)
                bucket = ((sigs >> np.uint64(_ID_BITS)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                packed, bucket = _entries(sigs, sets)[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[np.concatenate([[0], cuts])]), pa.array([g.tobytes() for g in np.split(packed, cuts)], pa.binary())],
                    names=["bucket", "entries"],
                )

    def match(table: pa.Table) -> pa.Table:
        entries = np.concatenate([np.frombuffer(b, _ENTRY) for b in table["entries"].to_pylist()])
        key, sets = _column(entries, "sig"), _column(entries, "set")
        order = np.lexsort((sets, key))
        key, sets = key[order], sets[order]
        same = (key[1:] == key[:-1]) & (sets[1:] != sets[:-1])
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.add.reduceat(np.concatenate([[0], same.astype(np.int64)]), start) > 0
        inside = np.repeat(several, np.diff(np.append(start, len(key))))
        return pa.table({"short_id": pa.array(np.unique(sets[inside]).view(np.int64))})

    dealt = docs.select("text").mapInArrow(deal, "bucket long, entries binary")
    return dealt.groupBy("bucket").applyInArrow(match, "short_id long").distinct()


def _light_links(lists: DataFrame) -> DataFrame:
    """Edges between small sets that share a subset: each to the smallest set of the other side."""
    each = lists.select("set_id", F.explode(F.arrays_zip("keys", "sides")).alias("k")).select("set_id", "k.keys", "k.sides").distinct()
    first = each.groupBy("keys", "sides").agg(F.min("set_id").alias("other"))
    meets = first.withColumn("to", F.when(F.col("sides") == 2, 2).otherwise(1 - F.col("sides"))).select("keys", F.col("to").alias("sides"), "other")
    met = each.join(meets, ["keys", "sides"])
    return met.where("set_id <> other").select(F.col("set_id").alias("a"), F.col("other").alias("b")).distinct()


def _parity(tokens: np.ndarray) -> np.ndarray:
    """For each hashed bit, whether an odd number of elements fall on it; the length grows with the set, by powers of two."""
    words = 2 << max(0, (len(tokens) - 1) >> 6).bit_length()
    hashed = tb.mix(tokens ^ np.uint64(0x2545F4914F6CDD1D))
    out = np.zeros(words, np.uint64)
    # The bit doesn't depend on the number of words: one half folded on the other is the shorter sketch.
    word, bit = (hashed >> np.uint64(6)) % np.uint64(words), hashed & np.uint64(63)
    np.bitwise_xor.at(out, word.astype(np.int64), np.uint64(1) << bit)
    return out.view(np.int64)


def _token_sets(docs: DataFrame, wanted: DataFrame, width: int, repeated: bool) -> DataFrame:
    """``set_id, n, tokens, parity, folded`` of the wanted sets, read again from one document each.

    ``wanted`` is stored. While it is small, it goes to the texts; beyond that, texts are shuffled to it.
    """
    sought = wanted.select(F.col("rep").alias("doc_id"), "set_id")
    if wanted.count() <= BROADCAST_ROWS:
        sought = F.broadcast(sought)
    texts = docs.select("doc_id", "text").join(sought, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.chunks(batch):
                tokens, bounds = _sets(*tb.buffers(part["text"]), width)
                # Another text under the same doc_id isn't the one that is wanted.
                right = _set_ids(tokens, bounds).view(np.int64) == part["set_id"].to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64)))
                parities = [_parity(tokens[a:b]) for a, b in zip(bounds, bounds[1:])]
                folded = [p[: len(p) // 2] ^ p[len(p) // 2 :] for p in parities]
                out = pa.RecordBatch.from_arrays(
                    [part["set_id"], pa.array(np.diff(bounds), pa.int64()), lists, pa.array(parities, longs), pa.array(folded, longs)],
                    schema=pa.schema(types),
                )
                yield out.filter(pa.array(right))

    longs = pa.list_(pa.int64())
    types = [("set_id", pa.int64()), ("n", pa.int64()), ("tokens", longs), ("parity", longs), ("folded", longs)]
    found = texts.mapInArrow(run, "set_id long, n long, tokens array<long>, parity array<long>, folded array<long>")
    return found.dropDuplicates(["set_id"]) if repeated else found


def _postings(sets: DataFrame, sizes: DataFrame, rule: Threshold) -> DataFrame:
    """``token, set_id, n, lone, place``: the prefix of each set in order of rarity, tokens of one set only left out.

    A token is written as its count and 48 bits of its hash, so that its order is its value.
    """
    each = sets.select("set_id", F.explode("tokens").alias("token"))
    # 48 bits are shuffled, not 64: tokens that then look alike only bring sets together, and the check reads whole ones.
    each = each.select("set_id", F.shiftrightunsigned("token", 16).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    rank = F.shiftleft(F.least(F.col("df"), F.lit(32767)).cast("long"), 48)
    shared = each.join(counts, "token").select("set_id", rank.bitwiseOR(F.col("token")).alias("token"))
    ordered = shared.groupBy("set_id").agg(F.sort_array(F.collect_list("token")).alias("list")).join(sizes.select("set_id", "n"), "set_id")
    lone = F.col("n") - F.size("list")
    length = F.col("n") - F.ceil(F.lit(rule.percent) * F.col("n") / F.lit(100)) + 1
    kept = F.slice("list", F.lit(1), F.greatest(F.lit(0), length - lone).cast("int"))
    prefix = ordered.select("set_id", "n", lone.alias("lone"), F.posexplode(kept).alias("pos", "token"))
    return stash(prefix.select("token", "set_id", "n", "lone", (F.col("lone") + F.col("pos")).alias("place")), "postings")


def _fits(rule: Threshold, n: Column, m: Column, places: Column) -> Column:
    """Whether sets of these sizes can link with this many elements known to be in one only."""
    return (100 * F.least(n, m) >= rule.percent * F.greatest(n, m)) & (places <= n + m - 2 * rule.column_need(n, m))


def _checked(pairs: DataFrame, sets: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs ``a, b`` with a flag ``linked``, from their whole sets."""
    side = lambda x: sets.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("t_a", "t_b"))
    linked = rule.column_links(F.col("n_a"), F.col("n_b"), shared)
    return stash(both.select("a", "b", linked.alias("linked")), "checked")


def _star_pairs(postings: DataFrame, rule: Threshold) -> DataFrame:
    """Each list's sets ``a`` against its leader ``b``, the set with the fewest tokens of its own: much the same set for all lists of a group."""
    heads = postings.groupBy("token").agg(F.min(F.struct("lone", "set_id", "n", "place")).alias("h"), F.count("*").alias("k")).where("k > 1")
    met = postings.join(heads, "token").where(F.col("set_id") != F.col("h.set_id"))
    met = met.where(_fits(rule, F.col("n"), F.col("h.n"), F.col("place") + F.col("h.place")))
    return met.select(F.col("set_id").alias("a"), F.col("h.set_id").alias("b")).distinct()


def _apart(x: str, y: str) -> Column:
    """At least so many elements are in one of two sets only: bits in which their parities differ.

    Sets of sizes that can link have sketches of the same length, or one of twice the other's.
    """
    one, two = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    longer, shorter = F.size(one("parity")) > F.size(two("parity")), F.size(one("parity")) < F.size(two("parity"))
    left = F.when(longer, one("folded")).otherwise(one("parity"))
    right = F.when(shorter, two("folded")).otherwise(two("parity"))
    bits = F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0), lambda s, k: s + k)


def _rest_pairs(postings: DataFrame, sets: DataFrame, labels: DataFrame, tested: DataFrame, rule: Threshold) -> DataFrame:
    """Pairs of a list that are in different components, not yet compared, and not too far apart by their parities."""
    known = postings.join(labels.select(F.col("node").alias("set_id"), "component"), "set_id", "left")
    known = known.withColumn("component", F.coalesce("component", "set_id"))
    mixed = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_lists = known.join(mixed.select("token"), "token").join(sets.select("set_id", "parity", "folded"), "set_id")
    open_lists = stash(open_lists, "open-lists")
    one, two = open_lists.alias("x"), open_lists.alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    most = x("n") + y("n") - 2 * rule.column_need(x("n"), y("n"))
    met = one.join(
        two,
        (x("token") == y("token")) & (x("set_id") < y("set_id")) & (x("component") != y("component"))
        & _fits(rule, x("n"), y("n"), x("place") + y("place")) & (_apart("x", "y") <= most),
    )
    pairs = met.select(x("set_id").alias("a"), y("set_id").alias("b")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_id, component_id`` of every row."""
    rule = Threshold(percent)
    lists = stash(_summaries(docs, width, rule, 0), "set-lists")
    filled = lists.where("n > 0")
    known = stash(filled.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "sets")
    total = known.agg(F.sum("n")).first()[0] or 0
    active = stash(_active(docs, width, rule, total), "active")
    weak, seed = lists.where("weak").select("set_id").distinct(), 1
    while not weak.isEmpty():
        # Too few filled blocks for some set under this deal: deal all sets anew and add what that finds.
        active = stash(active.unionByName(_active(docs, width, rule, total, seed)).distinct(), "active")
        again = _summaries(docs, width, rule, seed).where("weak").select("set_id").distinct()
        weak, seed = stash(weak.join(again, "set_id", "left_semi"), "weak"), seed + 1
    repeated = not filled.where("doc_id IS NOT NULL").groupBy("set_id", "doc_id").count().where("count > 1").isEmpty()
    short = F.col("set_id").bitwiseAND(F.lit(_ID_MASK))
    wanted = stash(known.where("rep IS NOT NULL").join(active, short == F.col("short_id")).drop("short_id"), "wanted")
    postings = _postings(_token_sets(docs, wanted, width, repeated), known, rule)
    # Only sets that still share a list are stored with all their shingles.
    lively = postings.join(postings.groupBy("token").count().where("count > 1").select("token"), "token").select("set_id").distinct()
    sets = stash(_token_sets(docs, stash(wanted.join(lively, "set_id", "left_semi"), "lively"), width, repeated), "token-sets")
    stars = _checked(_star_pairs(postings, rule), sets, rule)
    light = stash(_light_links(filled), "light")
    links = stars.where("linked").select("a", "b").unionByName(light)
    labels = components(links)
    rest = _checked(_rest_pairs(postings, sets, labels, stars, rule), sets, rule)
    more = rest.where("linked")
    if not more.isEmpty():
        labels = components(links.unionByName(more.select("a", "b")))
    named = known.join(labels, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "rep", F.coalesce("component", "set_id").alias("component")
    )
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = stash(named.join(least, "component").select("set_id", "component_id"), "set-components")
    joined = lists.select("doc_id", "text_hash", "n", "set_id").join(of_set, "set_id", "left")
    return joined.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "set_id",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, same columns, without all but the smallest doc_id of each component.

    Texts without words stay, each by itself; equal rows of a kept document become one.
    """
    found = stash(jaccard_components(docs, width, percent), "components")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keys = kept.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    repeated = not keys.where("rows > 1 AND n > 0 AND doc_id IS NOT NULL").isEmpty()
    keys = stash(keys.select(F.col("doc_id").alias("_kept_doc"), F.col("text_hash").alias("_kept_hash")), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("_kept_doc")) & (F.xxhash64("text") == F.col("_kept_hash"))
    out = docs.join(keys, same, "left_semi")
    return out.dropDuplicates() if repeated else out
