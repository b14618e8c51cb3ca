"""Resampling, spelling variants and suffix dedup against brute force on small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import resampling, spelling, suffix_dedup

SCHEMA = "doc_id long, text string, row int, repeats string, anchor long, bucket long, word string, rank long, _place long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PROSE = " ".join(f"prose{i}word" for i in range(60))


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _texts():
    pick = random.Random(5)
    name = lambda: "".join(pick.choice("abé") for _ in range(pick.randint(5, 9)))
    words = [name() for _ in range(120)]
    return [
        None, "", " \n", "One TWO two", PROSE, PROSE, f"{PROSE} end", f"start é {PROSE[7:390]} and on", "z" * 3000, "zy" * 150,
        "café " * 200, *[" ".join(pick.choice(words) for _ in range(pick.randint(15, 60))) for _ in range(60)],
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "x", 1, 2, "w", 3, 4) for i, t in enumerate(_texts())]
    rows += [rows[20], rows[20], (None, PROSE[5:300] * 2, *[None] * 7), (21, "another text " * 12, *[None] * 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- resampling ----------------------------------------------------------------------------


def _crc_buckets(text, width, buckets):
    words = WORD.findall(_lower(text))
    runs = [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]
    return [zlib.crc32(r.encode()) % buckets for r in runs], len(words)


def _draw(docs, target, percent, min_words, width, buckets):
    source, other = collections.Counter(), collections.Counter()
    for _, t in docs:
        source.update(_crc_buckets(t, width, buckets)[0])
    for t in target:
        other.update(_crc_buckets(t, width, buckets)[0])
    big, small = sum(source.values()) + buckets, sum(other.values()) + buckets
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * float(big) / ((source[b] + 1) * float(small)))) for b in range(buckets)}
    rows = []
    for doc_id, t in docs:
        found, words = _crc_buckets(t, width, buckets)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, words))
    fit = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    out = [(*r[:4], i) for i, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in fit[len(drawn) :]]
    return out + [(*r[:4], None) for r in rows if r[4] < min_words]


@pytest.mark.parametrize(("width", "percent", "piece"), [(1, 10, 1 << 20), (1, 100, 40), (2, 60, 64)])
def test_draw(spark, docs, monkeypatch, width, percent, piece):
    target = [None, "", "prose3word zzz", PROSE[:200], "ab abé bbaba"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(resampling, "PIECE_BYTES", piece)
    got = resampling.draw(docs, frame, percent=percent, min_words=20, width=width, n_buckets=97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = _draw([(r["doc_id"], r["text"]) for r in docs.collect()], target, percent, 20, width, 97)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_draw_from_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "text string")
    assert resampling.draw(empty, none).count() == 0
    assert resampling.draw(docs, none).count() == docs.count()


@pytest.mark.parametrize(("bits", "blocks"), [(3, 7), (12, 2), (16, 40)])
def test_radix_rank_sorts_any_longs(spark, bits, blocks):
    pick = random.Random(bits)
    keys = [None, -(2**63), 2**63 - 1, 0, -1, 1, 5, 5, 5] + [pick.randint(-300, 300) for _ in range(200)]
    rows = [(pick.choice(keys), pick.choice(keys)) for _ in range(400)] + [(7, 7)] * 100
    df = spark.createDataFrame(rows, "a long, b long").repartition(6)
    got = [tuple(r) for r in resampling.radix_rank(df, [("a", False), ("b", True)], digit_bits=bits, blocks=blocks).orderBy("rank").collect()]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0))
    assert got == [(*r, i) for i, r in enumerate(want, 1)]


def test_radix_rank_deals_blocks_of_equal_size(spark):
    """Two thirds of the rows with one key make no block larger."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    ranked = resampling.radix_rank(rows, [("k", True)], blocks=10)
    assert [r[0] for r in ranked.select("rank").orderBy("rank").collect()] == list(range(1, 3001))


def test_crc32_of_spans():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    starts = np.array([0, 5, 5, 100, 200, 3])
    ends = np.array([0, 6, 69, 300, 768, 3])
    assert resampling.crc32_of(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


# --- spelling ------------------------------------------------------------------------------


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts, ratio):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if _one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= ratio * n else None
        out[w] = (n, len(near), form, counts[form] if form else None)
    roots = {}
    for w in counts:
        root = w
        while out[root][2]:
            root = out[root][2]
        roots[w] = root
    return sorted((w, n, near, form, form_n, roots[w]) for w, (n, near, form, form_n) in out.items())


@pytest.mark.parametrize(("bands", "cells", "seed"), [(3, 1 << 15, 1), (2, 24, 2), (4, 40, 3)])
def test_group_variants(spark, bands, cells, seed):
    pick = random.Random(seed)
    words = {"".join(pick.choice("ab") for _ in range(pick.randint(6, 9))) for _ in range(300)}
    words |= {"aaaaaa" + c for c in "bcdé"} | {"x" * 50, "x" * 51, "x" * 30 + "y" + "x" * 20, "\U0001f600" * 6, "\U0001f600" * 7}
    counts = {w: pick.choice([5, 5, 6, 30, 200, 1500]) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.group_variants(frame, 5, bands, cells)
    assert sorted((tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str) == sorted(_variants(counts, 5), key=str)


def test_words(docs, empty):
    want = collections.Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1 :] if h % 7 == 0 else run
            want[word] += len(word) >= 6
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, every=7).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5}
    assert spelling.group_variants(spelling.word_counts(empty)).count() == 0


# --- suffix dedup --------------------------------------------------------------------------


def _without_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize(("length", "bucket", "piece"), [(200, 1 << 20, 1 << 20), (64, 1500, 100), (100, 400, 1 << 20)])
def test_suffix_dedup(docs, monkeypatch, length, bucket, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
    done = suffix_dedup.deduplicate(docs, length, bucket)
    assert done.columns == [*docs.columns, "_repeats"]
    got = done.select("doc_id", "text", "_repeats.*").collect()
    rows = docs.collect()
    want = _without_repeats([(r["text"] or "").encode() for r in rows], length)
    assert sorted(map(str, map(tuple, got))) == sorted(
        str((r["doc_id"], r["text"], *w[:3], w[3])) for r, w in zip(rows, want)
    )


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_matching_statistics():
    pick = random.Random(9)
    for trial in range(80):
        segments = list({bytes(pick.choice(b"ab\0") for _ in range(pick.randint(1, 20))) for _ in range(pick.randint(1, 6))})
        starts, found = suffix_dedup.matching_statistics(segments)
        places = [(a, i) for a, s in enumerate(segments) for i in range(len(s))]

        def common(p, q):
            x, y = segments[p[0]][p[1] :], segments[q[0]][q[1] :]
            return next((k for k, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))

        want = {p: max((common(p, q) for q in places if q != p), default=0) for p in places}
        assert {p: found[starts[p[0]] + p[1]] for p in places} == want


def test_segments_cover_every_start_once():
    texts = [b"", b"a" * 500, PROSE.encode() * 3, bytes(random.Random(1).randbytes(900))]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    text, start, size, *_ = suffix_dedup.intervals(data, bounds, 200)
    got = sorted((t, s + k) for t, s, n in zip(text.tolist(), start.tolist(), size.tolist()) for k in range(n))
    assert got == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - 199)]
