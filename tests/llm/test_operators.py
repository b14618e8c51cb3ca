"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import re
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sedimenta.llm import (
    bpe, components, fingerprints, lang_cnn, line_dedup, ngram_join, packing, pii, qda, quality_rules, queries, url_filter,
)

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row int"
LINE = "this line is long enough to be counted as a repeated line of text"
WORDS = [f"w{i}" for i in range(400)]


def _texts():
    base = " ".join(WORDS[:120])
    near = [" ".join(WORDS[:k] + [f"x{k}"] + WORDS[k + 1 : 120]) for k in range(0, 120, 9)]
    return [
        None, "", " \n\t ", "one", "one", "One TWO", "one two", base, base, base.upper(), *near,
        *[f"{LINE}\n{' '.join(WORDS[i * 9 : i * 9 + 30])}\n  {LINE.upper()} " for i in range(7)],
        " ".join(WORDS * 30), "aaaa " * 3000, "z" * 20000, "mail me a.b@c.org or +1 (314) 555-4198, ip 10.0.0.256 10.0.0.25",
        "4111 1111 1111 1111 x 4111-1111-1111-1112", "naïve café ½ 中文 € 'll it's\n\n  end ",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None, 0, 1.0, i) for i, t in enumerate(_texts())]
    rows += [rows[7], rows[7], (None, "one two three four five six seven", None, None, None, None, None), (3, "another text of doc three", "de", "s", 1, None, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _shingles(text, width):
    low = (text or "").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, width, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [_shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= percent * len(a | sets[j]):
                group[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    want = sorted(
        ((d, len(s), (min(least[find(i)], default=None) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str
    )
    got = ngram_join.jaccard_components(docs, width, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == want


@pytest.mark.parametrize("percent", [80, 90])
def test_windows_of_a_size(percent):
    rule = ngram_join.Threshold(percent)
    every = rule.windows(1 << 15)
    holding = lambda n, windows: {w.lo for w in windows if w.lo <= n <= w.hi}
    for n in range(rule.boundary, 10000):
        own = holding(n, rule.windows(1 << max(8, n.bit_length())))
        assert own == holding(n, every) and own & holding(100 * n // percent, every)


@pytest.mark.parametrize(("width", "percent", "sizes"), [(3, 90, (8000, 8500)), (5, 80, (500, 560))])
def test_links_across_batches(spark, width, percent, sizes):
    one, other = [
        spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(n + width - 1)))], "doc_id long, text string") for i, n in enumerate(sizes)
    ]
    got = ngram_join.jaccard_components(one.unionByName(other), width, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(0, sizes[0], 0), (1, sizes[1], 0)}


def test_no_documents(empty):
    assert ngram_join.jaccard_components(empty).count() == 0


def test_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and 8 not in ids and {0, 1, 2} <= set(ids)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, None), (7, 7), (200, 200)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_url_filter(spark):
    link = '<html><LINK rel="canonical" href="{}"></html>'
    pages = [
        (1, "http://A.net/es/x", None), (2, "https://b.org/q?x#y", link.format("http://a.net/es/x")),
        (3, "http://c.org", '<meta http-equiv=refresh content="0; url=http://b.org/q?x">'), (4, None, "x"), (5, "no scheme", ""),
        (6, "http://www.example.com/en/1", link.format("http://d.org/")), (7, "http://d.org", link.format("http://a.net/es/zz")),
        (8, "http://example.com/en/", None), (9, "http://xexample.com/en/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, queries.RULES).collect()}
    assert got == {
        1: ("net/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"),
        6: ("www.example.com/en/", "allow"), 7: (None, "allow"), 8: ("example.com/en/", "block"), 9: ("com/", "allow"),
    }


def test_url_filter_link_forms(spark):
    link, page = '<link rel="canonical" href="{}">', "http://a.org/d/e/f?x=1"
    moved = '<meta http-equiv="refresh" content="0; url={}">'
    forms = {
        "page2.html": "a.org/d/e/page2.html", "../x": "a.org/d/x", "../../../x?y=../z": "a.org/x?y=../z", "./": "a.org/d/e/", "..": "a.org/d/",
        "?id=3": "a.org/d/e/f?id=3", "/r/./s?u=http://b.org/": "a.org/r/s?u=http://b.org/", "g?u=http://b.org/#z": "a.org/d/e/g?u=http://b.org/",
        "//B.org/x": "b.org/x", "http://b.org/x?p=1&amp;q=2": "b.org/x?p=1&q=2", "http://b.org/x?p=1&#38;q=2": "b.org/x?p=1&q=2",
        "h?p=1&#x26;q=2": "a.org/d/e/h?p=1&q=2", "mailto:me@b.org": None, "#top": None,
    }
    for tag in (link, moved):
        for to, want in forms.items():
            pages = spark.createDataFrame([(page, tag.format(to))], "url string, html string")
            assert [(r.a, r.b) for r in url_filter.page_links(pages).collect()] == [("a.org/d/e/f?x=1", want)] * (want is not None), to
    rows = [
        (1, "http://a.net/es/x?p=1&q=2", None), (2, "http://b.org/x", link.format("http://a.net/es/x?p=1&amp;q=2")),
        (3, "http://b.org/d/y", link.format("../x")), (4, "http://c.org", moved.format("z")), (5, "http://c.org/z", link.format("//b.org/x")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df, queries.RULES).collect()} == dict.fromkeys(range(1, 6), "block")


def test_language(spark, docs, empty):
    own = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = lang_cnn.identify(own, learn=queries._fold(5) != 0)
    held = found.where(queries._fold(5) == 0).select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert held > 0.85
    rows = lang_cnn.identify(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.row in (1, 2)} == {"und"}
    assert lang_cnn.identify(empty).count() == 0


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _base(text):
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    out = []
    for rank, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base(spark, docs, empty):
    odd = ["a@b.c_x@d.e 1.2.3.4.5.6.7.8", "é1.1.1.1é", "+1 314 555 4198+1 314 555 4198", "..@a.b", "1 2 3 4 " * 4000, "a" * 50000 + "@b.c"]
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    want = collections.Counter((r.doc_id, _base(r.text)) for r in both.collect())
    assert collections.Counter((r.doc_id, r.base) for r in pii.summarise(both).collect()) == want
    assert pii.sanitise(docs).schema == docs.schema and pii.sanitise(empty).count() == 0
    clean = {r.row: r.text for r in pii.sanitise(docs).collect()}
    assert any(t and t.startswith("mail me [EMAIL] or [PHONE], ip 10.0.0.256 [IP]") for t in clean.values())


def test_pii_terms(spark):
    fill = ["red", "blue", "green", "black", "white", "brown", "grey"]
    rows = [(i, f"{c} Zyxwolf mail john@x.com about the {c} thing") for i, c in enumerate(fill)]
    rows += [(50 + i, f"about the mail thing {c} number {i}") for i, c in enumerate(fill * 8)] + [(200, "a tale of zyxwolf, alone")]
    got = {r.doc_id: r.spans for r in pii.summarise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:4:11" in got[0] and got[200] == "term:10:17" and got[50] == ""


def test_pii_terms_of_texts(spark):
    # The same words beside an address in different texts, on its line and on the line above; then copies.
    texts = [f"number n{chr(97 + i)}x of many\nZyxwolf Quarn john@x.com" for i in range(6)]
    texts += [f"Yours, Brimtal\nkate@y.org\nthing {'abcdef'[i]}zz" for i in range(6)]
    texts += [f"{w} Dromvik sends anna@z.net {w}" for w in ("red", "blue", "green", "black")] * 50
    texts += ["one text with Plonkers and bob@w.net in it"] * 100
    texts += [f"about many a thing, number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    total, counts = pii._text_counts(df)
    words = collections.Counter(w for t in set(texts) for w in {x.lower() for x in re.findall(r"[^\W\d_]{3,}", t)})
    assert total == len(set(texts)) and {r.term: r.n_term for r in counts.collect()} == words
    terms = {r.term: r.disclosure for r in pii.revealing_terms(df, pii.base_spans(df)).collect()}
    assert all(terms.get(t) == 1 for t in ("zyxwolf", "quarn", "brimtal", "dromvik")) and "plonkers" not in terms and "thing" not in terms


def test_rules(docs, empty):
    rows = quality_rules.apply_rules(docs).collect()
    want = collections.Counter()
    for r in docs.collect():
        text = r.text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen = collections.Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        want[(r.doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)] += 1
    got = collections.Counter(
        (r.doc_id, r.rule_counts.n_words, r.rule_counts.word_chars, r.rule_counts.n_symbols, r.rule_counts.n_dup_lines,
         r.rule_counts.n_repeat_words, r.base_failed) for r in rows
    )
    assert got == want and not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.apply_rules(empty).count() == 0


def test_rules_keep_good(spark):
    own = spark.read.parquet(f"{SMALL}/documents.parquet")
    met = quality_rules.apply_rules(own).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("not base_failed")
    assert met.where("quality = 1").select(F.avg(F.col("kept").cast("int"))).first()[0] > 0.98


def test_rules_of_a_tight_group(spark):
    # A source with a third of all rows and many symbols must not loosen the fences of the others.
    words = [f"word{i}" for i in range(30)]
    text = lambda i, symbols: " ".join([*words, f"n{i}", *[f"#{k}" for k in range(symbols)]])
    rows = [(i, text(i, i % 60), "en", "hot") for i in range(400)]
    rows += [(1000 + i, text(i, 20 if i < 10 else i % 2), "en", "tight") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.apply_rules(df).where("kept").collect()}
    assert kept.isdisjoint(range(1000, 1010)) and kept >= {*range(1010, 1800), *range(400)}


def test_bpe(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.codec(path)
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    want = collections.Counter()
    for r in docs.collect():
        ids = real.encode_ordinary(r.text or "")
        sha = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want[(r.row, len(ids), sha, hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    got = bpe.round_trip(docs, path).collect()
    assert collections.Counter((r.row, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    there = bpe.decode(bpe.encode(docs, path), path)
    assert sorted(r.text for r in there.collect()) == sorted(r.text or "" for r in docs.collect())
    assert bpe.round_trip(empty, path).count() == 0


@pytest.mark.parametrize("piece", ["ab" * 300, "a" * 777, "=" * 500, "theofand" * 90, "ñandúß" * 60])
def test_tree_equals_plain_merging(piece):
    own = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert own.reduce(piece.encode()) == own.merge(piece.encode())


def test_fingerprints(docs, empty):
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    got = fingerprints.following(rows).collect()
    order = sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=lambda r: -r[0])
    after = collections.defaultdict(set)
    for i, (doc, _) in enumerate(order):
        after[doc].add(order[(i + 1) % len(order)][1])
    assert len(got) == len(order) and all(r.next_text in after[r.doc_id] or r.doc_id == 4 or r.doc_id == 3 for r in got)
    for r in got:
        assert r.sketch.n == len(_shingles(r.text, 5))
    assert fingerprints.following(empty).count() == 0


def _hashes(spark, shingles):
    """The hash of each shingle of one to five words, put together from two of half its size."""
    h = [F.xxhash64(F.col("s")[i]) for i in range(5)]
    five = F.xxhash64(F.xxhash64(F.xxhash64(h[0], h[1]), F.xxhash64(h[2], h[3])), h[4])
    short = F.xxhash64(F.transform("s", lambda w: F.xxhash64(w)))
    df = spark.createDataFrame([(list(s),) for s in shingles], "s array<string>")
    return {tuple(r.s): r.h for r in df.select("s", F.when(F.size("s") < 5, short).otherwise(five).alias("h")).collect()}


def test_fingerprints_of_query(spark, docs, tmp_path):
    more = [(None, f"no id {' '.join(WORDS[i : i + 60])}") for i in range(3)] + [(None, None), (-5, "less than nothing " * 9)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    tied = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).collect()
    order = sorted(tied, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    pairs = [(a, b.text) for a, b in zip(order, order[1:] + order[:1])]
    texts = [(a.doc_id, a.text, a.text[: len(a.text) - len(a.text) // 2] + b[: len(a.text) // 2], b) for a, b in pairs]
    hashes = _hashes(spark, {s for _, *three in texts for t in three for s in _shingles(t, 5)})

    def near(a, b):
        one, two = ({hashes[s] for s in _shingles(t, 5)} for t in (a, b))
        if one == two:
            return 1.0
        one, two = ({h for h in s if h < -(2**63) + 2**61} for s in (one, two))
        return len(one & two) / len(one | two) if one | two else 0.0

    want = collections.Counter(
        (doc, len(t), hashlib.sha256(e.encode()).hexdigest(), round(near(t, e), 9), round(near(t, n), 9)) for doc, t, e, n in texts
    )
    got = queries.op7_fingerprints(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_sketch_estimates(spark):
    one, two = " ".join(f"a{i}" for i in range(4000)), " ".join(f"a{i}" for i in range(2000, 5000))
    df = spark.createDataFrame([(one, two)], "one string, two string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, F.col("one"), "x"), F.col("two"), "y")
    near, inside = df.select(fingerprints.likeness(F.col("x"), F.col("y")), fingerprints.containment(F.col("y"), F.col("x"))).first()
    assert abs(near - 0.4) < 0.06 and abs(inside - 2 / 3) < 0.08


def test_packing(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    real = tokenizers.Tokenizer.from_file(path)
    real.encode_special_tokens = True
    rows = packing.pack_documents(docs, path).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = [*real.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r.doc_id, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_added_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end} x", f"<|endof{end}text|>", "<|endof", "text|> y", None, f"é{end}" * 1500 + " 中文"]
    real = tokenizers.Tokenizer.from_file(path)
    want = []
    for i, t in enumerate(texts):
        ids = [*real.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for a, b in zip(cuts, cuts[1:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pack_documents(df, path).collect()) == want


def test_quality(spark, docs, empty):
    own, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    met = qda.classify(own, labels, learn=queries._fold(3) != 1).join(labels, "doc_id").where(queries._fold(3) == 1)
    assert met.select(F.avg(((F.col("score") >= 0.5) == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.9
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in qda.classify(docs.drop("score"), none).collect()} == {0.5}
    assert qda.classify(empty, labels).count() == 0
    assert qda.keep_good(docs, labels).schema == docs.schema


def test_line_dedup(docs, empty):
    done = line_dedup.deduplicate(docs)
    assert done.count() == docs.count() and line_dedup.deduplicate(empty).count() == 0
    dropped = {r.doc_id: r.line_dedup.n_dropped for r in done.where(F.col("text").startswith(LINE)).collect()}
    keeper = max(dropped)
    assert dropped.pop(keeper) == 0 and set(dropped.values()) == {2}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(queries.ORACLES[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in order) for r in result.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    kept = corpus_pipeline.quality(spark, docs, SMALL)
    assert len(good - {r.doc_id for r in kept.select("doc_id").collect()}) <= 0.02 * len(good)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, SMALL).schema == docs.schema
    rows = corpus_pipeline.run(spark, SMALL).collect()
    ids = {r.doc_id for r in rows}
    assert len(ids) > 0.7 * len(good) and ids <= {r.doc_id for r in docs.collect()}


def test_ranks_are_read():
    ranks = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    assert base64.b64encode(min(ranks, key=ranks.get)) and len(ranks) == 50256
