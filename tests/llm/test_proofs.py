"""The trained models against plain loops: forward pass, gradients, statistics and densities."""

from __future__ import annotations

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from sedimenta.llm import lang_cnn, line_dedup, pii, qda, quality_rules, queries

TEXTS = [
    "", "one", "One ONE two; a| b| c!", "naïve café ½ 中文 € 'll it's", "x " * 40, "the end\nthe end\nthe end of it all, now!",
    "#*$%& <tag> 12345 averyveryverylongword antidisestablishmentarianism I am it", " \t\n", "Ärger über 100 Öle. " * 9,
]


# --- language network ----------------------------------------------------------------------


def _logits(net, window):
    """One window: embed, convolve with every filter, take the largest response, rectify, weigh."""
    wide, size = max(lang_cnn.WIDTHS), net.embedding.shape[1]
    bytes_ = [int(b) for b in window]
    pooled = []
    for f in range(net.filters.shape[1]):
        best = -math.inf
        for at in range(len(bytes_) - wide + 1):
            total = 0.0
            for k in range(wide):
                for e in range(size):
                    total += float(net.embedding[bytes_[at + k]][e]) * float(net.filters[k * size + e][f])
            best = max(best, total)
        pooled.append(max(0.0, best + float(net.bias[f])))
    return [sum(p * float(net.weights[f][c]) for f, p in enumerate(pooled)) + float(net.shift[c]) for c in range(len(net.shift))]


def _chances(logits):
    top = max(logits)
    e = [math.exp(x - top) for x in logits]
    return [x / sum(e) for x in e]


@pytest.fixture(scope="module")
def windows():
    pick = np.random.default_rng(3)
    return pick.integers(0, 256, (6, 24)).astype(np.uint8), ["a", "b", "c", "a", "b", "a"]


def _net(windows, epochs, monkeypatch):
    monkeypatch.setattr(lang_cnn, "SEEN", 0)
    return lang_cnn.train(*windows, per_width=2, size=3, epochs=epochs)


def test_forward_pass_equals_loops(windows, monkeypatch):
    net = _net(windows, 3, monkeypatch)
    got = lang_cnn.probabilities(net, windows[0], batch=4)
    want = [_chances(_logits(net, w)) for w in windows[0]]
    assert np.allclose(got, want, atol=1e-5)


def test_narrow_filters_see_few_bytes(windows, monkeypatch):
    net = _net(windows, 2, monkeypatch)
    for i, width in enumerate(lang_cnn.WIDTHS):
        assert not net.filters[width * 3 :, 2 * i : 2 * i + 2].any() and net.filters[: width * 3, 2 * i : 2 * i + 2].any()


def test_first_step_goes_against_the_numeric_gradient(windows, monkeypatch):
    """Adam's first step is 0.01 against the gradient's sign, in every parameter that has one."""
    before, after = (_net(windows, n, monkeypatch) for n in (0, 1))

    def loss(net):
        chances = [_chances(_logits(net, w)) for w in windows[0]]
        return -sum(math.log(c[net.languages.index(x)]) for c, x in zip(chances, windows[1])) / len(chances)

    pick, seen = random.Random(1), 0
    for name in ("embedding", "filters", "bias", "weights", "shift"):
        value = getattr(before, name).astype(float)
        moved = getattr(after, name) - getattr(before, name)
        spots = [tuple(s) for s in np.argwhere(np.abs(moved) > 1e-4)]
        for spot in pick.sample(spots, min(5, len(spots))):
            both = []
            for d in (1e-4, -1e-4):
                other = value.copy()
                other[spot] += d
                both.append(loss(lang_cnn.Network(**{**before.__dict__, name: other})))
            slope = (both[0] - both[1]) / 2e-4
            if abs(slope) > 1e-4:
                seen += 1
                assert np.sign(moved[spot]) == -np.sign(slope) and abs(abs(moved[spot]) - 0.01) < 1e-3
    assert seen >= 15


def test_a_text_is_the_mean_of_its_windows(windows, monkeypatch):
    monkeypatch.setattr(lang_cnn, "WINDOW", 24)
    net = _net(windows, 2, monkeypatch)
    langs, scores = lang_cnn.predict(net, pa.array([*TEXTS, None]))
    for text, lang, score in zip([*TEXTS, ""], langs, scores):
        raw = text.encode()
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0)
            continue
        pieces = [raw[i : i + 24] for i in range(0, len(raw), 24)]
        chances = [_chances(_logits(net, p + bytes(24 - len(p)))) for p in pieces]
        mean = [sum(c[k] * len(p) for c, p in zip(chances, pieces)) / len(raw) for k in range(3)]
        assert abs(score - max(mean)) < 1e-5 and net.languages[mean.index(max(mean))] == lang


# --- quality discriminant --------------------------------------------------------------------


def _statistics(text):
    low = text.translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    words, same = re.findall("[^\x20\x09-\x0d]+", text), re.findall("[^\x20\x09-\x0d]+", low)
    chars = sum(map(len, words))
    count = lambda letters: sum(c in letters for c in text)
    ratio = lambda n, total, prior, weight: math.sqrt((n + prior * weight) / (total + weight))
    triples = [tuple(same[i : i + 3]) for i in range(len(same) - 2)] if len(same) > 2 else [tuple(same)] if same else []
    n = len(words)
    return [
        ratio(count("#*$%&<>"), chars, 0.002, 30), ratio(count(line_dedup.UPPER), chars, 0.03, 30),
        ratio(count("0123456789"), chars, 0.002, 30), ratio(count("!"), chars, 0.001, 30), ratio(count("|"), chars, 0.001, 30),
        ratio(count(".,;"), chars, 0.03, 30), math.log((len(set(same)) + 5) / (n + 5) ** 0.8),
        ratio(sum(a == b for a, b in zip(same, same[1:])), n, 0.01, 20),
        ratio(len(triples) - len(set(triples)), len(triples), 0.01, 20), math.log((chars + 50) / (n + 10)),
        ratio(sum(len(w) <= 2 for w in words), n, 0.25, 20), ratio(sum(len(w) >= 16 for w in words), n, 0.02, 20),
    ]


def test_statistics_equal_loops():
    got = qda.statistics(pa.array([*TEXTS, None]))
    assert got.shape == (len(TEXTS) + 1, len(qda.FEATURES))
    assert np.allclose(got, [_statistics(t) for t in [*TEXTS, ""]])


def test_fit_and_densities_equal_loops(spark):
    pick, k = random.Random(2), len(qda.FEATURES)
    rows = [(i % 3 % 2, [pick.gauss(i % 3 % 2, 1 + 0.1 * j) for j in range(k)]) for i in range(90)] + [(None, [9.0] * k), (7, [9.0] * k)]
    model = qda.fit(spark.createDataFrame(rows, "label int, stats array<double>"), "label", "stats")
    covs, means, sizes = [], [], []
    for c in (0, 1):
        x = [v for label, v in rows if label == c]
        mean = [sum(v[j] for v in x) / len(x) for j in range(k)]
        covs.append([[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / len(x) for j in range(k)] for i in range(k)])
        means.append(mean)
        sizes.append(len(x))
    pooled = [[(covs[0][i][j] * sizes[0] + covs[1][i][j] * sizes[1]) / sum(sizes) for j in range(k)] for i in range(k)]
    tests = [v for _, v in rows[:20]]
    got = model.scores(np.array(tests))
    for x, score in zip(tests, got):
        log = []
        for c in (0, 1):
            cov = np.array([[(1 - 0.1) * (0.7 * covs[c][i][j] + 0.3 * pooled[i][j]) + (i == j) * (0.1 * pooled[i][i] + 1e-6) for j in range(k)] for i in range(k)])
            d = np.array(x) - np.array(means[c])
            log.append(-0.5 * d @ np.linalg.inv(cov) @ d - 0.5 * math.log(np.linalg.det(cov)) + math.log(sizes[c]))
        assert abs(score - 1 / (1 + math.exp(log[0] - log[1]))) < 1e-6


# --- columns with the names that operators work with -------------------------------------------


CLASHING = [
    "row", "line_dedup", "_line_dedup", "drop", "lines", "lo", "hi", "_drop_doc", "_drop_hash", "_w", "_l", "_h", "_s", "_p", "_repeats",
    "g_lang", "g_source", "in_lang", "in_source", "max_symbol_share", "n", "own_n", "_hash", "_sum", "_may", "_spans", "_next", "_word", "_bits",
]


def test_clashing_columns_pass(spark):
    text = "\n".join(["a line that is long enough to be counted as one that repeats", "and john@x.com in another one"])
    rows = [(i, text + f"\n{i}", "en", "s", *[f"{c}{i}" for c in CLASHING]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    want = {r[0]: r[4:] for r in rows}
    for done, added in (
        (line_dedup.deduplicate(df), ["__line_dedup"]), (quality_rules.apply_rules(df), ["rule_counts", "base_failed", "kept"]),
        (pii.sanitise(df), []),
    ):
        assert [c for c in done.columns if c not in df.columns] == added
        got = done.select("doc_id", *CLASHING).collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == 6
    assert all("john" not in r.text for r in pii.sanitise(df).collect())
    replaced = quality_rules.apply_rules(df.withColumn("kept", F.lit("old")).withColumn("rule_counts", F.lit(1)))
    assert replaced.columns[-3:] == ["rule_counts", "base_failed", "kept"] and dict(replaced.dtypes)["kept"] == "boolean"


# --- fences against exact quantiles ------------------------------------------------------------


def test_fences_follow_exact_quantiles(spark):
    """Sketches are exact to within a few ranks; so is a fence to what those ranks hold."""
    pick = random.Random(4)
    rows = [(i, " ".join(pick.choice(["#", "word", "and", "other"]) for _ in range(pick.randint(30, 90))), "en", f"s{i % 2}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counted = quality_rules.with_counts(df)
    fences = {r["g_source"]: r["max_symbol_share"] for r in quality_rules.thresholds(counted, "lang", "source", "rule_counts").collect()}
    for source in ("s0", "s1"):
        shares = sorted(t.split().count("#") / len(t.split()) for _, t, _, s in rows if s == source)
        at = lambda q: shares[int(q * len(shares))]
        edge = lambda d: at(0.75 + d) + max(3 * (at(0.75 + d) - at(0.5 - d)), 0.1)
        assert edge(-0.03) <= fences[source] <= edge(0.03)
    few = quality_rules.thresholds(counted, "lang", "source", "rule_counts", min_group=700).collect()
    assert len({r["max_symbol_share"] for r in few}) == 1


# --- links of pages against SQL ----------------------------------------------------------------


def test_url_filter_with_links_equals_its_sql(spark, tmp_path):
    link, moved = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    targets = [
        "page2.html", "../x", "../../../es/x?y=../z", "./", "..", "?id=3", "/r/./s?u=http://b.net/fr/", "//B.net/es/x", "mailto:me@b.org", "#top",
        "http://b.net/fr/x?p=1&amp;q=2", "h?p=1&#x26;q=2", "http://www.example.com/en/1", "http://example.com/en/2",
    ]
    pick = random.Random(6)
    pages = [(i, f"http://{pick.choice('abc')}.{pick.choice(['org', 'net', 'com'])}/{pick.choice(['es', 'en/d', 'fr'])}/{i % 9}",
              pick.choice([link, moved]).format(pick.choice(targets)) if i % 3 else None) for i in range(150)]
    pages += [(900, None, link.format("/x")), (901, "no scheme", link.format("/x")), (902, "http://a.net", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = queries.op2_url_filter(spark, str(tmp_path))
    want = con.sql(queries.ORACLES["op2_url_filter"]).project(", ".join(df.columns)).fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    assert any(rule is None and verdict == "block" for *_, rule, verdict in want)
