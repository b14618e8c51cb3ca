"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import (
    bpe, fingerprints, lang_cnn, line_dedup, ngram_join, packing, pii, qda, quality_rules, resampling, spelling,
    suffix_dedup, url_filter,
)
from sedimenta.llm.url_filter import Rule

RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int) -> Column:
    """crc32 of doc_id as text, modulo the number of parts."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = lang_cnn.identify(docs, learn=_fold(5) != 0)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.summarise(_table(spark, sf_dir, "documents"))
    digest = F.sha2("base", 256).alias("base_sha256")
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], digest, "spans")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = quality_rules.apply_rules(docs)
    return found.select("doc_id", *[F.col(f"rule_counts.{n}").alias(n) for n in names], "base_failed", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.following(_table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    rows = fingerprints.with_sketch(rows, F.col("edited"), "edited_sketch")
    own, other = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.printed(own).alias("fingerprint"), fingerprints.printed(other).alias("edited_fingerprint"),
        fingerprints.likeness(own, other).alias("near_edited"),
        fingerprints.likeness(own, F.col("next_sketch")).alias("near_next"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = qda.classify(docs, _table(spark, sf_dir, "labels"), learn=_fold(3) != 1)
    held_out, predicted = (_fold(3) == 1).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", held_out, "score", predicted)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    detail = F.col(line_dedup.DETAIL)
    return done.select("doc_id", detail.n_lines.alias("n_lines"), detail.n_dropped.alias("n_dropped"),
                       F.sha2(detail.kept_text, 256).alias("kept_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(_table(spark, sf_dir, "documents"))
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    detail = F.col(suffix_dedup.DETAIL)
    counts = [detail[c].alias(c) for c in ("n_bytes", "n_removed", "n_spans")]
    return done.select("doc_id", *counts, F.sha2(detail.kept, 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_url_filter, op3_language_id, op4_pii, op5_quality_rules, op6_byte_bpe,
        op7_fingerprints, op8_best_fit_packing, op9_quality_classifier, op10_line_dedup,
        op11_importance_resampling, op12_spelling_variants, op13_suffix_array_dedup,
    )
}

_UPPER, _LOWER = line_dedup.UPPER, line_dedup.LOWER

# crc32 of the text x, with the byte table of the polynomial in tbl.t.
_CRC_TABLE = """g(i, k, v) AS (
    SELECT CAST(i AS UBIGINT), 0, CAST(i AS UBIGINT) FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM g WHERE k < 8
), tbl AS (SELECT list(v ORDER BY i) AS t FROM g WHERE k = 8)"""
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(length(hex(x)) // 2), lambda i:
    CAST(16 * (strpos('0123456789ABCDEF', substr(hex(x), 2 * i + 1, 1)) - 1)
        + strpos('0123456789ABCDEF', substr(hex(x), 2 * i + 2, 1)) - 1 AS UBIGINT))),
    lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)"""

ORACLES = {
    "op11_importance_resampling": rf"""
WITH RECURSIVE {_CRC_TABLE},
a AS (
    SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark
), w AS (
    SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x
    FROM a
), b AS (SELECT x, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT x FROM w), tbl),
f AS (SELECT side, id, bucket FROM w JOIN b USING (x)),
c AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM f GROUP BY bucket),
n AS (SELECT sum(s) AS big, sum(t) AS small FROM c),
k AS (
    SELECT bucket, CAST(floor(1000 * ln(((t + 1) * CAST(big + 10000 AS DOUBLE)) / ((s + 1) * CAST(small + 10000 AS DOUBLE)))) AS BIGINT) AS gain
    FROM c, n
), d AS (SELECT id, count(*) AS n_features, sum(gain) AS weight FROM f JOIN k USING (bucket) WHERE side = 's' GROUP BY id),
h AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(('0x' || left(sha256('2024:' || doc_id), 8)) AS BIGINT) AS h
    FROM documents LEFT JOIN d ON d.id = doc_id
), z AS (
    SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h
), r AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
        (SELECT 10 * count(*) // 100 FROM z WHERE n_features >= 20) AS drawn
    FROM z
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM r
""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS w
    FROM documents
), p AS (SELECT w, doc_id || ':' || w AS x, count(*) AS n FROM o WHERE length(w) >= 6 GROUP BY ALL),
q AS (SELECT w, n, {_CRC} AS h FROM p, tbl),
u AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM q),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM u WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
m AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
k AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS masked, left(word, i) || substr(word, i + 2) AS less FROM m),
y AS (
    SELECT a.word, b.word AS near, b.n FROM k a JOIN k b ON a.masked = b.masked AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM k a JOIN v b ON a.less = b.word
    UNION SELECT b.word, a.word, a.n FROM k a JOIN v b ON a.less = b.word
), c AS (SELECT word, count(*) AS n_near FROM y GROUP BY word),
t AS (SELECT word, near, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM y),
f AS (
    SELECT v.word, v.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN t.n >= 5 * v.n THEN t.near END AS form,
        CASE WHEN t.n >= 5 * v.n THEN t.n END AS form_n
    FROM v LEFT JOIN c ON c.word = v.word LEFT JOIN t ON t.word = v.word AND t.place = 1
), r(word, root, step) AS (
    SELECT word, word, 0 FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) e ON e.word = f.word
""",
    "op13_suffix_array_dedup": r"""
WITH b AS (SELECT doc_id, hex(coalesce(text, '')) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(x) // 2, 1000)) AS base, x FROM b),
q AS (SELECT doc_id, base, substr(x, 2 * base + 1, 2 * (1000 + 199)) AS x FROM p),
w AS (SELECT doc_id, base, x, unnest(range(least(1000, length(x) // 2 - 199))) AS i FROM q WHERE length(x) >= 400),
s AS (SELECT doc_id, base + i AS start, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM w),
r AS (SELECT doc_id, start FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, start, CASE WHEN start - 200 > lag(start, 1, -1000000) OVER (PARTITION BY doc_id ORDER BY start) THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT doc_id, start, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM g),
m AS (SELECT doc_id, span, min(start) AS low, max(start) + 200 AS high FROM i GROUP BY doc_id, span),
e AS (SELECT doc_id, low, high, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) AS done FROM m),
k AS (
    SELECT e.doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS high,
        string_agg(substr(x, 2 * done + 1, 2 * (low - done)), '' ORDER BY low) AS kept
    FROM e JOIN b ON b.doc_id = e.doc_id GROUP BY e.doc_id
)
SELECT b.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN k.doc_id IS NULL THEN x ELSE kept || substr(x, 2 * high + 1) END)) AS kept_sha256
FROM b LEFT JOIN k ON k.doc_id = b.doc_id
""",
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
        WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
    FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
    FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id
""",
    "op2_url_filter": r"""
WITH RECURSIVE u AS (
    SELECT page_id, url, html,
        CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest
    FROM pages
), h AS (
    SELECT page_id, url, html, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, rest
    FROM u
), rules(action, rhost, rpath) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
           ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), a AS (
    SELECT page_id, host, path, html, CASE WHEN rest IS NOT NULL THEN host ||
        CASE WHEN regexp_extract(rest, '^[^/?#]*([^#]*)', 1) LIKE '/%' THEN '' ELSE '/' END
        || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS address
    FROM h
), t AS (
    SELECT address, host, path, unnest(list_concat(
        list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
            lambda x: regexp_extract(regexp_replace(x, '(?i)&(?:amp|#0*38|#x0*26);', '&', 'g'), '(?i)\bhref\s*=\s*["'']?([^\s"''>]+)', 1)),
        list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
            lambda x: regexp_extract(regexp_replace(x, '(?i)&(?:amp|#0*38|#x0*26);', '&', 'g'), '(?i)\burl\s*=\s*["'']?([^\s"''>;]+)', 1)))) AS target
    FROM a
), w AS (
    SELECT *, regexp_extract(target, '^[^?#]*') AS tp, CASE WHEN path = '' THEN '/' ELSE path END AS own FROM t
), v AS (
    SELECT *, CASE WHEN tp = '' THEN own WHEN target LIKE '/%' THEN tp ELSE regexp_extract(own, '^.*/') || tp END AS full_path FROM w
), z AS (
    SELECT *, CASE WHEN tp <> '' AND regexp_matches(full_path, '/\.\.?(/|$)') THEN '/' || array_to_string(list_concat(
        list_reduce(list_transform(string_split(full_path, '/')[2:], lambda x: [x]), lambda done, x:
            CASE x[1] WHEN '..' THEN done[:len(done) - 1] WHEN '.' THEN done ELSE list_concat(done, x) END, CAST([] AS VARCHAR[])),
        CASE WHEN string_split(full_path, '/')[-1] IN ('.', '..') THEN [''] ELSE CAST([] AS VARCHAR[]) END), '/') ELSE full_path END AS resolved
    FROM v
), f AS (
    SELECT address, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(target, strpos(target, '://') + 3)
        WHEN target LIKE '//%' THEN substr(target, 3)
        WHEN target <> '' AND NOT target LIKE '#%' AND NOT regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:')
            THEN host || resolved || regexp_extract(target, '\?[^#]*') END AS rest
    FROM z
), l AS (
    SELECT address AS a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        || CASE WHEN regexp_extract(rest, '^[^/?#]*([^#]*)', 1) LIKE '/%' THEN '' ELSE '/' END
        || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b
    FROM f WHERE rest IS NOT NULL AND address IS NOT NULL
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
nodes AS (SELECT DISTINCT b AS node, regexp_extract(b, '^[^/?#]*') AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
judged AS (
    SELECT node, arg_max(action, length(rhost || rpath)) AS action
    FROM nodes JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY node
), passed AS (
    SELECT r.a, bool_or(coalesce(action = 'block', false)) AND NOT bool_or(coalesce(action = 'allow', false)) AS blocked
    FROM r LEFT JOIN judged ON judged.node = r.b GROUP BY r.a
), best AS (
    SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
    FROM a JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT a.page_id, a.host, a.path, best.rule,
    coalesce(best.action, CASE WHEN passed.blocked THEN 'block' END, 'allow') AS verdict
FROM a LEFT JOIN best ON best.page_id = a.page_id LEFT JOIN passed ON passed.a = a.address
""",
    "op10_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (
    SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
    FROM x
), g AS (
    SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (SELECT k.*, g.keeper IS NOT NULL AND g.keeper <> k.doc_id AS lost FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
