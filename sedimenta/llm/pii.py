"""Information-theoretic sanitisation of personal data, with built-in functions only.

Base entities (email, ip, card, phone) come from patterns. Then the corpus tells which words
give an entity away: for each entity value that occurs in several different texts, the words
around it, over line breaks too, are its candidates, and a candidate's disclosure is its pointwise mutual information
with the entity as a share of the entity's information content,

    PMI(e; t) / IC(e) = 1 + log2(p(e | t)) / IC(e),

with counts of different texts over the whole corpus. Every occurrence of a word above the upper
threshold is removed, above the lower one it is generalised to its shape.

Spans depend on a text alone, so all work is done once per different text, told by its hashes.
Whole texts are shuffled only where they have copies, hold a revealing word or lose a span.

Cases: null counts as empty. Matches that fail their test are dropped without a retry. Copies of
a text count once on both sides, so copies alone never make a word revealing; different texts
with the same words beside an entity count each. Rows without a doc_id are worked on like others; repeated rows get the same spans. An empty table
gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.storage import row_key, stash
from sedimenta.operators.keyed_join import mark_keys_of, only_keys_of

# The kinds in the order that breaks ties, and their patterns. Quantifiers are
# possessive where nothing after them could match inside, so long runs take one pass.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
_ROW = ["_hash", "_sum"]


@dataclass(frozen=True)
class Disclosure:
    """What counts as evidence that a word gives an entity away, and what follows.

    Candidates are words of at least ``min_letters`` letters among the ``words`` nearest ones
    on each side, within ``chars`` characters. ``support`` is how many texts an entity, and a
    word with it, must have in common. From ``generalise`` on a word is replaced by its shape,
    from ``remove`` on it is removed.
    """

    words: int = 4
    chars: int = 80
    min_letters: int = 3
    support: int = 3
    generalise: float = 0.75
    remove: float = 0.9

    @property
    def pattern(self) -> Column:
        return F.lit(rf"\p{{L}}{{{self.min_letters},}}")


def _row_keys() -> list[Column]:
    return [F.xxhash64("text").alias("_hash"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_sum")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*_row_keys(), F.coalesce("text", F.lit("")).alias("_text"))


def _luhn(digits: Column) -> Column:
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    ip = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    size = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", ip)
        .when(kind == "card", size.between(14, 19) & F.when(size.between(14, 19), _luhn(digits)))
        .otherwise(size.between(10, 15))
    )


def _match_rows(kind: str, chars: int) -> Column:
    gaps = F.col(f"_g_{kind}")

    def row(found: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(gaps[i]).cast("long").alias("gap"), found.alias("found"),
            F.right(gaps[i], F.lit(chars)).alias("before"), F.left(gaps[i + 1], F.lit(chars)).alias("after"),
        )

    return F.transform(f"_m_{kind}", row)


def base_spans(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """Rows ``_hash, _sum, kind, start, end, found, before, after`` of all base matches, once for equal texts.

    A text split at a pattern gives the gaps, the pattern itself the matches; their running
    lengths are the places. Only rows of matches are shuffled, never texts.
    """
    hints = {"email": "@", "phone": "+"}
    may = {
        k: F.col("_text").contains(hints[k]) if k in hints else F.col("_text").rlike(r"[0-9]\.[0-9]" if k == "ip" else "[0-9]")
        for k in KINDS
    }
    work = _keyed(docs)
    for k in KINDS:
        work = work.withColumn(f"_g_{k}", F.when(may[k], F.split("_text", PATTERNS[k], -1)))
    for k in KINDS:
        hits = F.when(F.size(f"_g_{k}") > 1, F.regexp_extract_all("_text", F.lit(PATTERNS[k]), F.lit(0)))
        work = work.withColumn(f"_m_{k}", hits)
        work = work.withColumn(f"_m_{k}", F.coalesce(_match_rows(k, rule.chars), F.array()))
    each = work.select(*_ROW, F.explode(F.concat(*[f"_m_{k}" for k in KINDS])).alias("m")).select(*_ROW, "m.*")
    each = each.dropDuplicates([*_ROW, "kind", "i"])
    run = Window.partitionBy(*_ROW, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(run)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("found"))
    return placed.where(_valid(F.col("kind"), F.col("found"))).select(*_ROW, "kind", "start", "end", "found", "before", "after")


def _entity() -> Column:
    return F.concat("kind", F.lit(":"), F.lower("found"))


def _near_words(span: DataFrame, rule: Disclosure) -> DataFrame:
    """Rows ``entity, _hash, term``: the words beside each entity, and the text they stand in."""
    words = lambda c: F.regexp_extract_all(c, rule.pattern, F.lit(0))
    close = F.concat(
        F.reverse(F.slice(F.reverse(words(F.col("before"))), 1, rule.words)), F.slice(words(F.col("after")), 1, rule.words)
    )
    terms = F.array_distinct(F.transform(close, lambda w: F.lower(w)))
    return span.select(_entity().alias("entity"), "_hash", F.explode(terms).alias("term")).distinct()


def _words(text: Column, rule: Disclosure) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, rule.pattern, F.lit(0)), lambda w: F.lower(w)))


def _text_counts(docs: DataFrame, wanted: DataFrame | None = None, rule: Disclosure = Disclosure()) -> tuple[int, DataFrame]:
    """The number of different texts, and rows ``term, n_term``: in how many of them each (wanted) word stands.

    Words are counted over all rows, less what the further copies of a text add; so only texts
    that have copies are brought together, once each.
    """
    hashed = _keyed(docs)
    copied = stash(hashed.groupBy(*_ROW).agg(F.count("*").alias("copies")).where("copies > 1"), "copied-texts")
    total = docs.count() - (copied.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)

    def counted(texts: DataFrame, n: Column) -> DataFrame:
        # Each task adds up its words, and only one row a word and task is shuffled.
        words = texts.select(F.explode(_words(F.col("_text"), rule)).alias("term"), n.alias("n"))
        if wanted is not None:
            words = only_keys_of(words, ["term"], wanted)
        return words.groupBy("term").agg(F.sum("n").alias("n"))

    once = only_keys_of(hashed, _ROW, copied).dropDuplicates(_ROW).join(copied, _ROW)
    rows = counted(hashed, F.lit(1).cast("long")).unionByName(counted(once, 1 - F.col("copies")))
    return total, rows.groupBy("term").agg(F.sum("n").alias("n_term"))


def revealing_terms(docs: DataFrame, span: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """Rows ``term, disclosure`` of words that give away an entity at or above the lower threshold."""
    near = stash(_near_words(span, rule), "near-words")
    sizes = span.select(_entity().alias("entity"), "_hash").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= rule.support)
    pairs = stash(pairs.join(sizes, "entity"), "term-pairs")
    if pairs.isEmpty():
        # No word has the support, whatever its count: the corpus need not be counted.
        return pairs.select("term", F.lit(0.0).alias("disclosure"))
    total, counts = _text_counts(docs, pairs.select("term").distinct(), rule)
    content = F.log2(F.lit(float(total)) / F.col("n_entity"))
    share = F.least(F.lit(1.0), F.col("n_both") / F.greatest("n_term", "n_both"))
    disclosure = F.when(content > 0, 1 + F.log2(share) / content).otherwise(0.0)
    scored = pairs.join(counts, "term").withColumn("disclosure", disclosure)
    found = scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= rule.generalise)
    return stash(found, "revealing")


def term_spans(docs: DataFrame, terms: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """Rows ``_hash, _sum, kind, start, end, found, disclosure`` of every occurrence of a revealing word."""
    words = _keyed(docs).select(*_ROW, F.explode(_words(F.col("_text"), rule)).alias("term"))
    touched = stash(only_keys_of(words, ["term"], terms).join(terms.select("term"), "term").select(*_ROW).distinct(), "touched-texts")
    here = only_keys_of(_keyed(docs), _ROW, touched).dropDuplicates(_ROW).join(touched, _ROW, "left_semi")
    pieces = F.regexp_extract_all("_text", F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    each = here.select(*_ROW, F.posexplode(pieces).alias("i", "found"))
    run = Window.partitionBy(*_ROW).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.length("found").cast("long")).over(run)).withColumn("term", F.lower("found"))
    hit = placed.join(terms, "term")
    return hit.select(*_ROW, F.lit(TERM).alias("kind"), (F.col("end") - F.length("found")).alias("start"), "end", "found", "disclosure")


def find_spans(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """All spans of every different text: ``_hash, _sum, kind, rank, start, end, found, disclosure``."""
    base = stash(base_spans(docs, rule), "base-spans")
    terms = revealing_terms(docs, base, rule)
    rank = F.array_position(F.array(*[F.lit(k) for k in [*KINDS, TERM]]), F.col("kind"))
    spans = base.select(*_ROW, "kind", "start", "end", "found", F.lit(None).cast("double").alias("disclosure"))
    if not terms.isEmpty():
        extra = term_spans(docs, terms, rule)
        same = [extra[c] == base[c] for c in _ROW]
        apart = extra.join(base, [*same, (extra["start"] < base["end"]) & (base["start"] < extra["end"])], "left_anti")
        spans = spans.unionByName(apart)
    return spans.withColumn("rank", rank)


def _by_row(spans: DataFrame) -> DataFrame:
    item = F.struct("start", "rank", "end", "kind", "found", "disclosure")
    # Stored, so that joins with documents have a shuffle right under them and copies of a text can be split.
    return stash(spans.groupBy(*_ROW).agg(F.sort_array(F.collect_list(item)).alias("_spans")), "spans-of-texts")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def summarise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: ``doc_id``, counts by kind, ``base`` and ``spans`` as text."""
    found = _by_row(find_spans(docs, rule))
    met = docs.select("doc_id", *_row_keys()).join(found, _ROW, "left")
    spans = F.coalesce("_spans", F.array().cast(found.schema["_spans"].dataType))
    base = F.filter(spans, lambda s: s.kind != TERM)
    kinds = F.transform(spans, lambda s: s.kind)
    counts = [F.size(F.array_remove(kinds, k)) for k in KINDS]
    counts = [(F.size(spans) - n).cast("long").alias(f"n_{k}") for k, n in zip(KINDS, counts)]
    return met.select("doc_id", *counts, _listed(base).alias("base"), _listed(spans).alias("spans"))


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """The documents, same columns, with entities and revealing words replaced; null texts stay null."""
    spans = find_spans(docs, rule)
    # Overlapping spans share their text: a later one starts where those before it end.
    past = Window.partitionBy(*_ROW).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(past), F.lit(0).cast("long"))
    spans = spans.withColumn("start", F.greatest("start", reach)).where("start < `end`")
    found = _by_row(spans)
    names = docs.columns
    mark = row_key(docs, "row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(mark), *_row_keys())
    packed = mark_keys_of(packed, _ROW, found, "_may")
    clean = packed.where("NOT _may").select(*[F.col(mark).getField(c).alias(c) for c in names])
    met = packed.where("_may").join(found, _ROW, "left")
    body = F.col(mark).getField("text")
    shape = lambda w: F.when(w.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
    stand_in = lambda s: (
        F.when(s.kind != TERM, F.concat(F.lit("["), F.upper(s.kind), F.lit("]")))
        .when(s.disclosure >= rule.remove, F.lit(""))
        .otherwise(shape(s.found))
    )
    nexts = F.concat(F.transform(F.slice("_spans", 2, F.size("_spans")), lambda s: s.start), F.array(F.length(body).cast("long")))
    met = met.withColumn("_next", nexts)
    rest = F.zip_with(
        "_spans", "_next", lambda s, n: F.concat(stand_in(s), F.substring(body, (s.end + 1).cast("int"), (n - s.end).cast("int")))
    )
    head = F.substring(body, F.lit(1), F.col("_spans")[0].start.cast("int"))
    cleaned = F.when(F.col("_spans").isNull(), body).otherwise(F.concat(head, F.array_join(rest, "")))
    done = met.select(*[cleaned.alias(c) if c == "text" else F.col(mark).getField(c).alias(c) for c in names])
    return clean.unionAll(done)
