"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of
parts merge into the sketch of the whole, and containment can be estimated between a short
and a very long document. All of it is built-in functions on arrays within a row.

A fingerprint is text: the number of distinct shingles, a digest of all of them, and the kept
hashes in order. Equal texts have equal fingerprints.

Cases: null counts as empty; an empty text has no shingle, fewer words than a shingle give the
whole sequence as one. Two sketches without any kept hash are alike (1) if their digests are
equal, else unlike (0). Repeated rows get the same fingerprint. ``following`` orders rows with
the same doc_id by the hash of their text; rows without a doc_id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.line_dedup import LOWER, UPPER
from sedimenta.llm.quality_rules import word_array

WIDTH = 5
FRACTION = 1 / 8
# Buckets of neighbouring ids for each shuffle partition.
SPREAD = 4


def _shingle_steps(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the array ``name`` of hashes of all five-word shingles, each from two of the size before."""
    words = F.transform(word_array(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)), lambda w: F.xxhash64(w))
    df = df.withColumn(name, words)
    size = F.size(name)
    df = df.withColumn(f"{name}_short", F.when((size > 0) & (size < WIDTH), F.array(F.xxhash64(F.col(name)))))
    part = lambda c, start, n: F.slice(c, start, F.greatest(F.lit(0), n))
    join = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    two, four = f"{name}_2", f"{name}_4"
    df = df.withColumn(two, join(part(name, 1, size - 1), part(name, 2, size - 1)))
    df = df.withColumn(four, join(part(two, 1, F.size(two) - 2), part(two, 3, F.size(two) - 2)))
    five = join(part(four, 1, F.size(four) - 1), part(name, 5, F.size(four) - 1))
    # The last four-word run starts a five-word shingle only if a word follows it.
    df = df.withColumn(name, F.coalesce(f"{name}_short", five))
    return df.drop(f"{name}_short", two, four)


def with_sketch(df: DataFrame, text: Column, name: str, fraction: float = FRACTION) -> DataFrame:
    """Adds a struct ``name`` of ``n``, ``digest`` and the sorted array ``kept``."""
    raw = f"{name}_raw"
    df = _shingle_steps(df, text, raw)
    below = F.lit(int(-(2**63) + fraction * 2**64)).cast("long")
    kept = F.sort_array(F.array_distinct(F.filter(raw, lambda h: h < below)))
    df = df.withColumn(f"{raw}_all", F.array_distinct(raw))
    digest = F.aggregate(f"{raw}_all", F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(h))
    df = df.withColumn(name, F.struct(F.size(f"{raw}_all").alias("n"), digest.alias("digest"), kept.alias("kept")))
    return df.drop(raw, f"{raw}_all")


def printed(sketch: Column) -> Column:
    """A sketch as text."""
    hashes = F.array_join(F.transform(sketch.kept, lambda h: F.lower(F.hex(h))), ",")
    return F.concat(sketch.n.cast("string"), F.lit(":"), F.lower(F.hex(sketch.digest)), F.lit(":"), hashes)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two documents from their sketches."""
    common = F.size(F.array_intersect(a.kept, b.kept))
    total = F.size(a.kept) + F.size(b.kept) - common
    same = (a.n == b.n) & (a.digest == b.digest)
    return F.when(same, 1.0).when(total > 0, common / total).otherwise(0.0).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second has; null if its sketch is empty."""
    return F.when(F.size(a.kept) > 0, F.size(F.array_intersect(a.kept, b.kept)) / F.size(a.kept))


def merged(a: Column, b: Column) -> Column:
    """The kept hashes of two parts taken together."""
    return F.sort_array(F.array_union(a, b))


def following(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """``doc_id, text, sketch, next_text, next_sketch``: the next row is the one before in doc_id; the first row follows the last.

    Rows are dealt to buckets of neighbouring ids; the first row of each bucket is copied to
    the bucket before it, so no task sees more than its bucket and texts move once. Bucket
    bounds are quantiles of the ids, a fixed number for each shuffle partition.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    id_key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    # Bucket 0 has the largest ids; ids that equal a cut stay together.
    steps = F.array(*[F.lit(c).cast("long") for c in reversed(cuts)]) if cuts else None
    bucket = F.size(F.filter(steps, lambda c: id_key < c)) if cuts else F.lit(0)
    order = [F.col("id_key").desc(), F.col("tie")]
    dealt = rows.select("doc_id", "text", id_key.alias("id_key"), F.xxhash64("text").alias("tie"), bucket.alias("bucket"))
    # Inverted bits turn the order around, and unlike a negated number never overflow.
    heads = dealt.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("id_key").alias("turned"), "tie")).alias("head"))
    listed = sorted((r["bucket"], ~r["head"]["turned"], r["head"]["tie"]) for r in heads.collect())
    schema = "h_key long, h_tie long, guest int"
    guests = [(key, tie, listed[i - 1][0]) for i, (_, key, tie) in enumerate(listed)]
    heading = F.broadcast(spark.createDataFrame(guests, schema))
    copied = (
        dealt.join(heading, (F.col("id_key") == F.col("h_key")) & (F.col("tie") == F.col("h_tie")))
        .select("doc_id", "text", F.lit(-(2**63)).cast("long").alias("id_key"), "tie", F.col("guest").alias("bucket"))
        .dropDuplicates(["bucket"])
    )
    both = dealt.withColumn("guest", F.lit(0)).unionByName(copied.withColumn("guest", F.lit(1)))
    window = Window.partitionBy("bucket").orderBy("guest", *order)
    both = with_sketch(both, F.col("text"), "sketch", fraction)
    led = both.withColumns({"next_text": F.lead("text").over(window), "next_sketch": F.lead("sketch").over(window)})
    return led.where("guest = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited(text: Column, following_text: Column) -> Column:
    """The last half of a text replaced by as much of the beginning of another."""
    size = F.length(text)
    half = F.floor(size / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), size - half), F.substring(following_text, F.lit(1), half))


def fingerprint(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """All columns of the documents and the struct ``sketch``."""
    return with_sketch(docs, F.col("text"), "sketch", fraction)
