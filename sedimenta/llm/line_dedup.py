"""Line dedup: lines that many documents share stay in one of them.

Explode normalised lines, hash, count distinct documents per hash, drop lines over the
threshold, reassemble by position. Only hashes of long enough lines are shuffled; texts move
once, and only documents that lose a line are taken apart and put together again.

Cases: a null text counts as one empty line (``deduplicate`` keeps it null unless told
otherwise). Rows without a doc_id keep all lines and don't count as a document. Repeated rows
count as one document and get the same result; rows that share a doc_id but not the text are
kept apart. An empty table gives an empty result. Other columns pass through, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.storage import row_key, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DETAIL = "line_dedup"
BLANKS = " \t\n\u000b\f\r"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Rows ``doc_id, text_hash, drop`` of documents that lose lines; drop has their positions, from 0."""
    lines = (
        docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.crc32(F.concat("key", F.lit("#"))).alias("h2"))
    )
    lines = stash(lines, "lines")
    found = (
        lines.select("h1", "h2", "doc_id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .drop("n_docs")
    )
    # Stored, so that the join below has a shuffle right under it and a hot line can be split.
    found = stash(found, "repeated-lines")
    lost = lines.join(found, ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"))


def deduplicate(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``kept_text`` in a struct, the last column.

    It is named ``DETAIL``, with underscores in front if the documents have a column of that name.
    """
    drops = repeated_lines(docs, min_chars, min_docs).select(
        F.col("doc_id").alias("_drop_doc"), F.col("text_hash").alias("_drop_hash"), "drop"
    )
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text")
    joined = packed.join(
        drops,
        (F.col("doc_id") == F.col("_drop_doc")) & (F.xxhash64("text") == F.col("_drop_hash")),
        "left",
    )
    text = F.coalesce("text", F.lit(""))
    parts = joined.select(
        "row", text.alias("text"), F.sort_array("drop").alias("drop"),
        F.when(F.col("drop").isNotNull(), _lines(F.col("text"))).alias("lines"),
    )
    # Lines between two dropped positions stay together: slices, not a search for each line.
    edges = parts.withColumn("lo", F.concat(F.array(F.lit(-1)), "drop")).withColumn(
        "hi", F.concat("drop", F.array(F.size("lines")))
    )
    pieces = F.flatten(F.zip_with("lo", "hi", lambda a, b: F.slice(F.col("lines"), a + 2, b - a - 1)))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    result = F.struct(
        (breaks + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(pieces, "\n")).alias("kept_text"),
    )
    # First by itself: beside columns of the documents its names could be taken for theirs.
    done = edges.select("row", result.alias("result"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("result").alias(row_key(docs, DETAIL)))
