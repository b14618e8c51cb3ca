"""A corpus pipeline: reject, dedup lines, dedup documents, sanitise, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import line_dedup, ngram_join, packing, pii, qda
from sedimenta.llm.storage import stash

TOKENIZER = "byte_bpe_50k.json"


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """Columns as they were, with ``n_chars`` of the new text where there is such a column."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return qda.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others keep; a null text stays null."""
    done = line_dedup.deduplicate(docs)
    kept = F.when(F.col("text").isNotNull(), F.col(f"`{done.columns[-1]}`.kept_text"))
    return _with_text(done.withColumn("text", kept), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    return _with_text(pii.sanitise(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("PII", sanitise),
    ("best-fit packing", pack),
]

#: A discriminant, components over hashes and a genetic algorithm: no SQL for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return docs
