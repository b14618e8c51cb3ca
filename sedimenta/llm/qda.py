"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of whole texts are ratios with a weak prior, so that short texts lie near the
centre, and their variance is evened out by a square-root transform. Class means and
covariances come from sums that Spark adds up over all labelled rows; only those sums reach
the driver. Covariances shrink towards their pooled form and towards its diagonal, Cholesky
factors are computed once, and a score is the sigmoid of the difference of the class
log-densities (Mahalanobis distances) plus the log prior odds.

Cases: null and empty texts have the prior statistics and get a score like any other text.
Labels other than 0 and 1, labels without a document and repeated labels of a document that
disagree don't count. With fewer than two rows of a class, or without labels, every score is
0.5. Repeated rows get the same score. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sedimenta.llm import textbytes as tb
from sedimenta.llm.storage import row_key, stash

FEATURES = [
    "symbols", "upper", "digits", "bangs", "bars", "stops", "distinct_words", "next_same",
    "dup_triples", "word_length", "short_words", "long_words",
]
SYMBOLS = b"#*$%&<>"


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_TABLES = {
    "symbols": _class(SYMBOLS), "upper": _class(bytes(range(65, 91))), "digits": _class(b"0123456789"),
    "bangs": _class(b"!"), "bars": _class(b"|"), "stops": _class(b".,;"),
}


def _ratio(count, total, prior: float, weight: float):
    return np.sqrt((count + prior * weight) / (total + weight))


def _repeats(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """For each text, its values that it had before."""
    if not len(values):
        return np.zeros(docs)
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d[1:][same], minlength=docs).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text, in the order of ``FEATURES``."""
    data, offsets = tb.buffers(texts)
    docs = len(offsets) - 1
    starts, ends, bounds = tb.word_spans(data, offsets)
    words = np.diff(bounds).astype(float)
    doc = np.repeat(np.arange(docs), np.diff(bounds))

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    # Characters without blanks; bytes that continue a character don't count.
    chars = total((data & 0xC0 != 0x80) & ~tb.WHITE[data])
    first = np.concatenate([[0], np.cumsum((data & 0xC0 != 0x80), dtype=np.int64)])
    lengths = (first[ends] - first[starts]).astype(float)
    hashes = tb.span_hashes(tb.LOWER[data], starts, ends)
    out = [_ratio(total(_TABLES[k][data]), chars, p, 30) for k, p in
           (("symbols", 0.002), ("upper", 0.03), ("digits", 0.002), ("bangs", 0.001), ("bars", 0.001), ("stops", 0.03))]
    same = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    triple, triple_bounds = tb.shingles(data, offsets, 3)
    triple_doc = np.repeat(np.arange(docs), np.diff(triple_bounds))
    # Distinct words against the square root of their number: much the same for long and short texts.
    distinct = words - _repeats(hashes, doc, docs)
    out.append(np.log((distinct + 5) / (words + 5) ** 0.8))
    out.append(_ratio(np.bincount(doc[1:][same], minlength=docs), words, 0.01, 20))
    out.append(_ratio(_repeats(triple, triple_doc, docs), np.diff(triple_bounds), 0.01, 20))
    out.append(np.log((np.bincount(doc, lengths, minlength=docs) + 50) / (words + 10)))
    out.append(_ratio(np.bincount(doc[lengths <= 2], minlength=docs), words, 0.25, 20))
    out.append(_ratio(np.bincount(doc[lengths >= 16], minlength=docs), words, 0.02, 20))
    return np.column_stack(out) if docs else np.zeros((0, len(FEATURES)))


def with_statistics(docs: DataFrame, detail: str = "quality_stats") -> DataFrame:
    """The documents' other columns and their statistics, an array; the text itself is left out."""
    names = [c for c in docs.columns if c != "text"]
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add(detail, ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.chunks(batch):
                rows = statistics(part["text"])
                flat = pa.array(rows.ravel(), pa.float64())
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [*[part[c] for c in names], pa.ListArray.from_arrays(ends, flat)], names=[*names, detail]
                )

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means and Cholesky factors of both classes; None where there was too little to learn from."""

    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    offset: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), 0.5)
        density = []
        for mean, factor in zip(self.means, self.factors):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * (z**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        odds = np.clip(density[1] - density[0] + self.offset, -500, 500)
        return 1 / (1 + np.exp(-odds))


def fit(rows: DataFrame, label: str, detail: str, to_pooled: float = 0.3, to_diagonal: float = 0.1) -> Discriminant:
    """Learn from all rows with a label of 0 or 1; Spark adds up one set of sums a class."""
    k = len(FEATURES)
    x = [F.col(detail)[i] for i in range(k)]
    sums = [F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]]
    sums += [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    got = {r["label"]: r for r in rows.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label")).agg(*sums).collect()}
    if any(got.get(c) is None or got[c]["n"] < 2 for c in (0, 1)):
        return Discriminant()
    means, covs, sizes = [], [], []
    for c in (0, 1):
        n = got[c]["n"]
        mean = np.array([got[c][f"s{i}"] for i in range(k)]) / n
        cross = np.array([[got[c][f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n
        means.append(mean)
        covs.append(cross - np.outer(mean, mean))
        sizes.append(n)
    pooled = (covs[0] * sizes[0] + covs[1] * sizes[1]) / sum(sizes)
    factors = []
    for cov in covs:
        cov = (1 - to_pooled) * cov + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(k)
        factors.append(np.linalg.cholesky(cov))
    return Discriminant(np.array(means), np.array(factors), float(np.log(sizes[1] / sizes[0])))


def score(rows: DataFrame, model: Discriminant, detail: str = "quality_stats", out: str = "score") -> DataFrame:
    """Rows with a score from 0 to 1 in place of their statistics."""

    @F.pandas_udf("double")
    def scored(values: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(values.to_numpy())) if len(values) else np.zeros(0))

    return rows.withColumn(out, scored(F.col(detail))).drop(detail)


def settled(labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id`` and ``label`` of documents whose labels of 0 or 1 agree."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    both = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most"))
    return both.where(F.col("label") == F.col("_most")).drop("_most")


def classify(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """The documents without their text, with a ``score``; learns from documents where ``learn`` holds."""
    detail = row_key(docs, "quality_stats")
    rows = stash(with_statistics(docs, detail), "quality")
    taught = rows.where(learn if learn is not None else F.lit(True)).select("doc_id", detail)
    model = fit(taught.join(settled(labels), "doc_id"), "label", detail)
    return score(rows, model, detail)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, same columns, with a score of at least ``least``; learns from all labelled documents."""
    detail = row_key(docs, "quality_stats")
    rows = stash(with_statistics(docs.select("doc_id", "text"), detail).where(F.col("doc_id").isNotNull()), "quality")
    model = fit(rows.join(settled(labels), "doc_id"), "label", detail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.chunks(batch):
                yield part.filter(pa.array(model.scores(statistics(part["text"])) >= least))

    return docs.mapInArrow(run, docs.schema)
