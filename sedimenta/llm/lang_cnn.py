"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over a window of fixed length, the largest
response of each filter over the window goes into a softmax. Whole texts are cut into windows;
a text's probabilities are the means over its windows, weighted by their bytes.

Training takes windows at hashed places of a sample of labelled texts. The expected number of
sampled texts per language is the parameter ``per_language``; the sample is picked by hash, so
it is the same on every run, and only its short windows reach the driver.

Cases: a null text, or one without a letter, is ``und`` with score 0. Texts shorter than a window
are padded. Without labelled texts everything is ``und``. Repeated rows get the same result.
Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import textbytes as tb

WINDOW = 192
WIDTHS = (2, 3, 4)
# Windows that a sampled text gives, and the windows that training sees at least.
PLACES = 4
SEEN = 40_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class Network:
    """Byte embedding, one filter bank padded to the widest filter, and the softmax layer."""

    languages: tuple[str, ...]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    shift: np.ndarray


def _unfold(embedded: np.ndarray) -> np.ndarray:
    """All runs of the widest filter's length in each window, windows x places x features."""
    wide = max(WIDTHS)
    n, length, size = embedded.shape
    return np.lib.stride_tricks.sliding_window_view(embedded.reshape(n, -1), wide * size, axis=1)[:, ::size]


def _forward(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    runs = _unfold(net.embedding[windows])
    n, places, width = runs.shape
    flat = np.ascontiguousarray(runs).reshape(-1, width)
    response = (flat @ net.filters).reshape(n, places, -1)
    where = response.argmax(axis=1)
    best = np.take_along_axis(response, where[:, None, :], axis=1)[:, 0] + net.bias
    pooled = np.maximum(best, 0)
    return flat.reshape(n, places, width), where, pooled, pooled @ net.weights + net.shift


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mask(per_width: int, size: int) -> np.ndarray:
    """Ones where a filter reaches: a narrow filter sees the first bytes of a run only."""
    mask = np.zeros((max(WIDTHS) * size, per_width * len(WIDTHS)), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * size, i * per_width : (i + 1) * per_width] = 1
    return mask


def pad(pieces: list[bytes]) -> np.ndarray:
    out = np.zeros((len(pieces), WINDOW), np.uint8)
    for i, piece in enumerate(pieces):
        out[i, : len(piece)] = np.frombuffer(piece[:WINDOW], np.uint8)
    return out


def train(
    windows: np.ndarray, labels: list[str], per_width: int = 8, size: int = 6, epochs: int = 4, seed: int = 7
) -> Network | None:
    """Gradient descent with Adam on padded windows; None without labels."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    mask = _mask(per_width, size)
    count = mask.shape[1]
    values = {
        "embedding": rng.normal(0, 0.5, (256, size)), "filters": rng.normal(0, 0.4, mask.shape) * mask,
        "bias": np.zeros(count), "weights": rng.normal(0, 0.3, (count, len(languages))), "shift": np.zeros(len(languages)),
    }
    values = {k: v.astype(np.float32) for k, v in values.items()}
    first = {k: np.zeros_like(v) for k, v in values.items()}
    second = {k: np.zeros_like(v) for k, v in values.items()}
    wanted = np.array([languages.index(x) for x in labels])
    step = 0
    for _ in range(max(epochs, SEEN // max(1, len(windows)))):
        order = rng.permutation(len(windows))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            step += 1
            net = Network(languages, **values)
            runs, where, pooled, logits = _forward(net, windows[batch])
            error = _softmax(logits)
            error[np.arange(len(batch)), wanted[batch]] -= 1
            error /= len(batch)
            back = (error @ net.weights.T) * (pooled > 0)
            hit = runs[np.arange(len(batch))[:, None], where]  # batch x filter x run
            to_runs = back[:, :, None] * net.filters.T[None]
            seen = windows[batch][np.arange(len(batch))[:, None, None], where[:, :, None] + np.arange(max(WIDTHS))]
            to_bytes = np.zeros_like(net.embedding)
            np.add.at(to_bytes, seen.ravel(), to_runs.reshape(-1, size))
            grads = {
                "embedding": to_bytes, "filters": np.einsum("bf,bfr->rf", back, hit) * mask, "bias": back.sum(axis=0),
                "weights": pooled.T @ error, "shift": error.sum(axis=0),
            }
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                values[k] = (values[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return Network(languages, **values)


def probabilities(net: Network, windows: np.ndarray, batch: int = 512) -> np.ndarray:
    """Softmax of padded windows, a bounded number at a time."""
    parts = [_softmax(_forward(net, windows[i : i + batch])[3]) for i in range(0, len(windows), batch)]
    return np.concatenate(parts) if parts else np.zeros((0, len(net.languages)))


def predict(net: Network | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text."""
    data, offsets = tb.buffers(texts)
    docs = len(offsets) - 1
    langs, scores = [UNKNOWN] * docs, np.zeros(docs)
    if net is None or not docs:
        return langs, scores
    sizes = np.diff(offsets)
    parts = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(docs), parts)
    first = np.concatenate([[0], np.cumsum(parts)])[:-1]
    starts = offsets[:-1][doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
    lengths = np.minimum(WINDOW, offsets[1:][doc] - starts)
    places = starts[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < lengths[:, None]
    windows = np.where(inside, data[np.minimum(places, max(0, len(data) - 1))], 0) if len(doc) else np.zeros((0, WINDOW), np.uint8)
    chance = probabilities(net, windows) * lengths[:, None]
    total = np.zeros((docs, len(net.languages)))
    np.add.at(total, doc, chance)
    total /= np.maximum(sizes, 1)[:, None]
    letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)])
    plain = letters[offsets[1:]] > letters[offsets[:-1]]
    for i in range(docs):
        if plain[i] or (sizes[i] and _LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))):
            best = int(total[i].argmax())
            langs[i], scores[i] = net.languages[best], min(1.0, float(total[i, best]))
    return langs, scores


def sample_windows(docs: DataFrame, lang: str = "lang", per_language: int = 1500) -> tuple[np.ndarray, list[str]]:
    """Windows at hashed places of sampled texts; about ``per_language`` texts a language."""
    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    sizes = {r[lang]: r["count"] for r in known.groupBy(lang).count().collect()}
    if not sizes:
        return np.zeros((0, WINDOW), np.uint8), []
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64("text", "nth"), F.greatest(F.lit(1), F.length("text") - WINDOW)) + 1
    picked = (
        known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col(lang)] * (1 << 20))
        .select(F.col(lang).alias("lang"), "text", F.explode(F.sequence(F.lit(1), F.lit(PLACES))).alias("nth"))
        .select("lang", F.substring(F.col("text"), place.cast("int"), F.lit(WINDOW)).alias("piece"))
        .where(F.col("piece").rlike(r"\p{L}"))
        .orderBy("lang", "piece")
        .collect()
    )
    return pad([r["piece"].encode()[:WINDOW] for r in picked]), [r["lang"] for r in picked]


def identify(docs: DataFrame, learn: Column | None = None, per_language: int = 1500, lang: str = "lang") -> DataFrame:
    """The documents without their text, with ``lang_pred`` and ``score``; learns from rows where ``learn`` holds."""
    net = train(*sample_windows(docs.where(learn if learn is not None else F.lit(True)), lang, per_language))
    names = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.chunks(batch, limit=tb.CHUNK_BYTES // 4):
                langs, scores = predict(net, part["text"])
                yield pa.RecordBatch.from_arrays(
                    [*[part[c] for c in names], pa.array(langs, pa.string()), pa.array(scores)],
                    names=[*names, "lang_pred", "score"],
                )

    return docs.mapInArrow(run, schema)
