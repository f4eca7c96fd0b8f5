"""Quality classifier: supervised subword embeddings.

A word is the mean of the learned vectors of its hashed features (the word itself and its character
n-grams with word marks, in bytes); a document is the mean of its words plus the mean of its hashed
word bigrams; a softmax over two classes is trained on it by stochastic gradient descent in numpy. Once
trained, a feature's vector and the output layer act as one number, so a worker scores each distinct
word once and a text in a few array operations.

Training takes a bounded sample of labelled texts, `train_docs` a class, drawn by a hash of the id. A
text of over `train_chars` characters goes in as one slice of that length from a place that its hash
chooses; the classes' true shares are restored in the output. Scoring takes whole texts, in one pass
without a shuffle.

Null and empty texts have no words and get the classes' shares as score; labels other than 0 and 1
are left out; with labels of fewer than two classes every score is the share of 1 (0.5 without
labels); repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from .shared import byte_slices, in_arrow, labelled_sample, mix, per_text

#: Buckets of words and their n-grams, and of bigrams behind them.
BUCKETS, BIGRAMS = 1 << 15, 1 << 17
GRAMS = (3, 4, 5)
DIM, EPOCHS, RATE, BATCH, SEED = 8, 20, 1.0, 16, 7
TRAIN_DOCS, TRAIN_CHARS = 1000, 1 << 16
MEMORY_WORDS = 200_000
#: New words that a worker hashes at a time, and bytes of texts whose features it holds in training.
HASHED_WORDS, EXTRACT_BYTES = 8192, 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word its hash; buckets of all words' features, and how many each word has. Words aren't empty."""
    raw = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    stream = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(stream)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=0)), _FACTOR))
    names = mix(np.add.reduceat(stream * powers[place], starts)) if len(raw) else np.zeros(0, np.uint64)
    room = np.repeat(lengths, lengths) - place
    owners, buckets = [np.arange(len(raw))], [names % np.uint64(BUCKETS)]
    for n in GRAMS:
        at = np.flatnonzero(room >= n)
        gram = np.full(len(at), n, np.uint64)
        for i in range(n):
            gram = gram * _FACTOR + stream[at + i]
        owners.append(np.repeat(np.arange(len(raw)), lengths)[at])
        buckets.append(mix(gram) % np.uint64(BUCKETS))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return names, np.concatenate(buckets)[order].astype(np.int64), np.bincount(owner, minlength=len(raw))


def _pairs(names: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the bigrams of texts whose words lie between edges, and the text of each."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    return (BUCKETS + mix(names[inside] * _FACTOR + names[inside + 1]) % np.uint64(BIGRAMS)).astype(np.int64), owner[inside]


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Edges of the texts in the row of their words, the words as numbers, and the distinct words. White space parts them."""
    split = pc.utf8_split_whitespace(texts)
    edges, words = split.offsets.to_numpy().astype(np.int64), split.flatten()
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.cumsum(there)])[edges - edges[0]]
    words = words.filter(pa.array(there)).dictionary_encode()
    return edges, words.indices.to_numpy(), words.dictionary.to_pylist()


def document_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text, buckets and their weights: those of words sum to 1, and those of bigrams."""
    edges, codes, words = _split(texts)
    names, buckets, counts = _hashed(words)
    firsts = np.cumsum(counts) - counts
    pairs, owner = _pairs(names[codes], edges)
    for t in range(len(texts)):
        own = codes[edges[t] : edges[t + 1]]
        each = counts[own]
        at = np.repeat(firsts[own] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        two = pairs[np.searchsorted(owner, t) : np.searchsorted(owner, t, side="right")]
        found, which = np.unique(np.concatenate([buckets[at], two]), return_inverse=True)
        weights = np.concatenate([np.repeat(1 / (each * max(1, len(own))), each), np.full(len(two), 1 / max(1, len(two)))])
        yield found, np.bincount(which.ravel(), weights, len(found))


class QualityModel:
    """One number per bucket, and a bias: the logit of class 1 is the weighted sum over a document plus the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def scorer(self):
        """A function from texts to scores that remembers words."""
        places: dict[str, int] = {}
        names, values = np.zeros(0, np.uint64), np.zeros(0)

        def score(texts: pa.Array) -> list[pa.Array]:
            nonlocal names, values
            edges, codes, words = _split(texts)
            if len(places) > MEMORY_WORDS:
                places.clear()
                names, values = names[:0], values[:0]
            new = [w for w in words if w not in places]
            if new:
                places.update(zip(new, range(len(places), len(places) + len(new)), strict=True))
                more_names, more_values = [names], [values]
                for a in range(0, len(new), HASHED_WORDS):
                    hashed, buckets, counts = _hashed(new[a : a + HASHED_WORDS])
                    more_names.append(hashed)
                    more_values.append(np.add.reduceat(self.weights[buckets].astype(float), np.cumsum(counts) - counts) / counts)
                names, values = np.concatenate(more_names), np.concatenate(more_values)
            at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))[codes]
            pairs, owner = _pairs(names[at], edges)
            n = np.diff(edges)
            z = self.bias + np.bincount(np.repeat(np.arange(len(n)), n), values[at], len(n)) / np.maximum(n, 1)
            z += np.bincount(owner, self.weights[pairs], len(n)) / np.maximum(n - 1, 1)
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))]

        return score


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float) -> QualityModel:
    """rows: buckets, weights, label. prior: share of label 1 among all labelled rows."""
    share = sum(y for _, _, y in rows) / max(1, len(rows))
    logit = lambda p: math.log(p / (1 - p))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not 0 < share < 1:
        return QualityModel(np.zeros(BUCKETS + BIGRAMS), logit(prior))
    rng = np.random.default_rng(SEED)
    vectors = (rng.uniform(-1, 1, (BUCKETS + BIGRAMS, DIM)) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    # Sorted first, so that the order in which rows arrive doesn't matter.
    rows = sorted(rows, key=lambda r: (r[2], len(r[0]), zlib.crc32(np.sort(r[0]).tobytes())))
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            batch = [rows[i] for i in order[a : a + BATCH]]
            hidden = np.stack([w @ vectors[b] for b, w, _ in batch])
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), [y for _, _, y in batch]] -= 1
            back = p @ out.T
            out -= rate * hidden.T @ p / len(batch) * 4
            bias -= rate * p.mean(0)
            for (b, w, _), g in zip(batch, back, strict=True):
                vectors[b] -= (rate * 4) * w[:, None] * g
            done += len(batch)
    return QualityModel(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]) + logit(prior) - logit(share))


def train_quality_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, labels: DataFrame | None = None, train_chars: int = TRAIN_CHARS) -> QualityModel:
    """labels: a table of (id_col, label_col), where docs don't hold the label themselves."""
    sample, counts = labelled_sample(docs, labels, id_col, text_col, label_col, train_docs, train_chars, "quality")
    if sample is None:
        return QualityModel(np.zeros(BUCKETS + BIGRAMS), 0.0)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(0), EXTRACT_BYTES):
                packed = [(f.astype("<u4").tobytes(), w.astype("<f4").tobytes()) for f, w in document_features(batch.column(0)[a:b])]
                columns = [pa.array(c, pa.binary()) for c in zip(*packed, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(1)[a:b]], names=["buckets", "weights", "label"])

    # One partition is on the driver's JVM at a time; rows stay as they are sent.
    found = in_arrow(sample, extract, "buckets binary, weights binary, label int").toLocalIterator()
    data = [(np.frombuffer(r["buckets"], "<u4"), np.frombuffer(r["weights"], "<f4"), r["label"]) for r in found]
    return fit(data, counts.get(1, 0) / sum(counts.values()))


def score_quality(docs: DataFrame, model: QualityModel, kept: list[str], text_col: str = "text", *more: Column) -> DataFrame:
    """A row per document: the kept columns, `more`, score."""
    return per_text(docs, text_col, kept, model.scorer, "score double", more)
