"""Language ID by prediction by partial matching.

Per language, a byte context tree of variable order: contexts are the up to ORDER bytes before a byte
in its word, the space before the word included. A byte seen in the longest context costs
-log2(c / (n + q)) bits, c its count, n all, q the distinct bytes there; otherwise an escape
-log2(q / (n + q)) is paid and the next shorter context asked, down to a uniform byte. Statistics are
frozen after training, so the code length of a word is exact and the same wherever it stands; a text
costs what its words cost, and the shortest code wins.

Training takes a bounded sample of the labelled texts: of each language the different texts with the smallest
hashes, one at least, until they have `train_bytes`; of a text of over `train_chars` characters one slice of
that length from a place that its hash chooses. So every language is learned, however long or often copied its texts.
Prediction takes whole texts. A worker keeps the costs of words it has seen; unseen words are costed
together by table look-ups.

Null texts and texts without a letter are `und` with score 0; with no labelled text everything is
`und`; equal code lengths go to the first language in order of name. Score: the winner's share of
2^-bits, bits per SCORE_SCALE of the text's bytes' square root.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import named, per_text, slice_of

ORDER = 4
TRAIN_BYTES = 600_000
TRAIN_CHARS = 1 << 16
#: Texts are first drawn to so many times the sample's bytes, and to so many texts a language.
SPARE, LEAST_DRAWN = 3, 30
#: Distinct words whose costs a worker keeps.
MEMORY_WORDS = 150_000
#: Bytes that are looked up at a time.
STEP_BYTES = 1 << 16
UNDETERMINED = "und"


class ContextTrees:
    """Frozen statistics of all languages: by order, sorted grams and contexts with a column per language."""

    def __init__(self, languages: list[str], texts: dict[str, list[str]], order: int = ORDER):
        self.languages, self.order = languages, order
        self.grams: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        streams = [_stream([w for t in texts[lang] for w in t.split()])[0] for lang in languages]
        for k in range(order + 1):
            found = [np.unique(_codes(s, k), return_counts=True) for s in streams]
            grams = np.unique(np.concatenate([g for g, _ in found])) if found else np.empty(0, np.uint64)
            counts = np.zeros((len(grams), len(languages)))
            for j, (g, c) in enumerate(found):
                counts[np.searchsorted(grams, g), j] = c
            contexts, at = np.unique(grams >> np.uint64(8), return_inverse=True)
            n, q = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
            np.add.at(n, at, counts)
            np.add.at(q, at, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, -np.log2(q / (n + q)), 0.0)
                cost = np.where(counts > 0, -np.log2(counts / (n + q)[at]), 0.0)
            lower = self._cost(grams & np.uint64((1 << 8 * k) - 1), k - 1) if k else np.full((len(grams), len(languages)), 8.0)
            self.grams.append(grams)
            self.costs.append(np.where(counts > 0, cost, escape[at] + lower))
            self.contexts.append(contexts)
            self.escapes.append(escape)

    def _cost(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of each gram of k + 1 bytes, by language."""
        out = np.full((len(grams), len(self.languages)), 8.0)
        if k < 0 or not len(grams):
            return out
        at = np.minimum(np.searchsorted(self.grams[k], grams), max(0, len(self.grams[k]) - 1))
        hit = self.grams[k][at] == grams if len(self.grams[k]) else np.zeros(len(grams), bool)
        out[hit] = self.costs[k][at[hit]]
        rest = grams[~hit]
        if len(rest):
            lower = self._cost(rest & np.uint64((1 << 8 * k) - 1), k - 1)
            context = rest >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], context), max(0, len(self.contexts[k]) - 1))
            known = self.contexts[k][at] == context if len(self.contexts[k]) else np.zeros(len(rest), bool)
            lower[known] += self.escapes[k][at[known]]
            out[~hit] = lower
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Bits of each word and the space after it, by language."""
        stream, starts = _stream(words)
        total = np.zeros((len(words), len(self.languages)))
        step = STEP_BYTES
        owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(stream))))
        inside = _depth(starts, len(stream))
        for k in range(self.order + 1):
            # Bytes whose context is of k bytes: the k-th of a word, or any later one for the full order.
            at = np.flatnonzero((inside == k) if k < self.order else (inside >= k))
            at = at[inside[at] > 0]
            for a in range(0, len(at), step):
                part = at[a : a + step]
                gram = np.zeros(len(part), np.uint64)
                for back in range(k, -1, -1):
                    gram = gram << np.uint64(8) | stream[part - back].astype(np.uint64)
                bits = self._cost(gram, k)
                for j in range(len(self.languages)):
                    total[:, j] += np.bincount(owner[part], bits[:, j], len(words))
        return total


def _stream(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, each after a space and before one; places of the leading spaces."""
    parts = [b" " + w.encode("utf-8", "surrogatepass") + b" " for w in words]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths


def _depth(starts: np.ndarray, n: int) -> np.ndarray:
    """Place of each byte in its word; the leading space is 0."""
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def _codes(stream: np.ndarray, k: int) -> np.ndarray:
    """Grams of k + 1 bytes that lie in one word; the leading space is context only."""
    if len(stream) <= k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(stream) - k, np.uint64)
    for i in range(k + 1):
        out = out << np.uint64(8) | stream[i : len(stream) - k + i].astype(np.uint64)
    # Words are framed by spaces: two in a row part them, so a gram within one holds no pair of spaces and doesn't end in a leading space.
    space = stream == 32
    lead = np.zeros(len(stream), bool)
    lead[0] = True
    lead[1:] = space[1:] & space[:-1]
    crossed = np.zeros(len(out), bool)
    for i in range(1, k + 1):
        crossed |= lead[i : len(stream) - k + i]
    if k == 0:
        crossed |= lead
    return out[~crossed]


def train_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, train_bytes: int = TRAIN_BYTES, train_chars: int = TRAIN_CHARS) -> ContextTrees:
    """From rows with a language; null texts and languages are left out. One row a language comes to the driver, and the sample."""
    rows = labelled.select(named(id_col).alias("id"), named(text_col).cast("string").alias("whole"), named(lang_col).cast("string").alias("lang")).where("whole is not null and lang is not null")
    # A text's turn is that of its hash: how often or by whom it was written doesn't matter.
    rate = F.pmod(F.xxhash64("whole", F.lit("language")), F.lit(1 << 52)) / float(1 << 52)
    text = slice_of(F.col("whole"), train_chars, "language")
    rows = rows.select("lang", rate.alias("rate"), text.alias("text"), F.octet_length(text).alias("bytes"))
    once = rows.groupBy("lang", "rate").agg(F.max("bytes").alias("bytes"))
    totals = once.groupBy("lang").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.min("rate").alias("first")).collect()
    if not totals:
        return ContextTrees([], {}, order)
    # A share that holds the sample several times over, then the sample itself, by turns: the first text and all before which the sample isn't full.
    shares = {r["lang"]: max(r["first"], SPARE * train_bytes / max(r["total"], 1), LEAST_DRAWN / r["n"]) for r in totals}
    limits = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
    drawn = rows.where(F.col("rate") <= limits[F.col("lang")]).distinct()
    before = F.sum("bytes").over(Window.partitionBy("lang").orderBy("rate", "text").rowsBetween(Window.unboundedPreceding, -1))
    texts: dict[str, list[str]] = {lang: [] for lang in sorted(shares)}
    for r in drawn.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < train_bytes).select("lang", "text").toLocalIterator():
        texts[r["lang"]].append(r["text"])
    return ContextTrees(list(texts), texts, order)


def score_languages(docs: DataFrame, trees: ContextTrees, kept: list[str], text_col: str = "text", *more: Column) -> DataFrame:
    """A row per document: the kept columns, `more`, lang_pred, score, bits_per_byte (of the winner)."""
    return per_text(docs, text_col, kept, lambda: _predictor(trees), "lang_pred string, score double, bits_per_byte double", more)


def _predictor(trees: ContextTrees):
    """A function from texts to (language, score, bits a byte) that remembers words."""
    languages = trees.languages
    place: dict[str, int] = {}
    costs = np.zeros((0, len(languages)))

    def predict(texts: pa.Array) -> list[pa.Array]:
        nonlocal place, costs
        best: list[str] = []
        scores: list[float] = []
        rates: list[float] = []
        split = [t.split() for t in texts.to_pylist()]
        if languages:
            if len(place) > MEMORY_WORDS:
                place, costs = {}, costs[:0]
            new = list(set().union(*split) - place.keys())
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            costs = np.concatenate([costs, trees.words(new)])
        for n, words in zip(pc.binary_length(texts).to_pylist(), split, strict=True):
            if not languages or not _has_letter(words):
                best.append(UNDETERMINED)
                scores.append(0.0)
                rates.append(0.0)
                continue
            bits = costs[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(0)
            top = int(bits.argmin())
            best.append(languages[top])
            scores.append(float(1 / np.exp2(np.maximum((bits[top] - bits) / math.sqrt(n), -1000)).sum()))
            rates.append(float(bits[top]) / n)
        return [pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]

    return predict


def _has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)
