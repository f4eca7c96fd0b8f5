"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length.

Folding lower-cases, takes homoglyphs (accented, full-width, Cyrillic and Greek look-alikes) and digit
substitutions to plain letters, drops invisible signs, and turns other signs into spaces; l, 1 and i
fold to one letter, because 1 is written for either. The lexicon is learned from labelled rows: words
and word beginnings that toxic texts hold far more often than others, weighted by log odds. Phrases
with such a word that only other texts hold are exceptions: matches inside them don't count.

The score is a logistic function, fitted on the same rows, of the matched weight and of the weight per
word. Training takes a bounded sample, `train_docs` a class, drawn by a hash of the id; a text of over
`train_chars` characters goes in as one slice of that length from a place that its hash chooses. Scoring
takes whole texts in one pass without a shuffle.

Null and empty texts match nothing; without labels of both classes every score is 0; repeated rows
score alike; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .shared import labelled_sample, per_text

TRAIN_DOCS = 2_000
TRAIN_CHARS = 1 << 16
#: An entry follows so many different words in toxic texts at least (copies of one text don't make a word toxic), and has these log odds.
LEAST_PLACES, LEAST_LOG_ODDS = 5, 3.0
BEGINNINGS = (4, 5, 6)

# Digits and signs written for letters; Cyrillic and Greek letters by the Latin ones they look like.
_SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
_CYRILLIC = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g"}
_GREEK = {"α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}


class _Folding(dict):
    """Code point to folded text, worked out when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c.lower())
        out = ""
        for d in base:
            d = _SUBSTITUTES.get(d) or _CYRILLIC.get(d) or _GREEK.get(d) or d
            if unicodedata.category(d) in ("Mn", "Cf"):
                continue
            out += "i" if d == "l" else d if d.isalnum() else " "
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str) -> list[str]:
    """Folded words."""
    return text.translate(_FOLDING).split()


class Lexicon:
    """Entries are strings within " word word ... ": " word " for a word, " word" for a beginning; exceptions are phrases."""

    def __init__(self, entries: dict[str, float], exceptions: list[str] = (), weights: tuple[float, float, float] = (-30.0, 0.0, 0.0)):
        self.entries, self.exceptions, self.weights = entries, list(exceptions), weights

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for e, w in self.entries.items():
            found.add_word(e, (len(e), w))
        for e in self.exceptions:
            found.add_word(f" {e} ", (len(e) + 2, None))
        if len(found):
            found.make_automaton()
            return found
        return None

    def features(self, automaton: ahocorasick.Automaton | None, words: list[str]) -> tuple[float, float]:
        """Logarithm of the matched weight, and weight per 100 words. A word counts by its heaviest entry."""
        if automaton is None or not words:
            return 0.0, 0.0
        hits: dict[int, tuple[float, int]] = {}
        excepted: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight is None:
                excepted.append((start, end))
            elif weight > hits.get(start, (0.0, 0))[0]:
                hits[start] = weight, end
        # A match lies in an exception if, of those that start no later, one reaches its end.
        excepted.sort()
        starts, reach = [a for a, _ in excepted], [0, *accumulate((b for _, b in excepted), max)]
        total = sum(w for start, (w, end) in hits.items() if reach[bisect_right(starts, start)] < end)
        return math.log1p(total), 100 * total / len(words)

    def score(self, features: tuple[float, float]) -> float:
        z = self.weights[0] + self.weights[1] * features[0] + self.weights[2] * features[1]
        return 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))


def _entries(words: set[str]) -> set[str]:
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


def learn_lexicon(texts: list[tuple[str, int]], prior: float | None = None) -> Lexicon:
    """texts: (text, toxic). prior: share of toxic texts outside the sample."""
    folded = sorted((fold(t), y) for t, y in texts)
    n = Counter(y for _, y in folded)
    if not n[0] or not n[1]:
        return Lexicon({})
    others: Counter[str] = Counter()
    before: dict[str, set[str]] = defaultdict(set)
    for words, y in folded:
        if not y:
            others.update(_entries(set(words)))
        else:
            for a, b in zip(["", *words], words, strict=False):
                for e in _entries({b}):
                    before[e].add(a)
    places = {e: len(a) for e, a in before.items() if len(a) >= LEAST_PLACES}
    good = {e: w for e, a in places.items() if (w := math.log((min(a, n[1]) + 0.5) / (n[1] + 1)) - math.log((others[e] + 0.5) / (n[0] + 1))) >= LEAST_LOG_ODDS}
    entries: dict[str, float] = {}
    # Shortest first: a longer entry is left out unless it is clearly heavier than the beginning it extends.
    for e in sorted(good, key=lambda e: (len(e), e)):
        shorter = [entries[e[:k]] for k in range(2, len(e)) if e[:k] in entries]
        if not shorter or good[e] > max(shorter) + 2:
            entries[e] = good[e]
    phrases = {0: Counter(), 1: Counter()}
    risky = {e.strip() for e in entries if others[e]}
    for words, y in folded:
        phrases[y].update({f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in risky or b in risky})
    exceptions = sorted(p for p, c in phrases[0].items() if c >= 3 and not phrases[1][p])
    found = Lexicon(entries, exceptions)
    automaton = found.automaton()
    x = np.array([(1.0, *found.features(automaton, words)) for words, _ in folded])
    y = np.array([y for _, y in folded], dtype=float)
    share = n[1] / len(folded)
    w = _logistic(x, y)
    if prior:
        w[0] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    found.weights = tuple(float(v) for v in w)
    return found


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method; the bias isn't held back."""
    w, hold = np.zeros(x.shape[1]), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (p - y) + hold @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train_toxicity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS, labels: DataFrame | None = None, train_chars: int = TRAIN_CHARS) -> Lexicon:
    """labels: a table of (id_col, label_col), where docs don't hold the label themselves."""
    sample, counts = labelled_sample(docs, labels, id_col, text_col, label_col, train_docs, train_chars, "toxicity")
    if sample is None or len(counts) < 2:
        return Lexicon({})
    return learn_lexicon([(r["text"], r["label"]) for r in sample.toLocalIterator()], counts[1] / sum(counts.values()))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, kept: list[str], text_col: str = "text", *more: Column) -> DataFrame:
    """A row per document: the kept columns, `more`, score."""

    def scorer():
        automaton = lexicon.automaton()
        return lambda texts: [pa.array([lexicon.score(lexicon.features(automaton, fold(t.as_py()))) for t in texts], pa.float64())]

    return per_text(docs, text_col, kept, scorer, "score double", more)
