"""Fuzzy similarity of two texts, 0 to 100, by insertions and deletions; for the few rows that exact tests leave open."""

from __future__ import annotations

import re
from functools import partial as with_arguments

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors: one step a character of b."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        kept = row & masks.get(c, 0)
        row = (row + kept | row - kept) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty texts are alike."""
    both = len(a) + len(b)
    return 200 * common_length(a, b) / both if both else 100.0


def _shared(short: np.ndarray, long: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each part of `long` how many signs it shares with `short`, repeats counted: one pass a distinct sign."""
    total = np.zeros(len(starts), np.int64)
    for sign, n in zip(*np.unique(short, return_counts=True), strict=True):
        upto = np.concatenate([[0], np.cumsum(long == sign)])
        total += np.minimum(upto[stops] - upto[starts], n)
    return total


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def partial(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter text with any part of the longer one of its length, 0 if that is below `least`; parts at the ends may be shorter.

    What a part can reach is bounded by the signs and by the pairs of signs that it shares with the shorter text: a sign left out
    spoils two pairs, one put in spoils one. Parts are looked at in the order of that bound, until none can be better.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n, x, y = len(short), _codes(short), _codes(long)
    first = np.arange(1 - n, len(long))
    starts, stops = np.maximum(first, 0), np.minimum(first + n, len(long))
    both = n + stops - starts
    pairs = _shared((x[:-1] << 21) + x[1:], (y[:-1] << 21) + y[1:], starts, np.maximum(stops - 1, starts))
    bound = 200 * np.minimum(_shared(x, y, starts, stops), (pairs + both + 1) // 3) / both
    best, seen = 0.0, set()
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] <= best or bound[i] < least:
            break
        part = long[starts[i] : stops[i]]
        if part not in seen:
            seen.add(part)
            best = max(best, ratio(short, part))
    return best if best >= least else 0.0


def token_set(a: str, b: str) -> float:
    """The best ratio among the common words and the common words with either text's own ones; words in order of the alphabet."""
    first, second = (set(re.split(r"\s+", t.strip())) - {""} for t in (a, b))
    if not first or not second:
        return 0.0
    shared = " ".join(sorted(first & second))
    own = [" ".join(sorted(x)) for x in (first - second, second - first)]
    if shared and not all(own):
        return 100.0
    joined = [f"{shared} {x}".strip() for x in own]
    return max([ratio(joined[0], joined[1]), *(ratio(shared, j) for j in joined if shared)])


def _each(measure):
    @F.pandas_udf(DoubleType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return similar


partial_ratio, token_set_ratio = _each(partial), _each(token_set)


def partial_ratio_from(least: float):
    """The same, 0 below `least`, which spares most parts of a long text."""
    return _each(with_arguments(partial, least=least))
