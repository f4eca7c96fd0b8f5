"""Periodic runs of words by Crochemore's partition refinement, and texts with their repeats collapsed.

A run is a stretch of consecutive words with smallest period q, of `least_length` words and
`least_exponent` periods at least, that no neighbouring word extends. Positions are kept in classes of
equal factors, refined from length k to k + 1 by the smaller-half strategy: of a class that has split, all
parts but the largest say which positions before them part too, so a position is touched a logarithmic
number of times. Members of a class are linked in order of position; where neighbours at length k lie k
apart, a square of a primitive root begins, and squares of one period at consecutive positions are one run.

All texts of a slice of an Arrow batch are refined together as numpy arrays, each closed by a word of
its own, so no factor reaches from one text into the next. A text is never parted, since a run may span it
all; a worker's memory grows with one slice or the longest text. One pass over the input, no shuffle.

Null, empty and blank texts have no words and no runs; a slice ends when no two positions share a class;
repeated rows, null ids and ties pass row by row; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .shared import per_text

LEAST_LENGTH, LEAST_EXPONENT = 6, 4


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of each range of `lengths` from `starts`, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Partition:
    """Positions by equal factors of the present length, with each class's members linked in order.

    `reach` bounds the distances of interest by position; further neighbours are linked, but not reported.
    """

    def __init__(self, letters: np.ndarray, reach: np.ndarray):
        n = len(letters)
        self.n, self.reach, self.length = n, reach, 1
        self.order = np.argsort(letters, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        ranked = letters[self.order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sizes = np.diff(np.append(starts, n))
        self.classes = len(starts)
        self.cls, self.begin, self.size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
        self.cls[self.order] = np.repeat(np.arange(len(starts)), sizes)
        self.begin[: len(starts)], self.size[: len(starts)] = starts, sizes
        # Place n stands for "none".
        self.next, self.prev = np.full(n + 1, n), np.full(n + 1, n)
        self._link(self.order, starts)
        self.marked = np.zeros(n + 1, bool)
        self.small = np.arange(n)
        self.shared = int(sizes[sizes > 1].sum())
        self.due: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self._expect(self.order)

    def _link(self, members: np.ndarray, starts: np.ndarray) -> None:
        """Links members of one class after the other; classes begin at `starts`."""
        after, before = np.append(members[1:], self.n), np.concatenate([[self.n], members[:-1]])
        before[starts] = self.n
        after[starts[1:] - 1] = self.n
        self.next[members], self.prev[members] = after, before

    def _expect(self, positions: np.ndarray) -> None:
        """Notes the lengths at which these positions would begin a square."""
        gaps = self.next[positions] - positions
        good = (self.next[positions] < self.n) & (gaps >= self.length) & (gaps <= self.reach[positions])
        if good.any():
            gaps, positions = gaps[good], positions[good]
            by = np.argsort(gaps, kind="stable")
            self.due[int(gaps[by[0]])].append((gaps[by], positions[by]))

    def squares(self) -> np.ndarray:
        """Positions, ascending, at which a square of the present length begins."""
        found = []
        for gaps, positions in self.due.pop(self.length, ()):
            stop = int(np.searchsorted(gaps, self.length, side="right"))
            found.append(positions[:stop])
            if stop < len(gaps):
                self.due[int(gaps[stop])].append((gaps[stop:], positions[stop:]))
        if not found:
            return np.empty(0, np.int64)
        at = np.unique(np.concatenate(found))
        return at[self.next[at] - at == self.length]

    def refine(self) -> None:
        """From factors of the present length to those of one more word."""
        self.length += 1
        before = np.sort(self.small[self.small > 0]) - 1
        before = before[self.size[self.cls[before]] > 1]
        self.small = np.empty(0, np.int64)
        if not len(before):
            return
        key = self.cls[before] * self.n + self.cls[before + 1]
        by = np.argsort(key, kind="stable")
        key, before = key[by], before[by]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lengths = np.diff(np.append(starts, len(key)))
        owners = self.cls[before[starts]]
        # Groups of one class lie together; what the groups leave over is one more part of it.
        firsts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        groups = np.diff(np.append(firsts, len(owners)))
        parted = owners[firsts]
        rest = self.size[parted] - np.add.reduceat(lengths, firsts)
        most = np.maximum.reduceat(lengths, firsts)
        # The first of the longest groups.
        longest = np.flatnonzero(lengths == np.repeat(most, groups))
        longest = longest[np.unique(np.repeat(np.arange(len(firsts)), groups)[longest], return_index=True)[1]]
        moves = np.ones(len(lengths), bool)
        moves[longest[rest == 0]] = False
        lesser = np.ones(len(lengths), bool)
        lesser[longest[rest < most]] = False
        left_over = parted[(rest > 0) & (rest < most)]
        self.shared -= int(self.size[parted].sum()) - int(lengths[lengths > 1].sum()) - int(rest[rest > 1].sum())
        if moves.any():
            self._move(before[np.repeat(moves, lengths)], lengths[moves], owners[moves])
        self.small = np.concatenate([before[np.repeat(lesser, lengths)], self.order[_ranges(self.begin[left_over], self.size[left_over])]])

    def _move(self, movers: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> None:
        """Groups of movers, in order of owner, become classes of their own."""
        own = np.repeat(owners, lengths)
        self.marked[movers] = True
        # What is left in a class closes the gaps: of movers that follow each other, the first's predecessor meets the last's successor.
        by = np.lexsort((movers, own))
        sorted_movers = movers[by]
        heads = self.prev[sorted_movers[~self.marked[self.prev[sorted_movers]]]]
        tails = self.next[sorted_movers[~self.marked[self.next[sorted_movers]]]]
        self.next[heads], self.prev[tails] = tails, heads
        # Movers take the last places of their class's range; who stays there goes where movers were.
        firsts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        parted, leaving = owners[firsts], np.add.reduceat(lengths, firsts)
        self.size[parted] -= leaving
        edge = self.begin[parted] + self.size[parted]
        slots = _ranges(edge, leaving)
        occupants = self.order[slots]
        stays = occupants[~self.marked[occupants]]
        holes = self.place[movers]
        holes = holes[holes < np.repeat(edge, leaving)]
        self.order[holes], self.place[stays] = stays, holes
        self.order[slots], self.place[movers] = movers, slots
        new = self.classes + np.arange(len(lengths))
        starts = np.cumsum(lengths) - lengths
        self.classes += len(lengths)
        self.begin[new], self.size[new] = slots[starts], lengths
        self.cls[movers] = np.repeat(new, lengths)
        self._link(movers, starts)
        self.marked[movers] = False
        self._expect(np.concatenate([movers, heads[heads < self.n]]))


def runs_of(texts: list[list], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Per list of words its runs (start, length, period), by start, then period. least_exponent: 2 at least."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    numbers: dict = {}
    letters = np.empty(int((sizes + 1).sum()), np.int64)
    for words, start, size in zip(texts, starts.tolist(), sizes.tolist(), strict=True):
        letters[start : start + size] = [numbers.setdefault(w, len(numbers)) for w in words]
    letters[starts + sizes] = len(numbers) + np.arange(len(texts))
    longest = int(sizes.max(initial=0)) // least_exponent
    if not longest:
        return out
    partition = Partition(letters, np.repeat(np.where(sizes >= least_length, sizes // least_exponent, 0), sizes + 1))
    found = []
    while True:
        q, at = partition.length, partition.squares()
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            length = at[np.append(first[1:], len(at)) - 1] - at[first] + 2 * q
            good = length >= max(least_length, least_exponent * q)
            found.append(np.stack([at[first][good], length[good], np.full(int(good.sum()), q)], 1))
        if q >= longest or not partition.shared:
            break
        partition.refine()
    for start, length, q in np.concatenate(found).tolist() if found else ():
        text = int(np.searchsorted(starts, start, side="right")) - 1
        out[text].append((start - int(starts[text]), length, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, kept: list[str], text_col: str = "text", *more: Column, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """A row per document: the kept columns, `more`, n_words, runs (start, length, period in words), collapsed (the words left, joined by one space)."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def finder():
        def answer(texts: pa.Array) -> list[pa.Array]:
            words = [t.encode("utf-8", "surrogatepass").split() for t in _strings(texts)]
            runs = runs_of(words, least_length, least_exponent)
            left = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)]
            listed = [[{"start": a, "length": b, "period": q} for a, b, q in r] for r in runs]
            return [pa.array([len(w) for w in words], pa.int64()), pa.array(listed, pa.list_(run)), pa.array(left, pa.binary()).cast(pa.string())]

        return answer

    return per_text(docs, text_col, kept, finder, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string", more)


def _strings(texts: pa.Array) -> Iterator[str]:
    for t in texts:
        yield t.as_py()
