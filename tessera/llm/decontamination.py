"""Benchmark decontamination: words of documents inside any window of a test item's text.

Texts are normalised byte for byte (A-Z to lower case, other ASCII signs to spaces), so offsets in the
normalised text are offsets in the original. A window is `window` consecutive words of an item, or the
whole of a shorter item. One Aho-Corasick automaton holds anchors: the item's words taken `window // 2`
at a time without overlap, one of which lies whole inside every window, and short items whole. The
text is scanned once; where an anchor occurs, the match is extended word by word on both sides, and
counts if it spans a window.

The automaton is built from at most ITEM_BYTES of item text; a larger benchmark is dealt to several
automata, applied one after the other with their findings merged, so no broadcast grows with it.
Documents are scanned where they lie, without a shuffle.

Null, empty and signs-only texts have no words; items without words have no windows; items of one id
count once; words of an item without an id are hit like any others, but the item is neither listed nor
counted; item ids of any type are listed as text; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, in_arrow, named, struct

WINDOW = 10
ITEM_BYTES = 4 << 20

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(text: str | None) -> bytes:
    """Same length as the text's UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)


class Windows:
    """The windows of some items, and where they occur in a text."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, self.items = window, []
        anchors: dict[str, list[tuple[int, int]]] = {}
        size = max(1, window // 2)
        for item_id, text in items:
            words = normalise(text).split()
            if not words:
                continue
            place = len(self.items)
            self.items.append((item_id, words))
            parts = [(0, words)] if len(words) < window else [(j, words[j : j + size]) for j in range(0, len(words) - size + 1, size)]
            for j, part in parts:
                anchors.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), []).append((place, j))
        self.automaton = ahocorasick.Automaton()
        for anchor, places in anchors.items():
            self.automaton.add_word(anchor, (len(anchor), places))
        if anchors:
            self.automaton.make_automaton()
        self.empty = not anchors

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of words hit, merged and in order, and the ids of the items that have one."""
        if self.empty or not words:
            return [], set()
        text = b" " + b" ".join(words) + b" "
        spaces, runs, found, reached = None, [], set(), {}
        for end, (length, places) in self.automaton.iter(text.decode("latin-1")):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            i = int(np.searchsorted(spaces, end - length + 1))
            for place, j in places:
                item_id, own = self.items[place]
                line = place, i - j
                if reached.get(line, -1) > i:
                    continue  # inside a run that is known already
                a, b = i, i
                while a and a - (i - j) > 0 and words[a - 1] == own[a - 1 - (i - j)]:
                    a -= 1
                while b < len(words) and b - (i - j) < len(own) and words[b] == own[b - (i - j)]:
                    b += 1
                reached[line] = b
                if b - a >= min(self.window, len(own)):
                    runs.append((a, b))
                    if item_id is not None:
                        found.add(item_id)
        return _merged(runs), found


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of the original text for ranges of words."""
    raw = normalise(text)
    marks = np.frombuffer(b" " + raw + b" ", np.uint8) != 32
    edges = np.flatnonzero(np.diff(marks.astype(np.int8)))  # start, end, start, end ... in bytes
    data = text.encode("utf-8", "surrogatepass")
    chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) if data else np.zeros(0, int)
    return [(int(chars[edges[2 * a]]) - 1, int(chars[edges[2 * b - 1] - 1])) for a, b in runs]


def blocks_of_items(benchmark: DataFrame, item_col: str, text_col: str, item_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The different items, dealt so that a block holds about `item_bytes` of text; one block is on the driver at a time."""
    rows = benchmark.select(named(item_col).cast("string").alias("item"), named(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + int(total) // item_bytes
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, kept: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """A row per document: the kept columns, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (character ranges of the original text)."""
    blocks = blocks_of_items(benchmark, item_col, item_text_col, item_bytes)
    block, scratch = next(blocks), Scratch(docs.sparkSession)
    rows, place, number = docs, text_col, 0
    while (later := next(blocks, None)) is not None:
        # Columns by number: names of documents may be any.
        rows = rows if number else docs.select(*(named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
        place = f"c{docs.columns.index(text_col)}"
        own = [f"c{i}" for i in range(len(docs.columns))]
        rows = scratch.save(_scanned(rows, own, place, block, window, number > 0, last=False), "scanned")
        block, number = later, number + 1
    if not number:
        return _scanned(rows, kept, place, block, window, False, last=True)
    out = _scanned(rows, [f"c{docs.columns.index(c)}" for c in kept], place, block, window, True, last=True)
    return out.toDF(*kept, *out.columns[len(kept) :])


def _scanned(rows: DataFrame, kept: list[str], text_col: str, items: list[tuple[str | None, str]], window: int, again: bool, last: bool) -> DataFrame:
    """again: rows bring the runs and items of the blocks before, in columns runs and items."""
    before = [F.col("runs"), F.col("items")] if again else [F.array().cast("array<int>").alias("runs"), F.array().cast("array<string>").alias("items")]
    numbers = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: long, stop: long>>"
    schema = struct([rows.schema[c] for c in kept], numbers if last else "runs array<int>, items array<string>")
    with_text = [c == text_col and rows.schema[c].dataType.typeName() == "string" for c in kept]
    sent = rows.select(*before, named(text_col).cast("string").alias("text"), *(named(c) for c, own in zip(kept, with_text, strict=True) if not own))
    ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Windows(items, window)
        for batch in batches:
            runs, found, counts, spans = [], [], [], []
            for flat, earlier, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                flat, earlier, text = flat.as_py(), earlier.as_py(), text.as_py()
                words = normalise(text).split()
                new, ids = known.find(words)
                merged = _merged([*new, *zip(flat[::2], flat[1::2], strict=True)]) if flat else new
                runs.append(merged)
                found.append(sorted({*earlier, *ids}))
                counts.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in spans_of(text, merged)] if last and merged else [])
            rest = iter(batch.columns[3:])
            columns = [batch.column(2) if own else next(rest) for own in with_text]
            if last:
                hit = [sum(b - a for a, b in r) for r in runs]
                columns += [pa.array(c, pa.int64()) for c in (counts, hit, [len(f) for f in found])]
                columns.append(pa.array([hashlib.sha256(",".join(f).encode("utf-8", "surrogatepass")).hexdigest() for f in found], pa.string()))
                columns += [pa.array([h > 0 for h in hit], pa.bool_()), pa.array(found, strings), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
            else:
                columns += [pa.array([[x for r in rs for x in r] for rs in runs], ints), pa.array(found, strings)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_arrow(sent, scan, schema)
