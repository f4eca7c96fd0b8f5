"""Library tokenizers applied piecewise: whole texts are cut where no token can span, and each
distinct piece is encoded once by the library.

Safe boundaries depend on the vocabulary file:

* byte-level pre-tokenizer with its own pattern, no normalizer: before a single space, and before a
  single line feed, that stands between two non-space characters (a token starts there whatever
  surrounds it, and none spans the line feed and what follows it);
* a splitting pre-tokenizer that drops white space: at any space or line feed;
* any other file, and sentencepiece models: whole texts only.

Texts are split and their pieces numbered by Arrow; Python sees a slice's distinct pieces only. New
pieces go to the library many to a string and are told apart by the ids that begin a piece, or by a
separating word of one id. Ids of a slice are then gathered from those of its pieces in one step.

Added tokens are matched by the library inside a piece exactly as inside the text, because files
whose added tokens hold a space, or strip around themselves, are not cut at all.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces that one call of the library gets, and pieces that one string of it holds.
BATCH_BYTES, JOINED = 1 << 20, 200
#: Distinct pieces, and ids of pieces, that a worker remembers before it forgets those that only one slice had; bounds its memory, not the result.
MEMORY_PIECES, MEMORY_IDS = 300_000, 4 << 20
#: Longest run of characters that is taken apart at once.
RUN_CHARS = 1 << 20
#: Separates pieces whose ids don't show where a piece begins.
_BETWEEN = "~"
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Answers that every memory begins with: nothing, and the end of a document.
_NOTHING, _END = 0, 1
_open: dict[tuple[str, bool], PieceCodec] = {}


def codec(path: str, with_ids: bool) -> PieceCodec:
    """One per worker process and kind of answer."""
    if (path, with_ids) not in _open:
        _open[path, with_ids] = PieceCodec(path, with_ids)
    return _open[path, with_ids]


class Memory:
    """Answers by number: how many ids, and where they lie in one array. Names of those to be found again are in `inner` and `first`."""

    def __init__(self, with_ids: bool, nothing: int):
        """nothing: the answer to nothing between two boundaries."""
        self.with_ids, self.nothing = with_ids, nothing
        self.inner: dict[str, int] = {"": nothing}
        self.first: dict[str, int] = {"": _NOTHING}
        self.n = 0
        self.lengths, self.starts, self.slices = (np.zeros(1 << 12, np.int32) for _ in range(3))
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0
        self.add(np.array([0, 1]), np.zeros(1, np.uint32))

    def add(self, lengths: np.ndarray, ids: np.ndarray) -> int:
        """Number of the first of the new answers."""
        first, end = self.n, self.n + len(lengths)
        while end > len(self.lengths):
            self.lengths, self.starts, self.slices = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.starts, self.slices))
        self.lengths[first:end] = lengths
        self.n = end
        if self.with_ids:
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[first:end] = self.used + np.cumsum(lengths) - lengths
            self.used += len(ids)
        return first

    def full(self) -> bool:
        return self.n > MEMORY_PIECES or self.used > MEMORY_IDS

    def trimmed(self) -> Memory:
        """What several slices had, if that is no more than half of the room."""
        out = Memory(self.with_ids, self.nothing)
        often = 2 + np.flatnonzero(self.slices[2 : self.n] > 1)
        lengths = self.lengths[often].astype(np.int64)
        if len(often) > MEMORY_PIECES // 2 or lengths.sum() > MEMORY_IDS // 2:
            return out
        ids = self.ids[np.repeat(self.starts[often] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())] if self.with_ids else self.ids[:0]
        place = np.full(self.n, -1)
        place[often] = out.add(lengths, ids) + np.arange(len(often))
        places = place.tolist()
        for own, names in ((out.inner, self.inner), (out.first, self.first)):
            own.update((name, places[i]) for name, i in names.items() if i > 1 and places[i] > 0)
        return out


class PieceCodec:
    """Answers for whole texts: numbers of ids, and with_ids the ids themselves."""

    def __init__(self, path: str, with_ids: bool):
        self.with_ids = with_ids
        self.rule = "whole"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._library = lambda batch: model.encode(batch, num_threads=1)
        else:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            # A task has one core; the library's own threads would take others, and double its CPU time on short pieces.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._library = lambda batch: [e.ids for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
            self.rule = _rule(spec)
            if self.rule == "before space":
                # Byte-level vocabularies write a space as U+0120 and a line feed as U+010A.
                self._opens = np.zeros(1 + max(tokenizer.get_vocab().values()), bool)
                self._opens[[i for token, i in tokenizer.get_vocab().items() if token[0] in "ĠĊ"]] = True
            elif self.rule == "drop space":
                between = self._library([_BETWEEN])[0]
                self._between = between[0] if len(between) == 1 else None
        # Two spaces in a row: no boundary where spaces belong to tokens, nothing at all where they are dropped.
        self.memory = Memory(with_ids, -1 if self.rule == "before space" else _NOTHING)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each, through the library in batches of about BATCH_BYTES."""
        start, size = 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text) > BATCH_BYTES:
                yield from (np.asarray(ids, np.uint32) for ids in self._library(texts[start:i]))
                start, size = i, 0
            size += len(text) + 16
        if start < len(texts):
            yield from (np.asarray(ids, np.uint32) for ids in self._library(texts[start:]))

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of pieces, many to a call's string."""
        glue = "" if self.rule == "before space" else f" {_BETWEEN} "
        groups = [pieces[a : a + JOINED] for a in range(0, len(pieces), JOINED)]
        lengths, ids = [], []
        for group, found in zip(groups, self._encode([glue.join(g) for g in groups]), strict=True):
            if glue:
                marks = np.flatnonzero(found == self._between)
                counts = np.diff(marks, prepend=-1, append=len(found)) - 1
                found = np.delete(found, marks)
            else:
                counts = np.diff(np.flatnonzero(self._opens[found]), append=len(found))
            if len(counts) != len(group) or counts.sum() != len(found):
                each = list(self._encode(group))
                counts, found = np.array([len(x) for x in each]), np.concatenate(each)
            lengths.append(counts)
            ids.append(found)
        return np.concatenate(lengths), np.concatenate(ids)

    def _learn(self, pieces: list[str], names: dict[str, int], written: list[str]) -> None:
        """Answers for new pieces; `written` as the library gets them."""
        if not pieces:
            return
        if names is self.memory.first or (self.rule == "drop space" and self._between is None):
            each = list(self._encode(written))
            lengths, ids = np.array([len(x) for x in each]), np.concatenate(each)
        else:
            lengths, ids = self._joined(written)
        start = self.memory.add(lengths, ids)
        names.update(zip(pieces, range(start, start + len(pieces)), strict=True))

    def _inner(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the answers to pieces behind a safe boundary; -1 marks one that isn't safe."""
        names = self.memory.inner
        new = [p for p in pieces if p not in names]
        if self.rule == "drop space":
            odd = [p for p in new if _BETWEEN in p]
            if odd:
                each = list(self._encode(odd))
                start = self.memory.add(np.array([len(x) for x in each]), np.concatenate(each))
                names.update(zip(odd, range(start, start + len(odd)), strict=True))
                new = [p for p in new if _BETWEEN not in p]
            self._learn(new, names, new)
        else:
            # White space at an end, but for the line feed of a boundary, or nothing at all marks a boundary that isn't safe.
            odd = {p for p in new if p[-1].isspace() or (p[0].isspace() and (p[0] != "\n" or p[1].isspace()))}
            names.update(dict.fromkeys(odd, -1))
            new = [p for p in new if p not in odd] if odd else new
            self._learn(new, names, [p if p[0] == "\n" else " " + p for p in new])
        return np.fromiter(map(names.__getitem__, pieces), np.int64, len(pieces))

    def _heads(self, heads: list[str]) -> np.ndarray:
        """Numbers of the answers to what stands before the first safe boundary."""
        names = self.memory.first
        odd = {h for h in heads if h and h[-1].isspace()}
        new = list({h for h in heads if h not in names and h not in odd})
        self._learn(new, names, new)
        return np.fromiter((-1 if h in odd else names[h] for h in heads), np.int64, len(heads))

    def answers(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids a text, and with_ids all texts' ids one after the other; end_id follows every text. Null counts as empty."""
        if self.memory.full():
            self.memory = self.memory.trimmed()
        self.memory.ids[0] = end_id or 0
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32) if self.with_ids else None
        runs, inner, each = texts, np.zeros(len(texts), bool), np.ones(len(texts), np.int64)
        if self.rule != "whole" and pc.max(pc.utf8_length(texts)).as_py() > RUN_CHARS:
            cut = [list(self._runs(t)) for t in texts.to_pylist()]
            runs, each = pa.array([r for c in cut for r in c], pa.string()), np.array([len(c) for c in cut])
            inner = np.array([i > 0 for c in cut for i in range(len(c))])
        numbers, owner = self._numbers(runs, inner)
        owner = np.repeat(np.arange(len(texts)), each)[owner]
        if end_id is not None:
            ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
            numbers, owner = np.insert(numbers, ends, _END), np.insert(owner, ends, np.arange(len(texts)))
        lengths = self.memory.lengths[numbers].astype(np.int64)
        counts = np.bincount(owner, lengths, len(texts)).astype(np.int64)
        if not self.with_ids:
            return counts, None
        shift = self.memory.starts[numbers] - (np.cumsum(lengths) - lengths)
        return counts, self.memory.ids[np.repeat(shift, lengths) + np.arange(lengths.sum())]

    def _numbers(self, runs: pa.Array, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of answers whose ids make up the runs, and the run of each. inner: runs that begin with the space of a safe boundary."""
        if self.rule == "whole":
            each = list(self._encode(runs.to_pylist()))
            start = self.memory.add(np.array([len(x) for x in each]), np.concatenate(each))
            return np.arange(start, start + len(each)), np.arange(len(each))
        marked = pc.replace_substring(runs, "\n", " \n" if self.rule == "before space" else " ")
        split = pc.split_pattern(marked, " ")
        edges = split.offsets.to_numpy().astype(np.int64)
        pieces = split.flatten().dictionary_encode()
        codes = pieces.indices.to_numpy()
        owner = np.repeat(np.arange(len(runs)), np.diff(edges))
        known = pieces.dictionary.to_pylist()
        numbers = self._inner(known)
        self.memory.slices[numbers[numbers > 1]] += 1
        numbers = numbers[codes]
        if self.rule == "drop space":
            return numbers, owner
        heads = [known[c] for c in codes[edges[:-1]]]
        numbers[edges[:-1]] = self._heads(heads)
        # A text that begins with a space, unless at a boundary, or with a line feed has no head.
        headless = np.array([h == "" for h in heads]) & ~inner & (np.diff(edges) > 1)
        bad = (np.minimum.reduceat(numbers, edges[:-1]) < 0) | headless
        if bad.any():
            at = np.flatnonzero(bad)
            cut = [_INNER_SPACE.split(runs[i].as_py()) for i in at.tolist()]
            whole = [list(self._encode([f" {p}" if j else p for j, p in enumerate(c)])) for c in cut]
            start = self.memory.add(np.array([sum(map(len, w)) for w in whole]), np.concatenate([x for w in whole for x in w]))
            numbers, owner = np.concatenate([numbers[~bad[owner]], np.arange(start, start + len(at))]), np.concatenate([owner[~bad[owner]], at])
            order = np.argsort(owner, kind="stable")
            numbers, owner = numbers[order], owner[order]
        return numbers, owner

    def _runs(self, text: str) -> Iterator[str]:
        """A long text cut at safe boundaries into runs of about RUN_CHARS; the space at a cut belongs to the next run."""
        start = 0
        while len(text) - start > RUN_CHARS:
            cut = start + RUN_CHARS
            if self.rule == "before space":
                m = _INNER_SPACE.search(text, cut)
                cut = m.start() if m else len(text)
            else:
                at = text.find(" ", cut)
                cut = at if at >= 0 else len(text)
            yield text[start:cut]
            start = cut
        yield text[start:]


def _rule(spec: dict) -> str:
    added = spec.get("added_tokens") or []
    if any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        return "whole"
    pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not normalizer:
        return "before space"
    steps = pre.get("pretokenizers") or []
    kinds = [n["type"] for n in (normalizer or {}).get("normalizers", [])]
    if steps and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and set(kinds) <= {"NFC", "Replace", "Lowercase"}:
        return "drop space"
    return "whole"
