"""Secret scans: known patterns, and sliding-window Shannon entropy over candidate strings.

Known kinds are regular expressions with a least length. Candidates are unbroken strings of a character
class, such as hexadecimal digits or the letters of base 64, of at least a window's length. A window slides
over a candidate; the counts of its characters are kept by one increment and one decrement a step, and with
them the sum of c * log2(c) in fixed point, so the entropy is exact however long the string. Windows with
at least the class's entropy, that hold every group of characters that the class asks for, are joined to
spans. Spans that touch a match of the allow-list (ids, digests, links, data, placeholders) and spans inside
a known one are dropped; the allow-list takes nothing from the known kinds.

Texts are scanned where they lie, without a shuffle, and whole; the time is linear in the text. Null and
empty texts have no secrets; repeated rows and null ids pass row by row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .shared import per_text


@dataclass(frozen=True)
class Pattern:
    """A kind of secret: the group `group` of a match has `least` characters at least. A shorter match is consumed, but doesn't count."""

    kind: str
    pattern: str
    group: int
    least: int
    any_case: bool = False


@dataclass(frozen=True)
class CharacterClass:
    """Strings of `characters`, `window` at least, then at most `padding` signs "="; a window has `bits` of entropy at least and a character of each of `groups`."""

    characters: str
    window: int
    bits: float
    groups: tuple[str, ...]
    padding: int = 0


PATTERNS = (
    Pattern("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, any_case=True),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 18),
    Pattern("hex", r"[0-9a-f]+", 0, 16),
)
#: Random strings of 24 characters have 3.3 to 3.9 bits over hexadecimal digits and 4.1 to 4.6 over the letters of base 64; words run together have below 3.9 and no digits.
CLASSES = (
    CharacterClass("0-9A-Fa-f", 24, 3.05, ("0-9", "A-Fa-f")),
    CharacterClass("A-Za-z0-9+/_-", 24, 4.0, ("0-9", "A-Z", "a-z"), padding=2),
)
#: What looks random and is no secret: ids of versions and objects, digests with their name, links, data in line, placeholders.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"(?:sha1|sha224|sha256|sha384|sha512|md5|commit|checksum|integrity)[:= -]+[A-Za-z0-9+/_=-]+",
    r"https?://[^\x20\x09-\x0D]+",
    r";base64,[A-Za-z0-9+/_=-]+",
    r"[A-Za-z0-9+/_-]*(?:EXAMPLE|example|abcdefghij|ABCDEFGHIJ|0123456789|xxxxxx|XXXXXX)[A-Za-z0-9+/_=-]*",
)
ENTROPY = "entropy"
#: Fixed point of c * log2(c): sums are whole numbers, the same in any order.
UNIT = 1_000_000


def weights_of(window: int) -> list[int]:
    return [0, *(round(c * math.log2(c) * UNIT) for c in range(1, window + 1))]


def most_weight(window: int, bits: float) -> int:
    """The greatest sum of weights at which a window has so many bits: entropy is log2(window) - sum / window."""
    return math.floor(window * (math.log2(window) - bits) * UNIT)


def entropy_spans(text: str, own: CharacterClass, groups: Sequence[frozenset[str]], weights: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of a candidate covered by windows that pass."""
    window, counts, total, present = own.window, {}, 0, [0] * len(groups)
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        if i >= window:
            gone = text[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += weights[n - 1] - weights[n]
            for k, group in enumerate(groups):
                present[k] -= gone in group
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += weights[n + 1] - weights[n]
        for k, group in enumerate(groups):
            present[k] += c in group
        if i >= window - 1 and total <= most and all(present):
            a, b = i - window + 1, i + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = spans[-1][0], b
            else:
                spans.append((a, b))
    return spans


class Scanner:
    """All kinds over one text; made once a task."""

    def __init__(self, patterns: Sequence[Pattern], classes: Sequence[CharacterClass], allowed: Sequence[str]):
        self.patterns = [(p, re.compile(p.pattern, re.ASCII | (re.IGNORECASE if p.any_case else 0))) for p in patterns]
        self.kinds = {p.kind: i for i, p in enumerate(patterns)}
        self.kinds.setdefault(ENTROPY, len(self.kinds))
        self.classes = []
        for own in classes:
            candidate = re.compile(f"[{own.characters}]{{{own.window},}}={{0,{own.padding}}}")
            groups = [frozenset(c for c in map(chr, range(128)) if re.match(f"[{g}]", c)) for g in own.groups]
            self.classes.append((own, candidate, groups, weights_of(own.window), most_weight(own.window, own.bits)))
        self.allowed = [re.compile(a) for a in allowed]

    def known(self, text: str) -> list[tuple[int, int, str]]:
        return [(*m.span(), p.kind) for p, found in self.patterns for m in found.finditer(text) if len(m[p.group]) >= p.least]

    def random(self, text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Spans of high entropy, joined over classes, less those allowed and those inside a known one."""
        ranges = []
        for own, candidate, groups, weights, most in self.classes:
            for m in candidate.finditer(text):
                start = m.start()
                # Padding belongs to a span that reaches it.
                body = m[0].rstrip("=") if own.padding else m[0]
                for a, b in entropy_spans(body, own, groups, weights, most):
                    ranges.append((start + a, m.end() if b == len(body) else start + b))
        if not ranges:
            return []
        joined = _joined(ranges)
        joined = _apart(joined, _joined([m.span() for a in self.allowed for m in a.finditer(text)]))
        return [(a, b, ENTROPY) for a, b in _outside(joined, [(a, b) for a, b, _ in known])]

    def scan(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Known spans and all spans (start, stop, kind), by start, then kind as listed."""
        known = self.known(text)
        by = lambda s: (s[0], self.kinds[s[2]], s[1])
        return sorted(known, key=by), sorted(known + self.random(text, known), key=by)


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _apart(ranges: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that share no place with others; both joined and in order."""
    out, i = [], 0
    for a, b in ranges:
        while i < len(others) and others[i][1] <= a:
            i += 1
        if i == len(others) or others[i][0] >= b:
            out.append((a, b))
    return out


def _outside(ranges: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges, joined and in order, that lie wholly in none of others."""
    out, reach, i = [], -1, 0
    others = sorted(others)
    for a, b in ranges:
        while i < len(others) and others[i][0] <= a:
            reach, i = max(reach, others[i][1]), i + 1
        if reach < b:
            out.append((a, b))
    return out


def scan_secrets(docs: DataFrame, kept: list[str], text_col: str = "text", *more: Column, patterns: Sequence[Pattern] = PATTERNS, classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """A row per document: the kept columns, `more`, known and spans: arrays of (start, stop, kind) in code points, stop exclusive, by start, then kind as listed."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))

    def scanner():
        own = Scanner(patterns, classes, allowed)

        def answer(texts: pa.Array) -> list[pa.Array]:
            found = [own.scan(t.as_py()) for t in texts]
            return [pa.array([[{"start": a, "stop": b, "kind": k} for a, b, k in f[i]] for f in found], span) for i in (0, 1)]

        return answer

    shape = "array<struct<start: long, stop: long, kind: string>>"
    return per_text(docs, text_col, kept, scanner, f"known {shape}, spans {shape}", more)
