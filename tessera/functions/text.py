"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Token patterns by name, marks of a broken text layer, thresholds of the page router, white space.
TOKEN_PATTERNS = {"split": r"[\p{L}\p{N}_]+", "keep": r"[\p{L}\p{N}_]+(?:[.,/:\-][\p{L}\p{N}_]+)*"}
MISREAD_LETTERS = "ðþýÐÞÝ"
MISREAD_PAIRS = r"â€.|Ã[\x{80}-\x{ff}]"
LOST_GLYPH = r"\(cid:\d+\)"
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^\s\x{85}\x{1c}-\x{1f}\x{ad}\x{200b}\x{200c}\x{200d}\x{feff}]]"
LEAST_CHARS, MISREAD_SHARE, GARBAGE_SHARE, IMAGE_SHARE, IMAGE_CHARS = 120, 0.001, 0.005, 0.75, 600
REFUSAL = "[YANITLANAMADI]"
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
IMAGE_SUFFIXES = ("png", "jpg", "jpeg")
#: Texts of these signs alone are their own compatibility composition: ASCII, Latin letters and signs without one, Cyrillic.
COMPOSED = r"^[\x00-\x7f¡-§©«¬®°±¶»¿À-ÖØ-öø-ıĴ-ľŁ-ňŊ-žƒЀ-џ–—‘’‚“”„€]*$"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def is_composed(text: Column) -> Column:
    """Is it of signs alone of which any text is its own NFKC? ASCII is taken out first, as it is most of a text."""
    return F.regexp_replace(text, r"[\x00-\x7f]+", "").rlike(COMPOSED)


def composed(text: Column) -> Column:
    """NFKC. Only texts that hold a sign it may change leave the JVM; the others go as nulls."""
    return F.coalesce(nfkc(F.when(~is_composed(text), text)), text)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(text: Column) -> Column:
    """White space collapsed to one space, ends stripped."""
    # A single plain space stays as it is, and only such are left at the ends.
    return F.trim(F.regexp_replace(text, f"[{SPACE}&&[^ ]]{SPACE}*| {SPACE}+", " "))


def normalize(text: Column, compose: bool = True) -> Column:
    """NFKC, line-end hyphens joined, white space collapsed, ends stripped. compose=False where the text is composed already."""
    return collapsed(F.regexp_replace(composed(text) if compose else text, rf"-{SPACE}*\n{SPACE}*", ""))


def tokens(text: Column, pattern: str = "keep", compose: bool = True, between: str = "") -> Column:
    """Lower-case tokens of the composed text; the dot that lower-casing a dotted capital I leaves is dropped. between: signs, no part of any token, each of which is told in its place too."""
    lowered = F.replace(F.lower(composed(text) if compose else text), F.lit("̇"), F.lit(""))
    return F.regexp_extract_all(lowered, F.lit(TOKEN_PATTERNS[pattern] + (f"|[{between}]" if between else "")), F.lit(0))


def without_thinking(answer: Column) -> Column:
    return stripped(F.regexp_replace(answer, r"(?is)<think>.*?</think>", ""))


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("s."), first)).otherwise(F.concat(F.lit("s."), first, F.lit("-"), last))


def canonical(text: Column, compose: bool = True) -> Column:
    """For comparing answers with quotes: composed, lower case, decimal commas as points, white space collapsed."""
    return collapsed(F.regexp_replace(F.lower(composed(text) if compose else text), r"(?<=\d)[.,](?=\d)", "."))


def numbers(text: Column, compose: bool = True) -> Column:
    """Distinct numbers of a text, decimal comma read as a point."""
    lowered = F.lower(composed(text) if compose else text)
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(lowered, r"(?<=\d)[.,](?=\d)", "."), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))


def turkish_share(text: Column) -> Column:
    """Share of letters that only Turkish writes; 0 for an empty text."""
    return (F.length(text) - F.length(F.translate(text, TURKISH_LETTERS, ""))) / F.greatest(F.length(text), F.lit(1))


def occurrences(text: Column, part: Column) -> Column:
    """How often `part` occurs without overlap; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def error_rate(found: Column, reference: Column) -> Column:
    """Character error rate."""
    return F.levenshtein(found, reference) / F.greatest(F.length(reference), F.lit(1))


def base_name(path: Column) -> Column:
    """Last part of a path, whichever way its slashes lean."""
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def stem(path: Column) -> Column:
    """Last part of a path without its last suffix."""
    name = base_name(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$")


def slug(model: Column) -> Column:
    """A model's name as the name of a folder."""
    return F.replace(model, F.lit("/"), F.lit("__"))


def preview(text: Column, chars: int = 300) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("…"))).otherwise(text)
