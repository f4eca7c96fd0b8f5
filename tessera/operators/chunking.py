"""Overlapping chunks of whole documents along sentences, with the pages they span.

Pages are stitched to one text; built-in expressions cut it into sentences and measure them. Where a
chunk ends depends on every chunk before it, so one Arrow function per document finds the boundaries,
on lengths alone: running sums and a search for the place where the next chunk is full. Texts stay in
the JVM, which joins the sentences of each chunk; so the work is linear in a text. A document is one row; there is no shuffle but the one that
brings a document's pages together.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.functions import text as T
from tessera.sources.shared import small_batches

# Characters of a chunk, its hard limit, its overlap, and the shortest remainder of its own; where sentences part.
TARGET, LIMIT, OVERLAP, REMAINDER = 800, 1600, 150, 200
SENTENCE_GAP = r"(?<=[.!?…])\s+(?=[A-ZÇĞİÖŞÜ0-9(])"


def wrapped(words: np.ndarray, width: int = TARGET) -> list[tuple[int, int, int]]:
    """Lines that words of these lengths fill, each word with the space behind it, as (first word, words, length); a line takes one word at least."""
    ends = np.concatenate([[0], np.cumsum(words + 1)])
    lines, at = [], 0
    while at < len(words):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + width, side="right")) - 1)
        lines.append((at, stop - at, int(ends[stop] - ends[at]) - 1))
        at = stop
    return lines


def wrap(words: np.ndarray, width: int = TARGET) -> list[int]:
    """Lengths of the lines."""
    return [length for _, _, length in wrapped(words, width)]


def chunk_ranges(sizes: np.ndarray, target: int = TARGET, overlap: int = OVERLAP, limit: int = LIMIT) -> tuple[list[tuple[int, int]], int]:
    """Ranges of pieces of these lengths that make full chunks, and where the remainder begins."""
    return filled(np.concatenate([[0], np.cumsum(sizes + 1)]).tolist(), target, overlap, limit)


def filled(reach: list[int], target: int, overlap: int, limit: int) -> tuple[list[tuple[int, int]], int]:
    """Ranges of pieces that make full chunks, and where the remainder begins. reach: where pieces begin, and where one behind the last would.

    A piece weighs its length and one. A chunk is full with the piece that brings it to `target`; if that piece
    would bring it beyond `limit`, the chunk ends before it. The next chunk begins with the shortest run of
    pieces at the end of this one that weighs `overlap`, unless that is all of it.
    """

    def behind(a: int, b: int) -> int:
        t = bisect_right(reach, reach[b] - overlap, 0, b + 1) - 1
        return t if t > a else b

    found: list[tuple[int, int]] = []
    a = b = 0
    while b < len(reach) - 1:
        filling = max(bisect_left(reach, reach[a] + target, a) - 1, b)
        if filling >= len(reach) - 1:
            break
        if filling > a and reach[filling + 1] - 1 - reach[a] > limit:
            found.append((a, filling))
            a = behind(a, filling)
        b = filling + 1
        if reach[b] - reach[a] >= target:
            found.append((a, b))
            a = behind(a, b)
    return found, a


def wrapped_words(starts: list[int], sentences: list[int], target: int) -> list[int]:
    """The words at which a text's pieces begin: its sentences, those longer than `target` wrapped word by word; the number of words comes last.

    starts: where words begin, and where one behind the last would; one sign stands between two. sentences: their first words, and the number of words."""
    begins = []
    for first, stop in pairwise(sentences):
        begins.append(first)
        if starts[stop] - starts[first] - 1 > target:
            at = max(first + 1, bisect_right(starts, starts[first] + target, first, stop + 1) - 1)
            while at < stop:
                begins.append(at)
                at = max(at + 1, bisect_right(starts, starts[at] + target, at, stop + 1) - 1)
    return [*begins, sentences[-1]]


def ranges_of_words(starts: list[int], sentences: list[int], settings: Sequence[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], tuple[int, int]]]:
    """For every setting (target, overlap) the ranges of words that are a text's chunks, and that of a short remainder which joins the last, else (0, 0). Arguments as of wrapped_words."""
    pieces = {t: wrapped_words(starts, sentences, t) for t in {t for t, _ in settings}}
    reaches = {t: [starts[w] for w in own] for t, own in pieces.items()}
    for target, overlap in settings:
        own, reach = pieces[target], reaches[target]
        found, rest = filled(reach, target, overlap, 2 * target)
        last, joins = len(reach) - 1, (0, 0)
        if rest < last:
            if found and reach[last] - reach[rest] - 1 < REMAINDER:
                joins = own[rest], own[last]
            else:
                found.append((rest, last))
        yield [(own[a], own[b]) for a, b in found], joins


def _wholes(words: list[np.ndarray]) -> list[int]:
    """Lengths of sentences."""
    return [int(w[0]) if len(w) == 1 else int(np.sum(w)) + len(w) - 1 for w in words]


def _lines_of(words: list[np.ndarray], target: int = TARGET, whole: list[int] | None = None) -> list[list[tuple[int, int, int]]]:
    """Per sentence its lines; words: lengths of the words of each sentence, or one length for a short one; whole: _wholes of them, if known."""
    whole = _wholes(words) if whole is None else whole
    return [[(0, 1, n)] if n <= target or len(w) == 1 else wrapped(np.asarray(w, np.int64), target) for w, n in zip(words, whole, strict=True)]


def places(lines: list[list[tuple[int, int, int]]], gaps: np.ndarray | None, starts: np.ndarray, target: int = TARGET, overlap: int = OVERLAP, limit: int = LIMIT) -> list[dict]:
    """Chunks of a text. lines: of its sentences; gaps between sentences, where they aren't all 1; starts: of its pages.

    first and n are a chunk's pieces, rest and n_rest those of a short remainder that joins it; page_start, page_full and
    page_end are numbers, from 1, of the pages on which it begins, ends, and ends with its remainder.
    """
    n = np.array([length for own in lines for _, _, length in own], np.int64)
    if not len(n) or not n.any():
        return []
    behind = np.ones(len(n), np.int64)
    if gaps is not None:
        behind[np.cumsum([len(own) for own in lines])[:-1] - 1] = gaps
    at = np.cumsum(n + behind) - n - behind
    page = lambda place: int(np.searchsorted(starts, place, side="right"))
    ranges, rest = chunk_ranges(n, target, overlap, limit)
    out = []
    for a, b in ranges:
        end = page(at[b - 1] + n[b - 1] - 1)
        out.append({"first": a, "n": b - a, "rest": 0, "n_rest": 0, "page_start": page(at[a]), "page_full": end, "page_end": end})
    if rest < len(n):
        if out and int((n[rest:] + 1).sum()) - 1 < REMAINDER:
            out[-1] |= {"rest": rest, "n_rest": len(n) - rest, "page_end": page(at[-1])}
        else:
            end = page(at[-1] + n[-1] - 1)
            out.append({"first": rest, "n": len(n) - rest, "rest": 0, "n_rest": 0, "page_start": page(at[rest]), "page_full": end, "page_end": end})
    return out


def _whole(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, IntegerType()) for n in names]))


_LINES = ArrayType(_whole("first", "n"))
_CHUNKS = _whole("first", "n", "rest", "n_rest", "page_start", "page_full", "page_end")


def _told(lines: list[list[tuple[int, int, int]]]) -> list[list[dict]]:
    """What the JVM needs to cut lines out: nothing for a sentence of one."""
    return [[] if len(own) == 1 else [{"first": a, "n": k} for a, k, _ in own] for own in lines]


@F.pandas_udf(StructType([StructField("lines", _LINES), StructField("chunks", _CHUNKS)]))
def _places(words: pd.Series, gaps: pd.Series, starts: pd.Series) -> pd.DataFrame:
    found = []
    for w, g, at in zip(words, gaps, starts, strict=True):
        lines = [] if w is None else _lines_of(list(w))
        found.append((_told(lines), places(lines, g, at) if lines else []))
    return pd.DataFrame(found, columns=["lines", "chunks"])


@F.pandas_udf(_LINES)
def _line_places(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else _told(_lines_of(list(w))))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_GAP)


def _lengths(parts: Column, target: int = TARGET) -> Column:
    """Per sentence its length, or those of its words if it is longer than a chunk."""
    return F.transform(parts, lambda s: F.when(F.length(s) <= target, F.array(F.length(s))).otherwise(F.transform(F.split(s, " "), lambda w: F.length(w))))


def _pieces(parts: Column, lines: Column) -> Column:
    """Sentences, the long ones cut into their lines."""

    def cut(sentence: Column, i: Column) -> Column:
        # The words are split once for all lines.
        by_lines = F.transform(F.array(F.split(sentence, " ")), lambda words: F.transform(lines[i], lambda x: F.array_join(F.slice(words, x["first"] + 1, x["n"]), " ")))
        return F.when(F.size(lines[i]) == 0, F.array(sentence)).otherwise(by_lines[0])

    return F.flatten(F.transform(parts, cut))


def sentence_lines(rows: DataFrame, text_col: str, name: str = "lines") -> DataFrame:
    """The rows with their sentences, those of over TARGET characters wrapped word by word into lines."""
    small_batches(rows.sparkSession)
    held = rows.withColumn("_parts", sentences(F.col(text_col)))
    return held.withColumn("_at", _line_places(_lengths(F.col("_parts")))).withColumn(name, _pieces(F.col("_parts"), F.col("_at"))).drop("_parts", "_at")


def page_offsets(pages: DataFrame, doc: str = "doc", page: str = "page_no", text_col: str = "text") -> DataFrame:
    """The pages with `start`, their place in the stitched text: one space stands between two pages."""
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length(text_col) + 1).over(before), F.lit(0)).cast("int"))


def stitch(pages: DataFrame, doc: str = "doc", page: str = "page_no", text_col: str = "text", method: str = "method") -> DataFrame:
    """A row per document: doc, body, starts and methods of its pages in order."""
    ordered = page_offsets(pages.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))), doc, page, text_col)
    held = F.array_sort(F.collect_list(F.struct(F.col(page).alias("no"), F.col("start").alias("start"), F.col(text_col).alias("text"), F.col(method).alias("method"))))
    rows = ordered.groupBy(doc).agg(held.alias("held"))
    return rows.select(doc, F.array_join("held.text", " ").alias("body"), F.col("held.start").alias("starts"), F.col("held.method").alias("methods"))


def page_of_offsets(offsets: DataFrame, pages: DataFrame, doc: str = "doc", page: str = "page_no", offset: str = "offset") -> DataFrame:
    """As-of join: the offsets with the page that begins last at or before them. pages: rows (doc, page, start)."""
    # Both sides in one order, pages first where they begin at the offset: the last page seen is the one.
    both = offsets.select(doc, F.col(offset).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(pages.schema[page].dataType).alias("page_no")).unionByName(pages.select(doc, F.col("start").alias("_at"), F.lit(0).alias("_side"), F.col(page).alias("page_no")))
    order = Window.partitionBy(doc).orderBy("_at", "_side", "page_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("page_no", F.last("page_no", ignorenulls=True).over(order)).where("_side = 1 and page_no is not null")
    return seen.select(doc, F.col("_at").alias(offset), "page_no").distinct()


def chunk_stitched(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Chunks (doc, ordinal, chunk_id, page_start, page_end, method, text) of rows (doc, body, starts, methods). Empty texts have none.

    The method is that of the chunk's pages, or mixed; a remainder that joins a chunk moves its last page, not its method.
    """
    small_batches(docs.sparkSession)
    gaps = F.when(F.contains("body", F.lit("  ")), F.transform(F.regexp_extract_all("body", F.lit(SENTENCE_GAP), F.lit(0)), lambda g: F.length(g)))
    parted = docs.select(doc, sentences(F.col("body")).alias("parts"), gaps.alias("gaps"), "starts", "methods")
    placed = parted.withColumn("at", _places(_lengths(F.col("parts")), F.col("gaps"), F.col("starts"))).select(doc, "methods", "at", _pieces(F.col("parts"), F.col("at.lines")).alias("pieces"))

    def chunk(at: Column) -> Column:
        text = F.array_join(F.slice("pieces", at["first"] + 1, at["n"]), " ")
        whole = F.when(at["n_rest"] == 0, text).otherwise(T.stripped(F.concat_ws(" ", text, F.array_join(F.slice("pieces", at["rest"] + 1, at["n_rest"]), " "))))
        methods = F.array_distinct(F.slice("methods", at["page_start"], at["page_full"] - at["page_start"] + 1))
        return F.struct(at["page_start"].alias("page_start"), at["page_end"].alias("page_end"), F.when(F.size(methods) == 1, methods[0]).otherwise("mixed").alias("method"), whole.alias("text"))

    # Chunks are cut out within the row: what goes on is each chunk with its own text.
    found = placed.select(doc, F.posexplode(F.transform("at.chunks", chunk)).alias("ordinal", "c"))
    return found.select(doc, "ordinal", F.format_string("%s#%04d", T.stem(F.col(doc).cast("string")), F.col("ordinal")).alias("chunk_id"), "c.page_start", "c.page_end", "c.method", "c.text")


def chunk_grid(docs: DataFrame, settings: Sequence[tuple[int, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (target, overlap, id_col, ordinal, text): the chunks of documents of one page for every setting (target, overlap), a chunk's limit being twice its target.

    Texts are read, normalised and parted once; their lengths go through one Arrow function, which folds them for all settings."""
    small_batches(docs.sparkSession)
    settings = [(int(t), int(o)) for t, o in settings]
    shortest = min(t for t, _ in settings)

    @F.pandas_udf(ArrayType(StructType([StructField("target", IntegerType()), StructField("overlap", IntegerType()), StructField("lines", _LINES), StructField("chunks", _CHUNKS)])))
    def folded(words: pd.Series) -> pd.Series:
        def of(w: list[np.ndarray] | None) -> list[dict]:
            found = []
            words = [] if w is None else list(w)
            whole = _wholes(words)
            for target, overlap in settings if w is not None else ():
                lines = _lines_of(words, target, whole)
                found.append({"target": target, "overlap": overlap, "lines": _told(lines), "chunks": places(lines, None, np.zeros(1, np.int64), target, overlap, 2 * target)})
            return found

        return words.map(of)

    parted = docs.select(id_col, sentences(T.normalize(F.col(text_col))).alias("parts"))
    placed = parted.withColumn("at", folded(_lengths(F.col("parts"), shortest)))

    def joined(pieces: Column, first: Column, n: Column) -> Column:
        return F.array_join(F.slice(pieces, first + 1, n), " ")

    def texts(setting: Column) -> Column:
        whole = lambda pieces: F.transform(setting["chunks"], lambda c: F.when(c["n_rest"] == 0, joined(pieces, c["first"], c["n"])).otherwise(T.stripped(F.concat_ws(" ", joined(pieces, c["first"], c["n"]), joined(pieces, c["rest"], c["n_rest"])))))
        cut = F.transform(F.array(_pieces(F.col("parts"), setting["lines"])), whole)[0]
        return F.struct(setting["target"].alias("target"), setting["overlap"].alias("overlap"), cut.alias("texts"))

    each = placed.select(id_col, F.explode(F.transform("at", texts)).alias("s"))
    return each.select("s.target", "s.overlap", id_col, F.posexplode("s.texts").alias("ordinal", "text"))


def chunk_pages(pages: DataFrame, doc: str = "doc", page: str = "page_no", text_col: str = "text", method: str = "method") -> DataFrame:
    """Chunks of documents given by pages, whose texts are normalised first."""
    return chunk_stitched(stitch(pages.withColumn(text_col, T.normalize(F.col(text_col))), doc, page, text_col, method), doc)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", method: str = "text_layer") -> DataFrame:
    """Chunks of documents of one page each. Null, empty and blank texts have none."""
    rows = docs.select(id_col, T.normalize(F.col(text_col)).alias("body"), F.array(F.lit(0)).alias("starts"), F.array(F.lit(method)).alias("methods"))
    return chunk_stitched(rows, id_col)


def without_chunks(docs: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Documents that gave no chunk."""
    return docs.join(chunks.select(key).distinct(), key, "left_anti")


def require_chunks(docs: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """The chunks; an error names a document that gave none."""
    if missing := without_chunks(docs.select(key), chunks, key).head(1):
        raise ValueError(f"document {missing[0][0]} has no text")
    return chunks
