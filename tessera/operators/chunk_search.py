"""BM25 over the chunks of documents for a grid of sizes, each of which is a collection of its own.

A chunk is a stretch of its document's words, and no token goes beyond a word. So a document is normalised and its tokens are found
once for all sizes; its task finds where chunks begin and end by the lengths of the words, and counts what stands between. What is written of a chunk
are its place, its length and its counts of the words that are asked; its text is cut out where it is found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessera.functions import text as T
from tessera.operators.chunking import SENTENCE_GAP, ranges_of_words
from tessera.operators.lexical import CODED, best, best_of_tasks, collections, question_blocks, union
from tessera.operators.topk import KEY
from tessera.sources.shared import small_batches, written

SETTING = ("target", "overlap")
#: What stands between two words of a normalised text, and between two sentences.
SPACE, GAP = " ", "\n"


def _marked(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """Rows (id_col, marked): of every text a struct of the normalised text, with GAP between sentences, and its tokens, with SPACE and GAP in their places."""
    # A text of composed signs alone stays one: what is taken out of it makes no others.
    plain = docs.select(id_col, F.col(text_col).alias("text"), T.is_composed(F.col(text_col)).alias("plain"))
    composed = plain.select(id_col, "plain", F.coalesce(T.nfkc(F.when(~F.col("plain"), F.col("text"))), F.col("text")).alias("text"))
    body = F.regexp_replace(T.normalize(F.col("text"), compose=False), SENTENCE_GAP, GAP)
    # Words and gaps stay as they are where the text between them is composed again, as it is for tokens.
    rows = composed.select(id_col, body.alias("body"), T.nfkc(F.when(~F.col("plain"), body)).alias("again"))
    # Within an array the text is worked out once for what is told of it.
    marked = F.transform(F.array("body"), lambda t: F.struct(t.alias("text"), T.tokens(F.coalesce("again", t), pattern, compose=False, between=SPACE + GAP).alias("tokens")))
    return rows.select(id_col, marked[0].alias("marked"))


def _word_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: where words begin, one sign being between two texts, and where one behind the last would; each text's first word, and one behind the last; the words behind a GAP."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    signs = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    # Signs before each byte: those of UTF-8 begin with a byte that isn't 10xxxxxx.
    before = np.zeros(len(signs) + 1, np.int32)
    np.cumsum((signs & 0xC0) != 0x80, out=before[1:])
    gaps = np.flatnonzero((signs == ord(SPACE)) | (signs == ord(GAP)))
    of_text = np.searchsorted(ends, gaps, side="right") - 1
    first = np.concatenate([[0], np.cumsum(np.bincount(of_text, minlength=len(texts)) + 1)])
    behind = np.arange(len(gaps)) + of_text + 1
    starts = np.empty(first[-1] + 1, np.int64)
    starts[behind] = before[gaps] + of_text + 1
    starts[first] = before[ends] + np.arange(len(texts) + 1)
    return starts, first, behind[signs[gaps] == ord(GAP)]


def _stretches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers from each low to below its high."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


def counted_chunks(docs: DataFrame, words: pa.Array, settings: Sequence[tuple[int, int]], id_col: str = "doc_id", text_col: str = "text", pattern: str = "keep") -> DataFrame:
    """Rows (target, overlap, chunk, KEY, length, words, tf): for every setting (target, overlap) the chunks of documents of one page, a chunk's limit
    being twice its target; of each its tokens, the numbers of those of `words` that it has, and how often it has each.

    chunk: struct (id_col, ordinal, at, n, rest, n_rest); the text is that of `n` signs from `at` in the normalised text and, if n_rest is
    above 0, those of the remainder that joins it."""
    small_batches(docs.sparkSession)
    settings = [(int(t), int(o)) for t, o in settings]
    known, n_words = pa.concat_arrays([words.cast(pa.string()), pa.array([SPACE, GAP])]), len(words)
    rows = _marked(docs, id_col, text_col, pattern)
    chunk = StructType([rows.schema[id_col], *(StructField(n, IntegerType()) for n in ("ordinal", "at", "n", "rest", "n_rest"))])
    schema = StructType([*(StructField(n, IntegerType()) for n in SETTING), StructField("chunk", chunk), StructField(KEY, StringType()), *CODED])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts without words have no chunks.
            batch = batch.filter(pc.fill_null(pc.greater(pc.binary_length(pc.struct_field(batch.column(1), 0)), 0), False))
            if not batch.num_rows:
                continue
            text, lists = batch.column(1).flatten()
            starts, first, sentences = _word_starts(text)
            codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            between = codes >= n_words
            if np.count_nonzero(between) != len(starts) - 1 - batch.num_rows:
                raise ValueError("tokens do not lie within words")
            of_text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            word = np.cumsum(between) + of_text
            # Tokens before each word, and those that are asked.
            tokens = np.concatenate([[0], np.cumsum(np.bincount(word[~between], minlength=len(starts) - 1))])
            asked = (codes >= 0) & ~between
            codes, before = codes[asked].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(word[asked], minlength=len(starts) - 1))])
            begins, ends, owners, joins = ([[] for _ in settings] for _ in range(4))
            cuts = np.searchsorted(sentences, first)
            for i in range(batch.num_rows):
                a, z = int(first[i]), int(first[i + 1])
                own = [0, *(sentences[cuts[i] : cuts[i + 1]] - a).tolist(), z - a]
                for s, (ranges, joined) in enumerate(ranges_of_words(starts[a : z + 1].tolist(), own, settings)):
                    begins[s] += [a + x for x, _ in ranges]
                    ends[s] += [a + x for _, x in ranges]
                    owners[s] += [i] * len(ranges)
                    if joined[1]:
                        joins[s].append((len(begins[s]) - 1, a + joined[0], a + joined[1]))
            for s, (target, overlap) in enumerate(settings):
                a, z, of = (np.asarray(x[s], np.int64) for x in (begins, ends, owners))
                n, at = len(a), starts[first[of]]
                last, rest_a, rest_z = np.asarray(joins[s], np.int64).reshape(-1, 3).T
                rest, n_rest, length = np.zeros(n, np.int64), np.zeros(n, np.int64), tokens[z] - tokens[a]
                rest[last], n_rest[last] = starts[rest_a] - at[last], starts[rest_z] - 1 - starts[rest_a]
                length[last] += tokens[rest_z] - tokens[rest_a]
                low, high, row = (np.concatenate(x) for x in ((before[a], before[rest_a]), (before[z], before[rest_z]), (np.arange(n), last)))
                pairs, times = np.unique(np.repeat(row, high - low) * n_words + codes[_stretches(low, high)], return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(n + 1) * n_words), pa.int32())
                ordinal = np.arange(n) - np.searchsorted(of, of)
                places = [batch.column(0).take(pa.array(of)), *(pa.array(x, pa.int32()) for x in (ordinal, starts[a] - at, starts[z] - 1 - starts[a], rest, n_rest))]
                found = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pairs % max(1, n_words), times)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, target), pa.int32()), pa.array(np.full(n, overlap), pa.int32()), pa.StructArray.from_arrays(places, chunk.fieldNames()), pa.nulls(n, pa.string()), pa.array(length, pa.int32()), *found], names=schema.names)

    return rows.mapInArrow(count, schema)


def chunk_text(body: Column, chunk: Column) -> Column:
    """The text of a chunk of counted_chunks, out of its document's normalised text."""
    cut = lambda at, n: F.substring(body, chunk[at] + 1, chunk[n])
    return F.when(chunk["n_rest"] == 0, cut("at", "n")).otherwise(F.concat(cut("at", "n"), F.lit(" "), cut("rest", "n_rest")))


def search_chunks(docs: DataFrame, queries: DataFrame, k: int, settings: Sequence[tuple[int, int]], id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", pattern: str = "keep") -> tuple[DataFrame, DataFrame]:
    """(sizes, found): rows (target, overlap, chunks), of settings that have any, and what search_bm25 finds in each as a collection of its own, rows (target, overlap, query_id, rank, chunk, score).

    Blocks of questions take a pass over the documents each. A chunk is told as counted_chunks does; ties go to the smaller id, then to the first chunk."""
    counted = lambda words: counted_chunks(docs, words, settings, id_col, text_col, pattern)
    stats, found = None, []
    for asked in question_blocks(queries, query_id, query_text, pattern, None):
        coded = written(counted(asked.words), "postings")
        stats = collections(coded, SETTING)
        found.append(best_of_tasks(coded, asked, stats, queries, k, "chunk", query_id, SETTING))
    none = counted(pa.array([], pa.string()))
    if stats is None:
        stats = collections(none, SETTING)
    sizes = docs.sparkSession.createDataFrame([(*g, n) for g, (n, _) in stats.items()], "target int, overlap int, chunks long")
    return sizes, best(union(found, none, queries, SETTING, query_id, "chunk"), k, "chunk", query_id, SETTING)
