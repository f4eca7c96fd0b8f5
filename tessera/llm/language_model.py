"""Language-model scoring by deleted interpolation of n-grams of up to two words.

A token's probability is a mixture of maximum-likelihood estimates: of the bigram, of the word, and
uniform over the vocabulary and one unknown word. The mixture weights depend on a bucket of the
context's frequency (powers of two) and are learned by expectation-maximisation on training documents
whose counts are deleted (fold DELETED); then all training documents count. Sums over any context are 1.

Counts cover all training documents, whatever their number. Documents lie in blocks of about 2 M
characters; a block asks for its distinct n-grams, packed by range of hash, so every n-gram crosses
the network once per block and not once per occurrence. A range adds up what the blocks asked and
answers them in the order of the hashes; a task takes its ranges one after the other, so the number of
tasks doesn't follow that of ranges. The shuffle of what is asked goes as soon as the answers are a table.
Nothing of the vocabulary reaches the driver: it sees N, V and a histogram for the EM steps, of a size
that grows with log2(N) only.

Null and empty texts are the end token alone; without training documents every estimate but the
uniform is zero; documents with a null id are held out; repeated rows count and score row by row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from .shared import MOST_PARTITIONS, Scratch, in_arrow, mix, named, null_to_empty, remainder, slices, struct

FOLDS, HELD_OUT, DELETED = 10, 0, 1
#: N-grams that a range holds at a time, about.
RANGE_GRAMS = 1_000_000
#: Tokens of the blocks that a task gathers answers for, about.
BLOCK_TOKENS = 1_500_000
MEMORY_WORDS = 150_000
CONTEXT_BUCKETS = 24
#: Steps of probability per octave in the EM histogram, and octaves down to its floor: counts have 64 bits, so that
#: no estimate lies below it. Cells are those that occur, some 4 log2(N) to an axis; 1000 holds the places of an axis.
STEPS, OCTAVES = 4, 64
EM_ROUNDS = 60
_ONE = np.uint64(1)
#: Bits of an n-gram's hash; the last one tells words (0) from bigrams (1). Sorted keys are sent as steps, so fewer bits are fewer bytes.
KEY_BITS = 56
_DROP = np.uint64(64 - KEY_BITS)
_END = (np.uint64(xxhash.xxh3_64_intdigest(b" ")) >> _DROP) & ~_ONE
_START = (np.uint64(xxhash.xxh3_64_intdigest(b"  ")) >> _DROP) | _ONE


def _press(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _open(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One at a time: rows are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _grams(words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of all n-grams of a block, and per token the places of its word, its context and its bigram.

    words: sorted keys of words (even); tokens: places in it. Bigrams and the context of first tokens have odd keys."""
    word = words[tokens]
    starts = np.cumsum(lengths) - lengths
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[starts] = _START
    pairs, which = np.unique((mix(mix(context + _ONE) * np.uint64(3) + word) >> _DROP) | _ONE, return_inverse=True)
    del word, context
    keys = np.unique(np.concatenate([words, pairs, np.array([_START], np.uint64)]))
    at_word = np.searchsorted(keys, words)[tokens]
    at_context = np.empty_like(at_word)
    at_context[1:] = at_word[:-1]
    at_context[starts] = np.searchsorted(keys, _START)
    return keys, at_word, at_context, np.searchsorted(keys, pairs)[which.ravel()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        folds, texts = batch.column(1).to_pylist(), null_to_empty(batch.column(2).to_pylist())
        for a, b in slices(texts):
            parts, lengths = [], []
            for text in texts[a:b]:
                split = text.encode("utf-8", "surrogatepass").lower().split()
                if len(known) > MEMORY_WORDS:
                    known = {}
                known.update((w, xxhash.xxh3_64_intdigest(w) >> 64 - KEY_BITS & ~1) for w in set(split) if w not in known)
                parts.append(np.fromiter(map(known.__getitem__, split), np.uint64, len(split)))
                parts.append(np.array([_END], np.uint64))
                lengths.append(len(split) + 1)
            words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            row = [number, batch.column(0)[a:b].to_pylist(), folds[a:b], lengths, _press(words), _press(tokens.ravel().astype("<u4"))]
            kinds = [pa.int64(), pa.list_(batch.column(0).type), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["block", "ids", "folds", "lengths", "words", "tokens"])
            number += 1


def _asked(ranges: int):
    """Rows (range, block, keys, fit, deleted): what a block asks of a range, with its own counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                lengths, folds = np.array(row["lengths"]), np.array(row["folds"])
                keys, word, context, pair = _grams(_open(row["words"], np.uint64), _open(row["tokens"], np.uint32), lengths)
                fold = np.repeat(folds, lengths)
                start = context == np.searchsorted(keys, _START)
                counts = []
                for mask in ((fold != HELD_OUT) & (fold != DELETED), fold == DELETED):
                    at = np.concatenate([word[mask], pair[mask], context[mask & start]])
                    counts.append(np.bincount(at, minlength=len(keys)).astype("<u4"))
                # Only the ranges that the block has an n-gram of.
                number = keys // np.uint64((1 << KEY_BITS) // ranges + 1)
                edges = np.flatnonzero(np.diff(number)) + 1
                for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                    steps = np.diff(keys[a:b], prepend=np.uint64(0))
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (int(number[a]), row["block"], _press(steps), _press(counts[0][a:b]), _press(counts[1][a:b]))], names=["range", "block", "keys", "fit", "deleted"])

    return ask


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, block, fit, whole, seen): counts for what each block asked; the first of a range brings the words seen in it, others 0."""
    names = ["range", "block", "fit", "whole", "seen"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def answer(held: list[dict]) -> Iterator[pa.RecordBatch]:
        asked = [np.cumsum(_open(r["keys"], np.uint64), dtype=np.uint64) for r in held]
        keys = np.unique(np.concatenate(asked))
        fit, whole = np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8")
        places = [np.searchsorted(keys, k) for k in asked]
        for r, at in zip(held, places, strict=True):
            own, deleted = _open(r["fit"], np.uint32), _open(r["deleted"], np.uint32)
            fit[at] += own
            whole[at] += own.astype(np.uint64) + deleted
        seen = int(((whole > 0) & (keys & _ONE == 0)).sum())
        for i, (r, at) in enumerate(zip(held, places, strict=True)):
            row = r["range"], r["block"], _press(fit[at]), _press(whole[at]), 0 if i else seen
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["range"] != held[0]["range"]:
                yield from answer(held)
                held = []
            held.append(row)
    if held:
        yield from answer(held)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], CONTEXT_BUCKETS - 1)


def _step(p: np.ndarray) -> np.ndarray:
    """Place of a probability in the histogram; impossible ones are 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.minimum(np.round(-STEPS * np.log2(p)), STEPS * OCTAVES), 0).astype(np.int64)


def _counts_of(row: dict, parts: list[dict]) -> tuple:
    keys, word, context, pair = _grams(_open(row["words"], np.uint64), _open(row["tokens"], np.uint32), np.array(row["lengths"]))
    found = {}
    for name in ("fit", "whole"):
        found[name] = np.concatenate([_open(p[name], np.uint64) for p in parts])
        if len(found[name]) != len(keys):
            raise ValueError(f"block {row['block']} asked {len(keys)} n-grams and got {len(found[name])}")
    return found["fit"], found["whole"], word, context, pair


def _resolved(fit_total: int):
    """A block's own row comes first, its answers follow in the order of ranges. Rows with counts a token, and the EM histogram of the block's deleted fold.

    A token's context is the word before it, so its count is that word's; `start` is the count of the context of first tokens."""
    names = ["block", "ids", "folds", "lengths", "known", "seen", "start", "word", "pair", "cells"]

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(row: dict, parts: list[dict]) -> pa.RecordBatch:
            fit, whole, word, context, pair = _counts_of(row, parts)
            chosen = np.repeat(np.array(row["folds"]), row["lengths"]) == DELETED
            w, c, p = fit[word[chosen]], fit[context[chosen]], fit[pair[chosen]]
            cell = (_bucket(c) * 1000 + _step(p / np.maximum(c, 1))) * 1000 + _step(w / max(fit_total, 1))
            cells = Counter(dict(zip(*(x.tolist() for x in np.unique(cell, return_counts=True)), strict=True)))
            known = np.add.reduceat((whole[word] > 0).astype(np.int64), np.cumsum(row["lengths"]) - row["lengths"])
            seen, start = sum(x["seen"] for x in parts), int(whole[context[0]])
            columns = [row["block"], row["ids"], row["folds"], row["lengths"], known.tolist(), seen, start, _press(whole[word]), _press(whole[pair]), [{"cell": k, "n": n} for k, n in cells.items()]]
            kinds = [pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), *[pa.binary()] * 2, pa.list_(pa.struct([("cell", pa.int64()), ("n", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(columns, kinds, strict=True)], names=names)

        own, parts, id_type = None, [], None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in _rows(batch):
                if row["range"] < 0:
                    if own:
                        yield out(own, parts)
                    own, parts = row, []
                else:
                    parts.append(row)
        if own:
            yield out(own, parts)

    return resolve


def learn_weights(cells: dict[int, int], uniform: float) -> np.ndarray:
    """CONTEXT_BUCKETS x (bigram, word, uniform), by EM; a bucket without data takes those of the one below it."""
    out = np.zeros((CONTEXT_BUCKETS, 3))
    back = lambda q: np.where(q > 0, np.exp2(-(q - 1) / STEPS), 0.0)
    keys, n = np.array(list(cells), np.int64), np.array(list(cells.values()), float)
    for b in range(CONTEXT_BUCKETS):
        own = keys // 1_000_000 == b
        weights = np.array([0.0, 0.5, 0.5]) if b == 0 else out[b - 1] if not own.any() else np.array([0.4, 0.4, 0.2])
        if own.any():
            p = np.stack([back(keys[own] // 1000 % 1000), back(keys[own] % 1000), np.full(own.sum(), uniform)])
            for _ in range(EM_ROUNDS):
                share = weights[:, None] * p
                share = (share / share.sum(0)) @ n[own]
                # One more token on every estimate: no weight reaches zero by chance.
                share += np.array([0.0 if b == 0 else 1.0, 1.0, 1.0])
                weights = share / share.sum()
        out[b] = weights
    return out


def _scored(total: int, distinct: int, weights: np.ndarray, id_col: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                w, p = (_open(row[n], np.uint64).astype(float) for n in ("word", "pair"))
                starts = np.cumsum(row["lengths"]) - row["lengths"]
                c = np.concatenate([[0.0], w[:-1]])
                c[starts] = row["start"]
                base = np.log10((w + 0.1) / (total + 0.1 * (distinct + 1)))
                mixed = weights[_bucket(c)]
                model = np.log10(mixed[:, 0] * p / np.maximum(c, 1) + mixed[:, 1] * w / max(total, 1) + mixed[:, 2] / (distinct + 1))
                m = len(row["ids"])
                arrays = [pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array([f == HELD_OUT for f in row["folds"]]), pa.array(row["lengths"], pa.int64()), pa.array(row["known"], pa.int64())]
                arrays += [pa.array([total] * m, pa.int64()), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(model, starts))]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigram), score (log10 probability)."""
    key, scratch = docs.schema[id_col], Scratch(docs.sparkSession)
    rows = docs.select(named(id_col).alias("id"), remainder(named(id_col), FOLDS).alias("fold"), named(text_col).cast("string").alias("text"))
    fields = [StructField("block", LongType()), StructField("ids", ArrayType(key.dataType))]
    own = "folds array<int>, lengths array<long>"
    blocks = scratch.save(in_arrow(rows, _blocks, struct(fields, f"{own}, words binary, tokens binary")), "blocks")
    sums = blocks.select(F.explode(F.arrays_zip("folds", "lengths")).alias("d")).select(F.col("d.folds").alias("fold"), F.col("d.lengths").alias("n"))
    totals = {r["fold"]: r["n"] for r in sums.groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    total, tokens = sum(n for f, n in totals.items() if f != HELD_OUT), sum(totals.values())
    ranges = max(8, tokens // RANGE_GRAMS)
    asked = in_arrow(blocks, _asked(ranges), "range long, block long, keys binary, fit binary, deleted binary")
    dealt = asked.repartition(min(ranges, MOST_PARTITIONS), "range").sortWithinPartitions("range")
    answers = scratch.save(in_arrow(dealt, _answered, "range long, block long, fit binary, whole binary, seen long"), "answers")
    both = blocks.withColumn("range", F.lit(-1).cast("long")).unionByName(answers, allowMissingColumns=True)
    parts = max(1, min(MOST_PARTITIONS, tokens // BLOCK_TOKENS))
    counted = both.repartition(parts, "block").sortWithinPartitions("block", "range")
    counted = in_arrow(counted, _resolved(total - totals.get(DELETED, 0)), struct(fields, f"{own}, known array<long>, seen long, start long, word binary, pair binary, cells array<struct<cell: long, n: long>>"))
    resolved = scratch.save(counted, "resolved")
    scratch.drop("blocks", "answers")
    distinct = resolved.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    cells = {r["cell"]: r["n"] for r in resolved.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n")).collect()}
    weights = learn_weights(cells, 1 / (distinct + 1))
    out = struct([key], "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return in_arrow(resolved.select("ids", "folds", "lengths", "known", "start", "word", "pair"), _scored(total, distinct, weights, id_col), out)
