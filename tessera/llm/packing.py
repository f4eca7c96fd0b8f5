"""Harmonic packing of documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k], and each of
its bins takes k pieces, so every worker fills the bins of its own partition with a fixed count per
class and no exchange. A document is cut until the last piece wastes little of its class: whole
sequences first, then pieces of exactly C/k. The bins that a partition leaves open at its end are
merged first-fit by decreasing length. One pass, no shuffle; a worker holds its open bins only.

Null and empty texts are the end id alone; repeated rows are packed separately; an empty table packs
into nothing; other columns are not read. Sequence ids are unique over partitions and depend only on
the input's partitions, so a lost task comes back with the same ids.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .pieces import codec
from .shared import byte_slices, in_arrow, named, struct

#: Share of a sequence that the pieces of a class may leave empty before a document is cut instead.
WASTE = 0.01


@lru_cache(maxsize=1 << 16)
def cut_lengths(n: int, capacity: int, waste: float = WASTE) -> tuple[int, ...]:
    """Lengths of the pieces, in order, of the last n < capacity ids of a document."""
    out = []
    while n:
        k = capacity // n
        if capacity - k * n <= waste * capacity:
            out.append(n)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        n -= piece
    return tuple(out)


class Bins:
    """Open bins of one worker. Pieces are numbered in the order they come; only a bin that is complete gets a sequence id."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        """The pieces with sequence id and offset."""
        starts = [0, *accumulate(p[2] for p in pieces)]
        out = [(*p, self.next, at) for p, at in zip(pieces, starts, strict=False)]
        self.next += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """The pieces of the bin that this one completes, if it does. A piece's third field is its length."""
        k = self.capacity // piece[2]
        bin_ = self.open[k]
        bin_.append(piece)
        return self._close(self.open.pop(k)) if len(bin_) == k else []

    def rest(self) -> list[tuple]:
        left = sorted((p for b in self.open.values() for p in b), key=lambda p: -p[2])
        self.open.clear()
        room: list[int] = []
        bins: list[list[tuple]] = []
        for piece in left:
            i = next((i for i, free in enumerate(room) if free >= piece[2]), None)
            if i is None:
                i = len(room)
                room.append(self.capacity)
                bins.append([])
            room[i] -= piece[2]
            bins[i].append(piece)
        return [p for b in bins for p in self._close(b)]


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids themselves."""
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(vocabulary, with_ids=True)
        bins = Bins(capacity, TaskContext.get().partitionId() << 36)
        id_type = None

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True)) or [()] * 8
            keys, start, length, crc, total, parts, sequence, offset = columns
            arrays = [pa.array(keys, id_type), *(pa.array(c, pa.int64()) for c in (start, length, crc, total, sequence, offset))]
            if with_ids:
                flat = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(np.asarray(length, np.int64))]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)))
            return pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

        for batch in batches:
            id_type = batch.column(0).type
            for a, b in byte_slices(batch.column(1)):
                counts, ids = encoder.answers(batch.column(1)[a:b], end_id)
                done: list[tuple] = []
                first = 0
                for key, total in zip(batch.column(0)[a:b].to_pylist(), counts.tolist(), strict=True):
                    at = 0
                    for length in (*[capacity] * (total // capacity), *cut_lengths(total % capacity, capacity)):
                        part = ids[first + at : first + at + length]
                        # Open pieces outlive the slice: a copy holds their own ids only.
                        done += bins.add((key, at, length, zlib.crc32(part), total, part.copy() if with_ids else None))
                        at += length
                    first += total
                yield batch_of(done)
        if id_type is not None:
            yield batch_of(bins.rest())

    schema = struct([docs.schema[id_col]], ", ".join(f"{n} long" for n in names[1:7]) + (", ids array<long>" if with_ids else ""))
    return in_arrow(docs.select(named(id_col), named(text_col).cast("string").alias("text")), pack, schema)
