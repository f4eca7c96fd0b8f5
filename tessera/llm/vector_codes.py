"""Vector code compression: a product code of integer vectors by delta-maintained Lloyd rounds.

A component x becomes the integer floor(scale * x); a vector is cut into `parts` equal parts, and each
part's place has a codebook of `entries` entries, which begins as that part of the vectors with the
smallest ids. A round gives every part its nearest entry and then replaces each entry by the floor of the
mean of its parts; unused entries stay. After the last round parts are given their entries once more.

Rounds are maintained by differences: the table of vectors carries the codes of the round before, and the
integer sums and counts of all entries are a table of their own. A round rewrites the codes, without a
shuffle, and each task adds what parts with a new code bring to their new entry and take from their old
one; only these sums are shuffled, `parts * entries` rows a task at most, and joined to the running ones.
Codebooks (entries * length of a vector integers, whatever the number of rows) go through the driver.

All arithmetic is exact: distances are computed in doubles where they are integers below 2^53, else in
64-bit integers. So that a row's error fits these, components are held to +-2^31 / sqrt(8 * length)
(half a million after scaling down, for 64 components); sums of errors beyond 64 bits are held to the greatest one.

Vectors that are null or hold null or non-finite components are left out. Vectors of other lengths than
the greatest, or of one that `parts` doesn't divide, are filled up with zeros. Ids may repeat and be null
(they come last); the codebook then begins with the first rows by id and components. With fewer rows than
entries, there are as many entries as rows. Ties go to the lower entry. Empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, in_arrow, named

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows whose distances are computed at a time, in cells of (row, part, entry, component).
CELLS = 4 << 20
#: A label with at least one row in so many is joined by broadcast: there can't be more such labels.
HOT = 256
#: Greatest 64-bit integer.
GREATEST = (1 << 63) - 1


@dataclass
class VectorCodes:
    """rows: id, label, code (a byte a part), error, label_error. codebooks: integers by part, entry and place in the part."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """sha256 of the codebooks' integers in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def integers(vectors: list | np.ndarray, length: int, scale: int) -> np.ndarray:
    """Rows of `length` integers, filled up with zeros and held to what keeps squares within 64 bits."""
    bound = float(1 << 31) / math.sqrt(8 * length)
    out = np.zeros((len(vectors), length), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = np.clip(np.floor(np.asarray(v, np.float64) * scale), -bound, bound)
    return out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x: (rows, parts, d); books: (parts, entries, d). Entries and squared distances, (rows, parts) each."""
    codes, errors = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    d = x.shape[2]
    step = max(1, CELLS // max(1, books.size))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        most = max(int(np.abs(part).max(initial=0)), int(np.abs(books).max(initial=0)))
        if 4 * d * most * most < 1 << 53:
            p, b = part.transpose(1, 0, 2).astype(np.float64), books.astype(np.float64)
            far = (p * p).sum(2)[:, :, None] - 2 * (p @ b.transpose(0, 2, 1)) + (b * b).sum(2)[:, None, :]
            far = far.transpose(1, 0, 2)
        else:
            far = ((part[:, :, None, :] - books[None]) ** 2).sum(3)
        best = far.argmin(2)
        codes[a : a + step] = best
        errors[a : a + step] = np.take_along_axis(far, best[:, :, None], 2)[:, :, 0].astype(np.int64)
    return codes, errors


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, length)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)


def _bytes(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())


def _quantised(length: int, scale: int):
    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = integers(batch.column(2).to_pylist(), length, scale).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(ints) + 1, dtype=np.int32) * length), pa.array(ints.ravel()))
            nothing = pa.nulls(len(ints), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors, nothing], names=["id", "label", "vector", "code"])

    return quantised


def _coded(books: np.ndarray, length: int):
    """Rows (id, label, vector, code) with new codes, then the task's changes of sums as rows (slot, change) with a null vector."""
    parts, entries, d = books.shape

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((parts * entries, d + 1), np.int64)
        slots = np.arange(parts) * entries
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch
            x = _matrix(batch.column(2), length).reshape(-1, parts, d)
            new, _ = nearest(x, books)
            values = np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], 2)
            known = np.asarray(batch.column(3).is_valid())
            old = np.full(new.shape, -1)
            if known.any():
                old[known] = _codes(batch.column(3).filter(pa.array(known)), parts)
            moved = new != old
            np.add.at(change, (new + slots)[moved], values[moved])
            left = moved & (old >= 0)
            np.subtract.at(change, (old + slots)[left], values[left])
            none = [pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _bytes(new), *none], names=["id", "label", "vector", "code", "slot", "change"])
        at = np.flatnonzero(change.any(1))
        if last is not None and len(at):
            none = [pa.nulls(len(at), c.type) for c in last.columns[:4]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(at.astype(np.int32)), pa.array(change[at].tolist(), pa.list_(pa.int64()))], names=["id", "label", "vector", "code", "slot", "change"])

    return coded


def _final(books: np.ndarray, length: int):
    parts, _, d = books.shape

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = nearest(_matrix(batch.column(2), length).reshape(-1, parts, d), books)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _bytes(codes), pa.array(errors.sum(1))], names=["id", "label", "code", "error"])

    return final


def _updated(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The floors of the means; sums has a row a used entry at most."""
    out = books.copy()
    for slot, total in sums.select("slot", "total").collect():
        if total[-1]:
            out[slot // books.shape[1], slot % books.shape[1]] = [v // total[-1] for v in total[:-1]]
    return out


def _added(changes: DataFrame, length: int) -> DataFrame:
    """Rows (slot, total): changes of a slot added place by place. `length` places, the count last."""
    return changes.groupBy("slot").agg(F.array(*(F.sum(F.col("change")[i]) for i in range(length))).alias("total"))


def code_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> VectorCodes:
    """Codes of all whole vectors, and the codebooks. entries: 256 at most."""
    if not 1 <= entries <= 256:
        raise ValueError("a code holds one byte a part: entries must be 1 to 256")
    scratch = Scratch(vectors.sparkSession)
    as_doubles = named(vector_col).cast("array<double>")
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(named(id_col).alias("id"), named(label_col).alias("label"), as_doubles.alias("vector")).where(F.col("vector").isNotNull() & whole)
    rows, longest = kept.agg(F.count("*"), F.max(F.size("vector"))).first()
    length = parts * max(1, -(-(longest or 0) // parts))
    first = [r["vector"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    books = integers(first, length, scale).reshape(-1, parts, length // parts).transpose(1, 0, 2)
    ids = [kept.schema["id"], kept.schema["label"]]
    state = f"id {ids[0].dataType.simpleString()}, label {ids[1].dataType.simpleString()}, vector array<int>, code binary"
    table = scratch.save(in_arrow(kept, _quantised(length, scale), state), "codes")
    totals = None
    for _ in range(rounds if rows else 0):
        found = scratch.save(in_arrow(table.where("vector is not null").select("id", "label", "vector", "code"), _coded(books, length), f"{state}, slot int, change array<bigint>"), "codes")
        changes = found.where("slot is not null").select("slot", "change")
        # The running sums and this round's changes.
        running = changes if totals is None else changes.unionByName(totals.select("slot", F.col("total").alias("change")))
        totals = scratch.save(_added(running, length // parts + 1), "sums")
        books = _updated(books, totals)
        table = found
    schema = state.replace("vector array<int>, ", "") + ", error bigint"
    coded = scratch.save(in_arrow(table.where("vector is not null").select("id", "label", "vector"), _final(books, length), schema), "coded")
    scratch.drop("codes", *(["sums"] if totals is not None else []))
    return VectorCodes(_with_label_errors(coded, rows, scratch).withColumnsRenamed({"id": id_col, "label": label_col}), books)


def _with_label_errors(coded: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """Beside each row the error summed over its label, nulls being one. Labels of many rows are few and broadcast; the others are joined by a shuffle."""
    exact = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(GREATEST).cast("decimal(38,0)")).cast("bigint")
    sums = scratch.save(coded.groupBy("label").agg(exact.alias("label_error"), F.count("*").alias("n")).withColumnRenamed("label", "of"), "label-errors")
    same = F.col("label").eqNullSafe(F.col("of"))
    hot, others = sums.where(F.col("n") * HOT >= rows), sums.where(F.col("n") * HOT < rows)
    # Two parts of the rows: those of frequent labels never reach a shuffle.
    frequent = coded.join(F.broadcast(hot), same).drop("of", "n")
    rest = coded.join(F.broadcast(hot.select("of")), same, "left_anti").join(others, same).drop("of", "n")
    return frequent.unionByName(rest)
