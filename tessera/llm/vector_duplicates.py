"""Embedding near-dedup by a subspace pigeonhole join, exact in double precision.

Unit vectors of cosine >= c lie within squared distance 2 (1 - c). Rotated and cut into BLOCKS blocks,
two such vectors are, in one block at least, within that block's share of the budget. Each block is
joined by range: a k-d tree, fitted on a bounded sample, cuts its space into cells; a vector lives in
the cell it lies in and visits every later cell that its ball touches, so each pair within the block's
budget meets in exactly one cell. Crowded cells are dealt into salted parts, each visited by the
vectors of the parts before it, so a worker holds LEAF residents and streams the rest past them.

Where a pair meets, its cosine is computed exactly from the vectors themselves; it counts in the first
block whose budget it meets, so no pair counts twice and no list of pairs is sent anywhere. A cell
returns counts per vector and a forest of its links. Equal vectors are one row with a weight.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths with each other; rows of one id and vector count as separate vectors;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, in_arrow, named, rate_of

BLOCKS, LEAF, MAX_CELLS, SAMPLE = 8, 4096, 4096, 20_000
#: Rows of a tile that meets the residents, and pairs whose cosines are computed at a time.
TILE, PAIRS = 256, 50_000
#: Allowance for rounding where a pair is only proposed.
SLACK = 1e-7


class Cells:
    """Per block the cuts of a k-d tree, as nested (axis, value, low, high) with numbers of cells as leaves."""

    def __init__(self, dim: int, sample: np.ndarray, cosine: float, total: int, blocks: int, leaf: int):
        self.blocks = min(blocks, dim)
        self.rotation = np.linalg.qr(np.random.default_rng(5).normal(size=(dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), self.blocks)
        self.cosine = cosine
        self.budgets = [2 * (1 - cosine) * len(p) / dim for p in self.parts]
        depth = int(np.ceil(np.log2(max(1.0, min(MAX_CELLS, total / leaf)))))
        turned = self.turned(sample)
        self.trees = []
        for part in self.parts:
            self._cells = 0
            self.trees.append(self._grow(turned[:, part], depth))

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.rotation

    def _grow(self, x: np.ndarray, depth: int):
        if depth and len(x) > 1:
            axis = int(x.std(0).argmax())
            value = float(np.median(x[:, axis]))
            below = x[:, axis] < value
            if below.any():
                return axis, value, self._grow(x[below], depth - 1), self._grow(x[~below], depth - 1)
        self._cells += 1
        return self._cells - 1

    def visits(self, block: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, rows whose ball touches it, whether each lives there), in the order of cells."""
        limit = self.budgets[block] + SLACK

        def walk(node, rows: np.ndarray, gap: np.ndarray, home: np.ndarray):
            if not len(rows):
                return
            if isinstance(node, int):
                yield node, rows, home
                return
            axis, value, low, high = node
            off = x[rows, axis] - value
            for child, inside in ((low, off < 0), (high, off >= 0)):
                far = gap.copy()
                far[:, axis] = np.where(inside, gap[:, axis], np.maximum(gap[:, axis], np.abs(off)))
                near = (far * far).sum(1) <= limit
                yield from walk(child, rows[near], far[near], (home & inside)[near])

        yield from walk(self.trees[block], np.arange(len(x)), np.zeros(x.shape), np.ones(len(x), bool))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _homes(cells: Cells, dim: int):
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = cells.turned(_matrix(batch.column(0), dim))
            found: list[tuple[int, int, int]] = []
            for k, part in enumerate(cells.parts):
                found += [(k, cell, int(home.sum())) for cell, _, home in cells.visits(k, turned[:, part])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["block", "cell", "n"])

    return homes


def _deal(cells: Cells, dim: int, salts: dict[tuple[int, int], int]):
    """Rows (spot, visitor, key, weight, vector); spot = block << 48 | cell << 24 | salt."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2), dim)
            keys = np.asarray(batch.column(0)).astype(np.int64)
            spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            turned = cells.turned(x)
            for k, part in enumerate(cells.parts):
                lived = np.zeros(len(x), bool)
                for cell, rows, home in cells.visits(k, turned[:, part]):
                    # A cell is visited by those that live in an earlier one; cells come in order.
                    rows, own = rows[home | lived[rows]], home[home | lived[rows]]
                    lived[rows[own]] = True
                    n = salts.get((k, cell), 1)
                    mine = np.where(own, (spread[rows] % np.uint64(n)).astype(np.int64), -1)
                    for salt in range(n):
                        at = mine <= salt
                        if not at.any():
                            continue
                        picked = pa.array(rows[at])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(at.sum(), k << 48 | cell << 24 | salt)), pa.array(mine[at] != salt), batch.column(0).take(picked), batch.column(1).take(picked), batch.column(2).take(picked)], names=["spot", "visitor", "key", "weight", "vector"])

    return deal


class _Spot:
    """The residents of one cell part, and the rows that stream past them."""

    def __init__(self, cells: Cells, block: int):
        self.cells, self.block = cells, block
        self.keys, self.weights, self.vectors = [], [], []
        self.ready = False

    def live(self, keys, weights, vectors) -> None:
        self.keys.append(keys)
        self.weights.append(weights)
        self.vectors.append(vectors)

    def settle(self) -> list[tuple]:
        """All residents are here: they meet each other."""
        self.ready = True
        if not self.keys:
            return []
        self.keys, self.weights, x = np.concatenate(self.keys), np.concatenate(self.weights), np.concatenate(self.vectors)
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.turned = self.cells.turned(x)
        self.counts = np.zeros(len(x), np.int64)
        self.labels = np.arange(len(x))
        self.residents, self.vectors = len(x), None
        return self._meet(self.keys, self.weights, self.unit, self.turned, True)

    def visit(self, keys, weights, vectors) -> list[tuple]:
        if not len(self.keys):
            return []
        return self._meet(keys, weights, vectors / np.linalg.norm(vectors, axis=1, keepdims=True), self.cells.turned(vectors), False)

    def counted(self) -> list[tuple]:
        if not self.ready or not len(self.keys):
            return []
        return [(int(k), None, int(c)) for k, c in zip(self.keys, self.counts, strict=True) if c]

    def _meet(self, keys, weights, unit, turned, own: bool) -> list[tuple]:
        out: list[tuple] = []
        part = self.cells.parts[self.block]
        y = self.turned[:, part]
        square = (y * y).sum(1)
        for a in range(0, len(keys), TILE):
            x = turned[a : a + TILE][:, part]
            near = (x * x).sum(1)[:, None] + square - 2 * x @ y.T <= self.cells.budgets[self.block] + SLACK
            if own:
                near[np.arange(len(x)), a + np.arange(len(x))] = False
            i, j = np.nonzero(near)
            for s in range(0, len(i), PAIRS):
                p, q = i[s : s + PAIRS] + a, j[s : s + PAIRS]
                good = (unit[p] * self.unit[q]).sum(1) >= self.cells.cosine
                p, q = p[good], q[good]
                if not len(p):
                    continue
                gap = (turned[p] - self.turned[q]) ** 2
                first = gap[:, part].sum(1) <= self.cells.budgets[self.block]
                for k in range(self.block):
                    first &= gap[:, self.cells.parts[k]].sum(1) > self.cells.budgets[k]
                p, q = p[first], q[first]
                if len(p):
                    out += self._link(p, q, keys, weights, own)
        return out

    def _link(self, p, q, keys, weights, own: bool) -> list[tuple]:
        """Pairs in the order of p. Counts, and the links that join something new."""
        np.add.at(self.counts, q, weights[p])
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        out = []
        if not own:
            sums = np.add.reduceat(self.weights[q], starts)
            out += [(int(keys[p[s]]), int(self.keys[q[s]]), int(n)) for s, n in zip(starts, sums, strict=True)]
        low, high = np.minimum.reduceat(self.labels[q], starts), np.maximum.reduceat(self.labels[q], starts)
        for s, e, lo, hi in zip(starts, np.append(starts[1:], len(p)), low, high, strict=True):
            if lo == hi and not (own and self.labels[p[s]] != lo):
                continue
            anchor = int(p[s]) if own else int(q[s])
            labels, at = np.unique(self.labels[q[s:e]], return_index=True)
            for label, place in zip(labels, at, strict=True):
                if self.labels[anchor] != (label := self.labels[q[s + place]]):
                    out.append((int(keys[p[s]]), int(self.keys[q[s + place]]), 0))
                    self.labels[self.labels == label] = self.labels[anchor]
        return out


def _join(cells: Cells, dim: int):
    """Rows (a, b, n): n more links of a; b, where there is one, is linked with a."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, last = None, None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ((), (), ()))], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks, visitor = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8()))
            keys, weights, x = np.asarray(batch.column(2)), np.asarray(batch.column(3)), _matrix(batch.column(4), dim)
            edges = np.flatnonzero((np.diff(marks) != 0) | (np.diff(visitor) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(marks)], strict=True):
                if marks[a] != last:
                    if spot is not None:
                        yield rows(([] if spot.ready else spot.settle()) + spot.counted())
                    spot, last = _Spot(cells, int(marks[a]) >> 48), marks[a]
                if not visitor[a]:
                    spot.live(keys[a:b], weights[a:b], x[a:b])
                    continue
                if not spot.ready:
                    yield rows(spot.settle())
                yield rows(spot.visit(keys[a:b], weights[a:b], x[a:b]))
        if spot is not None:
            yield rows(([] if spot.ready else spot.settle()) + spot.counted())

    return join


def link_vectors(vectors: DataFrame, cosine: float, id_col: str = "vec_id", vector_col: str = "embedding", blocks: int = BLOCKS, leaf: int = LEAF) -> DataFrame:
    """A row per vector: id_col, n_links (other vectors linked directly), component_id (smallest id reachable), kept."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType
    v = named(vector_col)
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(named(id_col).alias("id"), F.when(usable, v).alias("vector"))
    # One key per distinct vector: its smallest id may be null or repeated, so the key is a number of its own.
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("weight")).withColumn("key", F.monotonically_increasing_id())
    classes = scratch.save(classes.withColumn("dim", F.size("vector")), "vectors")
    met = []
    sizes = classes.groupBy("dim").count().collect()
    for dim, total in ((r["dim"], r["count"]) for r in sizes):
        own = classes.where(F.col("dim") == dim)
        picked = own.where(rate_of("cells", "key") < min(1.0, SAMPLE / total)).select("vector").collect()
        cells = Cells(dim, np.array([r["vector"] for r in picked], dtype=np.float64).reshape(-1, dim), cosine, total, blocks, leaf)
        homes = in_arrow(own.select("vector"), _homes(cells, dim), "block long, cell long, n long").groupBy("block", "cell").agg(F.sum("n").alias("n")).collect()
        salts = {(r["block"], r["cell"]): 1 + (r["n"] - 1) // (2 * leaf) for r in homes if r["n"] > 2 * leaf}
        element = classes.schema["vector"].dataType.simpleString()
        dealt = in_arrow(own.select("key", "weight", "vector"), _deal(cells, dim, salts), f"spot long, visitor boolean, key long, weight long, vector {element}")
        met.append(scratch.save(in_arrow(dealt.repartition("spot").sortWithinPartitions("spot", "visitor"), _join(cells, dim), "a long, b long, n long"), f"met-{dim}"))
    if not met:
        met = [spark.createDataFrame([], "a long, b long, n long")]
    found = met[0]
    for more in met[1:]:
        found = found.unionByName(more)
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "key")
    roots = components(found.where("b is not null").select("a", "b"), "a", "b", scratch, "roots").withColumnRenamed("node", "key")
    joined = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    labels = joined.join(least, "root").join(counts, "key", "left").select("vector", "component", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(labels, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
