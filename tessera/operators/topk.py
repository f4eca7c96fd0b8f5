"""The k best rows of every query, kept while a task reads its rows: what leaves a task is k rows a query at most."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import bounded

#: Places that scores are compared at, and scores that a worker holds at a time.
PLACES, CELLS = 9, 1 << 20
#: Rows of pairs that are not to be found up to which they are broadcast.
MOST_BROADCAST = 1_000_000
#: Names of a row's and a query's key, and of the queries that aren't to find a row.
KEY, OUT = "_key", "_out"


class Best:
    """Of `queries` queries the k best rows so far: greatest score at PLACES places, then smallest ids."""

    def __init__(self, k: int, queries: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[pa.Table] = []
        self.n = 0

    def add(self, scores: np.ndarray, ids: Sequence[pa.Array], which: np.ndarray | None = None) -> None:
        """scores: a row a query (of `which`, all if not given), a column a row of the table; -inf where a row isn't found."""
        which = np.arange(len(self.least)) if which is None else which
        slack = 2 * 10.0**-PLACES
        good = scores >= self.least[which, None] - slack
        if scores.shape[1] > self.k and np.count_nonzero(good) > 4 * self.k * len(which):
            # No row that is smaller than the k-th here can be among the best.
            good &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k, None] - slack
        q, d = np.nonzero(good & (scores > -np.inf))
        if not len(q):
            return
        found = scores[q, d]
        at = pa.array(d)
        columns = {"query": pa.array(which[q]), "place": pa.array(np.round(found, PLACES)), "score": pa.array(found), **{f"id{i}": x.take(at) for i, x in enumerate(ids)}}
        self.held.append(pa.table(columns))
        self.n += len(q)
        if self.n > 4 * self.k * len(self.least) + CELLS // 8:
            self.rows()

    def rows(self) -> pa.Table | None:
        """Columns query (its number), place, score, id0, ...; None if nothing was found."""
        if not self.held:
            return None
        rows = pa.concat_tables(self.held).combine_chunks()
        keys = [("query", "ascending"), ("place", "descending"), *((n, "ascending") for n in rows.column_names[3:])]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
        q = rows["query"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        rows = rows.filter(pa.array(rank < self.k))
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], rows["place"].to_numpy()[(rank[rank < self.k]) == self.k - 1])
        self.held, self.n = [rows], len(rows)
        return rows


def parted(ids: pa.Array) -> list[pa.Array]:
    """The columns that ids are compared by: those of a struct one by one."""
    return ids.flatten() if pa.types.is_struct(ids.type) else [ids]


def joined(rows: pa.Table, kind: pa.DataType) -> pa.Array:
    """The ids of Best's rows, of the kind that they had."""
    parts = [rows[n].combine_chunks() for n in rows.column_names[3:]]
    return pa.StructArray.from_arrays(parts, [f.name for f in kind]) if pa.types.is_struct(kind) else parts[0]


def hidden(rows: DataFrame, ids: Sequence[str], numbered: DataFrame, query_id: str, exclude: DataFrame | None) -> DataFrame:
    """The rows with OUT: numbers of the queries that aren't to find them, by `exclude`, rows (query_id, ids). numbered: rows (query_id, number)."""
    if exclude is None:
        return rows.withColumn(OUT, F.lit(None).cast("array<int>"))
    own = exclude.join(F.broadcast(numbered), query_id).groupBy(*ids).agg(F.collect_set("number").alias(OUT))
    return rows.join(bounded(own, MOST_BROADCAST), list(ids), "left")


def key_of(key: Column | None) -> Column:
    return (F.lit(None) if key is None else key).cast("string").alias(KEY)


def hide(scores: np.ndarray, keys: np.ndarray, own: pa.Array, out: pa.Array, by_key: bool, which: np.ndarray) -> None:
    """Sets to -inf what isn't to be found: rows whose key is the query's, or where either is null; rows whose OUT names the query. keys, which: of the queries of `scores`."""
    if by_key:
        asked = pa.array(keys, pa.string())
        codes = pc.fill_null(pc.index_in(own, value_set=pc.unique(asked.drop_null())), -1).to_numpy(zero_copy_only=False)
        of_query = pc.fill_null(pc.index_in(asked, value_set=pc.unique(asked.drop_null())), -2).to_numpy(zero_copy_only=False)
        scores[of_query[:, None] == codes[None, :]] = -np.inf
        scores[of_query == -2] = -np.inf
        scores[:, own.is_null().to_numpy(zero_copy_only=False)] = -np.inf
    if out.null_count < len(out):
        sizes = pc.fill_null(pc.list_value_length(out), 0).to_numpy(zero_copy_only=False)
        numbers = np.asarray(out.flatten(), np.int64)
        place = np.full(1 + max(numbers.max(initial=0), which.max(initial=0)), -1)
        place[which] = np.arange(len(which))
        here = place[numbers] >= 0
        scores[place[numbers][here], np.repeat(np.arange(len(out)), sizes)[here]] = -np.inf
