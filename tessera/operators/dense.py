"""Exact top-k by cosine, by blocks of matrix products where the vectors lie."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.operators.topk import CELLS, KEY, OUT, PLACES, Best, hidden, hide, key_of
from tessera.sources.shared import small_batches

#: Queries that one pass takes; more queries take more passes.
QUERY_BLOCK = 4096


def usable(vector: Column) -> Column:
    """A vector that has a direction: there, without null or non-finite components, not zero."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(vector, lambda c: c != 0), F.lit(False))


def top_k(scored: DataFrame, k: int, query_id: str, id_col: str) -> DataFrame:
    """Rows (query_id, rank, id_col, score): best first, ties to the smaller id."""
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, "rank", id_col, "score")


def search_dense(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding", exclude: DataFrame | None = None, apart: tuple[Column, Column] | None = None) -> DataFrame:
    """Rows (query_id, rank, id_col, score), scores rounded to 9 places. Vectors without a direction, or of another length than the query's, are not found.

    queries: rows (query_id, query_vector); QUERY_BLOCK of them go with the tasks of one pass, more take several passes. Every vector is
    scored where it lies, by matrix products, and k rows a query leave a task.
    exclude: rows (query_id, id_col) that are not to be found. apart: a key of the queries and one of the vectors; a query finds only
    vectors whose key is another than its own, and none where either is null.
    """
    small_batches(vectors.sparkSession)
    of_query, of_row = apart or (None, None)
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("_v"), key_of(of_row))
    asked = queries.where(usable(F.col(query_vector))).select(F.col(query_id), F.col(query_vector).cast("array<double>").alias("_v"), key_of(of_query))
    n = 1 + asked.count() // QUERY_BLOCK
    # Parts by a hash, half as large as the bound on average, so that none is above it.
    parts = [asked] if n == 1 else [asked.where(F.pmod(F.xxhash64("_v", F.col(query_id)), F.lit(2 * n)) == i) for i in range(2 * n)]
    shape = StructType([queries.schema[query_id], vectors.schema[id_col], StructField("score", DoubleType())])
    found = []
    for part in parts:
        block = part.toArrow().combine_chunks()
        numbered = vectors.sparkSession.createDataFrame([(q, i) for i, q in enumerate(block[query_id].to_pylist())], StructType([queries.schema[query_id], StructField("number", IntegerType())]))
        met = hidden(rows, [id_col], numbered, query_id, exclude).select(id_col, "_v", KEY, OUT)
        found.append(met.mapInArrow(_search(block, k, apart is not None), shape))
    return top_k(reduce(DataFrame.unionByName, found), k, query_id, id_col)


def search_dense_blocks(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, id_col, score) like search_dense, for queries whose ids are of the table: none finds itself."""
    asked = queries.select(F.col(id_col).alias("query_id"), vector_col)
    return search_dense(vectors, asked, k, id_col, vector_col, "query_id", vector_col, apart=(F.col("query_id"), F.col(id_col)))


def _unit(vectors: pa.Array, size: int) -> np.ndarray:
    x = np.asarray(vectors.flatten(), np.float64).reshape(-1, size)
    # By the largest component first, so that squares neither vanish nor overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _search(block: pa.Table, k: int, by_key: bool):
    keys = block.column(0).combine_chunks() if block.num_rows else None
    vectors = block.column(1).combine_chunks()
    own_keys = np.array(block.column(2).to_pylist(), object)
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    by_size = {int(n): (which := np.flatnonzero(sizes == n), _unit(vectors.take(pa.array(which)), int(n))) for n in np.unique(sizes)}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, len(sizes))
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for n, (which, asked) in by_size.items():
                of_size = np.flatnonzero(lengths == n)
                step = max(1, CELLS // len(which))
                for a in range(0, len(of_size), step):
                    part = batch.take(pa.array(of_size[a : a + step]))
                    scores = np.round(asked @ _unit(part.column(1), n).T, PLACES)
                    hide(scores, own_keys[which], part.column(2), part.column(3), by_key, which)
                    best.add(scores, [part.column(0)], which)
        rows = best.rows()
        if rows is not None:
            yield pa.RecordBatch.from_arrays([keys.take(rows["query"].combine_chunks()), rows["id0"].combine_chunks(), rows["score"].combine_chunks()], names=["q", "id", "score"])

    return search
