"""Weighted reciprocal-rank fusion of rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEPTH, CONSTANT, WEIGHTS = 20, 10, (2.0, 1.0)


def vote(weight, constant, rank):
    """A ranking's vote for what it ranks; none for what it doesn't."""
    return F.coalesce(weight / (constant + rank), F.lit(0.0))


def reciprocal_ranks(rankings: Sequence[DataFrame], query_id: str, id_col: str, constant: int = CONSTANT, weights: Sequence[float] | None = None) -> DataFrame:
    """Rows (query_id, id_col, score) of any number of rankings (query_id, id_col, rank); weights are 1 unless given."""
    weighted = [r.select(query_id, id_col, (F.lit(float(w)) / (constant + F.col("rank"))).alias("vote")) for r, w in zip(rankings, weights or [1.0] * len(rankings), strict=True)]
    return reduce(DataFrame.unionByName, weighted).groupBy(query_id, id_col).agg(F.sum("vote").alias("score"))


def fuse(first: DataFrame, second: DataFrame, k: int, query_id: str, id_col: str, constant: int = CONSTANT, weights: tuple[float, float] = WEIGHTS, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """Rows (query_id, rank, id_col, score) with rank and score of either ranking, null where it doesn't rank the row. Ties go to the first ranking, then the second."""
    sides = [r.select(query_id, id_col, F.col("rank").alias(f"{n}_rank"), F.col("score").alias(f"{n}_score")) for r, n in zip((first, second), names, strict=True)]
    both = sides[0].join(sides[1], [query_id, id_col], "full_outer")
    ranks = [F.col(f"{n}_rank") for n in names]
    scored = both.withColumn("score", vote(F.lit(weights[0]), constant, ranks[0]) + vote(F.lit(weights[1]), constant, ranks[1]))
    order = Window.partitionBy(query_id).orderBy(F.round("score", 12).desc(), *(r.asc_nulls_last() for r in ranks))
    columns = [f"{n}_{x}" for n in names for x in ("rank", "score")]
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, "rank", id_col, "score", *columns)


def fusion_grid(first: DataFrame, second: DataFrame, grid: DataFrame, k: int, query_id: str, id_col: str) -> DataFrame:
    """Rows (depth, constant, weight, query_id, rank, id_col, score) for every setting of `grid` (depth, constant, weight of the first ranking), in one query."""
    both = first.select(query_id, id_col, F.col("rank").alias("a")).join(second.select(query_id, id_col, F.col("rank").alias("b")), [query_id, id_col], "full_outer")
    tried = both.join(F.broadcast(grid), (F.col("a") <= F.col("depth")) | (F.col("b") <= F.col("depth")))
    seen = lambda r: F.when(F.col(r) <= F.col("depth"), F.col(r))
    scored = tried.withColumn("a", seen("a")).withColumn("b", seen("b"))
    scored = scored.withColumn("score", vote(F.col("weight"), F.col("constant"), F.col("a")) + vote(F.lit(1.0), F.col("constant"), F.col("b")))
    settings = ["depth", "constant", "weight"]
    order = Window.partitionBy(*settings, query_id).orderBy(F.round("score", 12).desc(), F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*settings, query_id, "rank", id_col, "score")
