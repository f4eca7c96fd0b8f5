"""Second-stage ranking, hits with where they came from, and retrievers by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.providers import Reranker, rerank_scores
from tessera.sources.shared import bounded, with_texts, written

#: Hits up to which they are broadcast to their chunks.
MOST_BROADCAST = 1_000_000
#: A retriever gives rows (query_id, rank, chunk_id, score, ...) for questions and a number of hits.
Retriever = Callable[[DataFrame, int], DataFrame]
PROVENANCE = ("dense_score", "dense_rank", "bm25_score", "bm25_rank", "rerank_score", "candidate_rank")


def rerank(candidates: DataFrame, questions: DataFrame, texts: DataFrame, provider: Reranker, k: int, depth: int, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """The first `depth` candidates a question in the order of the model's score, k of them; ties keep the candidates' order.

    candidate_rank tells where a hit stood before, rerank_score and score what the model gave. questions: (query_id, question); texts: (id_col, text).
    """
    first = candidates.where(F.col("rank") <= depth).withColumnRenamed("rank", "candidate_rank").drop("score")
    scored = rerank_scores(with_texts(first, texts, id_col).join(questions.select(query_id, "question"), query_id), provider)
    order = Window.partitionBy(query_id).orderBy(F.round("rerank_score", 9).desc(), "candidate_rank")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("score", F.col("rerank_score")).drop("question", "text")


def rerank_grid(candidates: DataFrame, questions: DataFrame, texts: DataFrame, provider: Reranker, k: int, depths: Sequence[int], query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """Rows (base, depth, query_id, rank, id_col, score) of every base's ranking reranked at every depth; a question's text is scored once, whatever the number of settings.

    candidates: rows (base, query_id, id_col, rank).
    """
    first = candidates.where(F.col("rank") <= max(depths)).select("base", query_id, id_col, F.col("rank").alias("candidate_rank"))
    pairs = with_texts(first.select(query_id, id_col).distinct(), texts, id_col).join(questions.select(query_id, "question"), query_id)
    scored = written(rerank_scores(pairs, provider, out="score").select(query_id, id_col, "score"), "rerank-scores")
    tried = first.join(scored, [query_id, id_col]).withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).where(F.col("candidate_rank") <= F.col("depth"))
    order = Window.partitionBy("base", "depth", query_id).orderBy(F.round("score", 9).desc(), "candidate_rank")
    return tried.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("base", "depth", query_id, "rank", id_col, "score")


def hits_of(ranked: DataFrame, chunks: DataFrame, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """The ranked rows with their chunk's document, pages, method and text, and every column of provenance: null where a retriever didn't rank the row."""
    found = written(ranked, "ranked")
    # Few hits, so that chunks stay where they lie.
    own = chunks.select(id_col, "doc", "page_start", "page_end", "method", "text").join(bounded(found, MOST_BROADCAST), id_col)
    kinds = {"score": "double", "rank": "int"}
    traces = [F.col(c) if c in ranked.columns else F.lit(None).cast(kinds[c.rsplit("_")[-1]]).alias(c) for c in PROVENANCE]
    return own.select(query_id, "rank", "score", id_col, "doc", "page_start", "page_end", "method", "text", *traces)


def search(retrievers: Mapping[str, Retriever], name: str, questions: DataFrame, k: int) -> DataFrame:
    """Hits of the retriever of that name; reranking retrievers are entries like any other."""
    if name not in retrievers:
        raise ValueError(f"unknown retriever {name!r}: one of {sorted(retrievers)}")
    return retrievers[name](questions, k)


def reranking(retrievers: Mapping[str, Retriever], base: str, texts: DataFrame, provider: Reranker, depth: int = 10, query_id: str = "query_id", id_col: str = "chunk_id") -> Retriever:
    """A retriever that reranks the first hits of another one."""
    if base not in retrievers:
        raise ValueError(f"unknown base {base!r}: one of {sorted(retrievers)}")
    return lambda questions, k: rerank(retrievers[base](questions, depth), questions, texts, provider, k, depth, query_id, id_col)
