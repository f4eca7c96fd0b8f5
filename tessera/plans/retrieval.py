"""Queries of lexical, dense and combined retrieval, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import providers
from tessera.functions import text as T
from tessera.operators import blockmax, dense, lexical
from tessera.operators.fusion import DEPTH, fuse, fusion_grid, reciprocal_ranks
from tessera.operators.rerank import hits_of, rerank, rerank_grid, reranking, search
from tessera.plans.fixtures import fixture, with_fixtures
from tessera.plans.texts import tokens_sql
from tessera.sources.shared import shared_path, written
from tessera.sources.tables import read_table

K, PLACES, RERANK_DEPTH = 5, 6, 10
DEPTHS = (5, 10, 20)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(read_table(spark, sf_dir, n) for n in ("documents", "benchmark", "embeddings"))


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, PLACES) for n in names or ("score",)})


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(read_table(spark, sf_dir, "documents"))


def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, and the average over all documents beside each."""
    docs = read_table(spark, sf_dir, "documents")
    return lexical.document_lengths(docs).crossJoin(F.broadcast(lexical.statistics(docs))).select("doc_id", "length", F.round("average", PLACES).alias("average"))


def inverse_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return _rounded(lexical.term_weights(lexical.postings(docs), lexical.statistics(docs)), "idf")


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items, _ = _tables(spark, sf_dir)
    return _rounded(lexical.search_bm25(docs, items, K))


def bm25_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the documents whose number ends as the item's does; counts are of all documents."""
    docs, items, _ = _tables(spark, sf_dir)
    return _rounded(lexical.search_bm25(docs, items, K, apart=(F.col("item_id") % 10, F.col("doc_id") % 10)))


def bm25_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over an index that is written first, in the shared folder, or in local mode without one in a folder of its own."""
    docs, items, _ = _tables(spark, sf_dir)
    path = shared_path(spark, "lexical")
    lexical.write_lexical_index(docs, path)
    return _rounded(lexical.search_lexical_index(spark, path, items, K))


def bm25_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bm25_search finds, over an index of blocks of which those without a hit aren't read."""
    docs, items, _ = _tables(spark, sf_dir)
    path = shared_path(spark, "blocks")
    blockmax.write_block_index(docs, path)
    return _rounded(blockmax.search_blocks(spark, path, items, K).hits)


def _asked(vectors: DataFrame, query_id: str = "query_id") -> DataFrame:
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias(query_id), "embedding")


def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector asks all others."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return _rounded(dense.search_dense(vectors, _asked(vectors), K, apart=(F.col("query_id"), F.col("vec_id"))))


def dense_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the vectors of the query's own label."""
    vectors = read_table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return _rounded(dense.search_dense(vectors, asked, K, apart=(F.col("label"), F.col("label"))))


def dense_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What dense_search finds, by blocks of matrix products."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return _rounded(dense.search_dense_blocks(vectors, vectors.where("vec_id % 50 = 0"), K))


def _rankings(spark: SparkSession, sf_dir: str, k: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Dense and BM25 rankings of documents for items. A document's vector is that of its number, and so is an item's."""
    docs, items, vectors = _tables(spark, sf_dir)
    of_docs = vectors.select(F.col("vec_id").alias("doc_id"), "embedding").join(docs.select("doc_id"), "doc_id", "left_semi")
    of_items = vectors.select(F.col("vec_id").alias("item_id"), "embedding").join(items.select("item_id"), "item_id", "left_semi")
    return dense.search_dense(of_docs, of_items, k, id_col="doc_id", query_id="item_id"), lexical.search_bm25(docs, items, k)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fuse(*_rankings(spark, sf_dir), K, "item_id", "doc_id", names=("dense", "bm25")), "score", "dense_score", "bm25_score")


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rankings of equal weight: dense, and BM25 of either tokenizer."""
    docs, items, _ = _tables(spark, sf_dir)
    found = [*_rankings(spark, sf_dir), lexical.search_bm25(docs, items, DEPTH, pattern="split")]
    return _rounded(reciprocal_ranks(found, "item_id", "doc_id"))


def fusion_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fusion_grid(*_rankings(spark, sf_dir), fixture(spark, sf_dir, "grid"), 3, "item_id", "doc_id"))


def _chunked(docs: DataFrame) -> DataFrame:
    """Documents as chunks of their own."""
    return docs.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("text_layer").alias("method"), "text")


def rerank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of the hybrid ranking, reranked by a stand-in that prefers long documents, with where they came from."""
    docs, items, _ = _tables(spark, sf_dir)
    first = fuse(*_rankings(spark, sf_dir), RERANK_DEPTH, "item_id", "doc_id", names=("dense", "bm25"))
    found = rerank(first, items.select("item_id", F.col("text").alias("question")), docs.select("doc_id", "text"), providers.LengthReranker(), K, RERANK_DEPTH, "item_id", "doc_id")
    hits = hits_of(found, _chunked(docs), "item_id", "doc_id").drop("text")
    return _rounded(hits, "score", "dense_score", "bm25_score", "rerank_score")


def rerank_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense, BM25 and hybrid rankings of the items, each reranked at three depths."""
    docs, items, _ = _tables(spark, sf_dir)
    dense_, bm25 = (written(r, "rankings") for r in _rankings(spark, sf_dir))
    bases = {"dense": dense_, "bm25": bm25, "hybrid": fuse(dense_, bm25, max(DEPTHS), "item_id", "doc_id")}
    rows = [r.select(F.lit(n).alias("base"), "item_id", "doc_id", "rank") for n, r in bases.items()]
    questions = items.select("item_id", F.col("text").alias("question"))
    found = rerank_grid(rows[0].unionByName(rows[1]).unionByName(rows[2]), questions, docs.select("doc_id", "text"), providers.LengthReranker(), K, DEPTHS, "item_id", "doc_id")
    return _rounded(found)


def named_retrievers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every retriever of a registry, under its name."""
    docs, items, vectors = _tables(spark, sf_dir)
    of_docs = vectors.select(F.col("vec_id").alias("doc_id"), "embedding").join(docs.select("doc_id"), "doc_id", "left_semi")

    def by_vector(asked: DataFrame, k: int) -> DataFrame:
        return dense.search_dense(of_docs, asked.join(vectors.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id"), k, "doc_id", query_id="item_id")

    retrievers = {"dense": by_vector, "bm25": lambda asked, k: lexical.search_bm25(docs, asked, k, query_text="question")}
    retrievers["rerank"] = reranking(retrievers, "dense", docs.select("doc_id", "text"), providers.LengthReranker(), RERANK_DEPTH, "item_id", "doc_id")
    asked = items.select("item_id", F.col("text").alias("question"))
    parts = [search(retrievers, name, asked, K).select(F.lit(name).alias("retriever"), "item_id", "rank", "doc_id", "score") for name in ("dense", "bm25", "rerank")]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def embedded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of a stand-in that counts letters, each distinct text embedded once; three components of each."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    found = providers.embed_questions(items, providers.LetterEmbedder())
    return found.select("item_id", *(F.round(F.col("embedding")[i].cast("double"), 5).alias(f"x{i}") for i in (0, 4, 14)))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


QUERIES = {f.__name__: f for f in (term_frequencies, document_lengths, inverse_frequencies, bm25_search, bm25_excluded, bm25_index_search, bm25_block_search, dense_search, dense_excluded, dense_block_search, hybrid_search, rank_fusion, fusion_sweep, rerank_search, rerank_sweep, named_retrievers, embedded_items, previews)}


def bm25_sql(pattern: str, k: int, p: str = "", question: str = "text", where: str = "true") -> str:
    """Common table expressions ending in {p}ranked."""
    return f"""{p}tok as (select doc_id, {tokens_sql(pattern)} as t from documents),
    {p}post as (select doc_id, term, count(*) as tf, max(length) as length from (select doc_id, len(t) as length, unnest(t) as term from {p}tok) group by all),
    {p}idf as (select term, count(*) as df, ln(1 + ((select count(*) from documents) - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf from {p}post group by term),
    {p}ask as (select item_id, term, count(*) as asked from (select item_id, unnest({tokens_sql(pattern, question)}) as term from benchmark) group by all),
    {p}sc as (select item_id, doc_id, sum(asked * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * length / (select avg(len(t)) from {p}tok)))) as score from {p}ask join {p}idf using (term) join {p}post using (term) group by all),
    {p}ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from {p}sc where {where} qualify rank <= {k})"""


def _dense_sql(where: str) -> str:
    cosine = "round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9)"
    return f"""hits as (select q.vec_id as query_id, v.vec_id, {cosine} as score, row_number() over (partition by q.vec_id order by {cosine} desc, v.vec_id) as rank
    from embeddings q join embeddings v on q.vec_id % 50 = 0 and {where} qualify rank <= {K})"""


def rankings_sql(k: int = DEPTH) -> str:
    """Common table expressions ending in d and b: dense and BM25 rankings."""
    cosine = "round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9)"
    return f"""{bm25_sql("keep", k, "b_")}, b as (select * from b_ranked),
    d as (select q.vec_id as item_id, v.vec_id as doc_id, {cosine} as score, row_number() over (partition by q.vec_id order by {cosine} desc, v.vec_id) as rank
    from embeddings q join embeddings v on q.vec_id in (select item_id from benchmark) and v.vec_id in (select doc_id from documents) qualify rank <= {k})"""


_BOTH = "select coalesce(d.item_id, b.item_id) as item_id, coalesce(d.doc_id, b.doc_id) as doc_id, d.rank::int as dense_rank, d.score as dense_score, b.rank::int as bm25_rank, b.score as bm25_score from d full join b on d.item_id = b.item_id and d.doc_id = b.doc_id"


def fused_sql(k: int) -> str:
    """Common table expressions ending in fused."""
    return f"""{rankings_sql()}, f as (select *, coalesce(2::double / (10 + dense_rank), 0) + coalesce(1::double / (10 + bm25_rank), 0) as score from ({_BOTH})),
    fused as (select *, (row_number() over (partition by item_id order by round(score, 12) desc, dense_rank nulls last, bm25_rank nulls last))::int as rank from f qualify rank <= {k})"""


_SIGMOID = "1 / (1 + exp(-((length(text) - 2000) / 1000::double)))"
_RERANKED = f"""reranked as (select item_id, (row_number() over (partition by item_id order by round(rs, 9) desc, candidate_rank))::int as rank, rs, doc_id, candidate_rank, dense_rank, dense_score, bm25_rank, bm25_score
from (select f.* exclude (rank, score), f.rank as candidate_rank, {_SIGMOID} as rs from fused f join documents using (doc_id)) qualify rank <= {K})"""
_LETTERS = [f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))" for c in "abcdefghijklmnop"]
_LENGTH = f"sqrt({' + '.join(f'{x} * {x}' for x in _LETTERS)})"

ORACLES = {
    "term_frequencies": f"with {bm25_sql('keep', K)} select doc_id, term, tf, length::int as length from post",
    "document_lengths": f"with t as (select doc_id, len({tokens_sql('keep')})::int as length from documents) select doc_id, length, round((select avg(length) from t), 6) as average from t",
    "inverse_frequencies": f"with {bm25_sql('keep', K)} select term, df, round(idf, 6) as idf from idf",
    "bm25_search": f"with {bm25_sql('keep', K)} select item_id, rank::int as rank, doc_id, round(score, 6) as score from ranked",
    "bm25_index_search": f"with {bm25_sql('keep', K)} select item_id, rank::int as rank, doc_id, round(score, 6) as score from ranked",
    "bm25_block_search": f"with {bm25_sql('keep', K)} select item_id, rank::int as rank, doc_id, round(score, 6) as score from ranked",
    "bm25_excluded": f"with {bm25_sql('keep', K, where='doc_id % 10 <> item_id % 10')} select item_id, rank::int as rank, doc_id, round(score, 6) as score from ranked",
    "dense_search": f"with {_dense_sql('q.vec_id <> v.vec_id')} select query_id, rank::int as rank, vec_id, round(score, 6) as score from hits",
    "dense_block_search": f"with {_dense_sql('q.vec_id <> v.vec_id')} select query_id, rank::int as rank, vec_id, round(score, 6) as score from hits",
    "dense_excluded": f"with {_dense_sql('q.label <> v.label')} select query_id, rank::int as rank, vec_id, round(score, 6) as score from hits",
    "hybrid_search": f"with {fused_sql(K)} select item_id, rank, doc_id, round(score, 6) as score, dense_rank, round(dense_score, 6) as dense_score, bm25_rank, round(bm25_score, 6) as bm25_score from fused",
    "rank_fusion": f"""with {rankings_sql()}, {bm25_sql("split", DEPTH, "s_")} select item_id, doc_id, round(sum(1::double / (10 + rank)), 6) as score from (select item_id, doc_id, rank from d union all select item_id, doc_id, rank from b union all select item_id, doc_id, rank from s_ranked) group by item_id, doc_id""",
    "fusion_sweep": f"""with {with_fixtures('grid')}, {rankings_sql()}, x as (select g.*, item_id, doc_id, case when dense_rank <= depth then dense_rank end as a, case when bm25_rank <= depth then bm25_rank end as b from ({_BOTH}) cross join grid g),
    s as (select *, coalesce(weight / (constant + a), 0) + coalesce(1::double / (constant + b), 0) as score from x where a is not null or b is not null)
    select depth, constant, weight, item_id, (row_number() over (partition by depth, constant, weight, item_id order by round(score, 12) desc, a nulls last, b nulls last))::int as rank, doc_id, round(score, 6) as score from s qualify rank <= 3""",
    "rerank_search": f"""with {fused_sql(RERANK_DEPTH)}, {_RERANKED} select item_id, rank, round(rs, 6) as score, doc_id, 'doc-' || doc_id::varchar as doc, 1 as page_start, 1 as page_end, 'text_layer' as method,
    round(dense_score, 6) as dense_score, dense_rank, round(bm25_score, 6) as bm25_score, bm25_rank, round(rs, 6) as rerank_score, candidate_rank from reranked""",
    "rerank_sweep": f"""with {fused_sql(max(DEPTHS))}, c as (select 'dense' as base, item_id, doc_id, rank from d union all select 'bm25', item_id, doc_id, rank from b union all select 'hybrid', item_id, doc_id, rank from fused),
    t as (select c.*, depth, {_SIGMOID} as rs from c join (values {', '.join(f'({x})' for x in DEPTHS)}) as v(depth) on rank <= depth join documents using (doc_id))
    select base, depth, item_id, (row_number() over (partition by base, depth, item_id order by round(rs, 9) desc, before))::int as rank, doc_id, round(rs, 6) as score from (select * rename (rank as before) from t) qualify rank <= {K}""",
    "named_retrievers": f"""with {rankings_sql(RERANK_DEPTH)}, r as (select item_id, doc_id, rs, row_number() over (partition by item_id order by round(rs, 9) desc, before) as rank from (select item_id, doc_id, d.rank as before, {_SIGMOID} as rs from d join documents using (doc_id)) qualify rank <= {K})
    select 'dense' as retriever, item_id, rank::int as rank, doc_id, round(score, 6) as score from d where rank <= {K} union all select 'bm25', item_id, rank::int, doc_id, round(score, 6) from b where rank <= {K} union all select 'rerank', item_id, rank::int, doc_id, round(rs, 6) from r""",
    "embedded_items": f"select item_id, {', '.join(f'round(({_LETTERS[i]} / {_LENGTH})::float::double, 5) as x{i}' for i in (0, 4, 14))} from benchmark",
    "previews": "select doc_id, case when length(text) > 300 then left(text, 300) || '…' else text end as preview from documents",
}
