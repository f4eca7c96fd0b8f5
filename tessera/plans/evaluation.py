"""Queries of golden sets, retrieval metrics, refusals and recognition, with the SQL that gives the same rows.

The golden set is made of the benchmark: a question is an item's first twelve tokens, its anchors are the documents that hold the
item's whole text, its language is that of the smallest of them, and its category tells how many there are. Items that no document
holds are to be refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import golden, metrics, recognition
from tessera.operators.chunk_search import chunk_text, search_chunks
from tessera.operators.containment import MOST_BROADCAST, containing
from tessera.operators.dense import search_dense
from tessera.operators.lexical import search_bm25
from tessera.plans.fixtures import fixture, with_fixtures
from tessera.plans.retrieval import bm25_sql
from tessera.plans.texts import chunks_of_size_sql, numbers_sql, tokens_sql
from tessera.sources.shared import bounded, with_texts, written
from tessera.sources.tables import read_table

K, DEPTH, PLACES = 5, 10, 6
#: Sizes of chunks that are tried, with their overlaps.
GRID = tuple((target, overlap) for target in (600, 800, 1000, 1200) for overlap in (100, 150, 200))


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, PLACES) for n in names})


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.array_join(F.slice(T.tokens(F.col("text")), 1, 12), " ").alias("question"), F.col("text").alias("quote"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (item_id, doc_id, lang, quote): the documents that hold an item's whole text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return containing(docs, items, ["doc_id"]).join(items, "quote").select("item_id", "doc_id", "lang", "quote")


def golden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _anchors(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"), F.min_by("lang", "doc_id").alias("lang"))
    rows = _questions(spark, sf_dir).join(held, "item_id", "left")
    category = F.when(F.col("n").isNull(), "unanswerable").when(F.col("n") > 1, "multi_doc").otherwise("single_doc")
    return rows.select("item_id", "question", F.when(F.col("n").isNull(), "refuse").otherwise("answer").alias("expected"), category.alias("category"), F.coalesce("lang", F.lit("??")).alias("lang"))


def _hits(spark: SparkSession, sf_dir: str, pattern: str = "keep") -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = search_bm25(docs, _questions(spark, sf_dir), DEPTH, query_text="question", pattern=pattern)
    return with_texts(found, docs, "doc_id").withColumnRenamed("doc_id", "doc")


def _ranked(spark: SparkSession, sf_dir: str, pattern: str = "keep") -> DataFrame:
    anchors = _anchors(spark, sf_dir).select("item_id", F.col("doc_id").alias("doc"), "quote")
    return metrics.anchor_ranks(anchors, _hits(spark, sf_dir, pattern), "item_id")


def anchor_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("item_id", "doc", "rank")


def missing_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.missing_anchors(_ranked(spark, sf_dir), K).select("item_id", "doc")


def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.recall_curve(_ranked(spark, sf_dir), query_id="item_id")
    return _rounded(curve, *(f"recall_{k}" for k in metrics.CURVE))


def _measured(anchors: DataFrame, hits: DataFrame) -> DataFrame:
    """Recall, precision and reciprocal rank of each answerable question."""
    recall = metrics.recall_curve(metrics.anchor_ranks(anchors, hits, "item_id"), (K,), "item_id").withColumnRenamed(f"recall_{K}", "recall")
    relevant = metrics.ranking_metrics(metrics.relevant_hits(hits, anchors, "item_id"), K, "item_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return recall.join(relevant, "item_id", "left").select("item_id", "recall", zero("precision"), zero("reciprocal_rank"), "first_rank")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors (item_id, doc, quote), worked out once."""
    return written(_anchors(spark, sf_dir).select("item_id", F.col("doc_id").alias("doc"), "quote"), "anchors")


def _per_question(spark: SparkSession, sf_dir: str, pattern: str = "keep") -> DataFrame:
    return _measured(_held(spark, sf_dir), written(_hits(spark, sf_dir, pattern), "hits"))


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_per_question(spark, sf_dir), "recall", "precision", "reciprocal_rank")


def recall_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all questions, by language and by category."""
    rows = _per_question(spark, sf_dir).join(golden_set(spark, sf_dir).select("item_id", "lang", "category"), "item_id")
    return _rounded(metrics.grouped_means(rows, ("lang", "category"), ("recall", "precision", "reciprocal_rank")), "recall", "precision", "reciprocal_rank")


def chosen_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall over a fixed list of questions."""
    return _rounded(metrics.mean_of(_per_question(spark, sf_dir), "recall", (1, 3, 5, 7, 11), "item_id"), "recall")


def tokenizer_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose reciprocal rank differs between the two tokenizers."""
    anchors = _held(spark, sf_dir)
    split, keep = (_measured(anchors, written(_hits(spark, sf_dir, p), "hits")) for p in ("split", "keep"))
    return _rounded(metrics.paired_difference(split, keep, "reciprocal_rank", "item_id"), "before", "after", "difference")


def retriever_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose reciprocal rank differs between the ranking by the vectors of their numbers and BM25."""
    anchors, docs, vectors = _held(spark, sf_dir), read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "embeddings")
    of_docs = vectors.select(F.col("vec_id").alias("doc"), "embedding").join(docs.select(F.col("doc_id").alias("doc")), "doc", "left_semi")
    of_items = vectors.select(F.col("vec_id").alias("item_id"), "embedding").join(read_table(spark, sf_dir, "benchmark").select("item_id"), "item_id", "left_semi")
    found = search_dense(of_docs, of_items, DEPTH, id_col="doc", query_id="item_id")
    dense = written(with_texts(found, docs.select(F.col("doc_id").alias("doc"), "text"), "doc"), "hits")
    changed = metrics.paired_difference(_measured(anchors, dense), _measured(anchors, written(_hits(spark, sf_dir), "hits")), "reciprocal_rank", "item_id")
    return _rounded(changed, "before", "after", "difference")


def _chunk_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (target, overlap, chunks, recall, reciprocal_rank): for every size of chunks, what BM25 finds of the anchors among its first K chunks."""
    docs = read_table(spark, sf_dir, "documents")
    sizes, found = search_chunks(docs, _questions(spark, sf_dir), K, GRID, query_text="question")
    anchors = _held(spark, sf_dir)
    key = ["target", "overlap", "item_id", "doc", "quote"]
    # Only chunks of documents that are anchors of their question can hold what it asks; their documents are normalised once each.
    near = written(found.withColumn("doc", F.col("chunk.doc_id")).join(anchors, ["item_id", "doc"]).select(*key, "rank", "chunk"), "near")
    bodies = docs.select(F.col("doc_id").alias("doc"), "text").join(bounded(near.select("doc").distinct(), MOST_BROADCAST), "doc", "left_semi").select("doc", T.normalize(F.col("text")).alias("body"))
    held = near.join(bodies, "doc").where(chunk_text(F.col("body"), F.col("chunk")).contains(F.col("quote"))).groupBy(*key).agg(F.min("rank").alias("rank"))
    tried = anchors.crossJoin(F.broadcast(spark.createDataFrame(list(GRID), "target int, overlap int")))
    ranked = tried.join(held, key, "left").select(*key, "rank").distinct()
    per = ranked.groupBy("target", "overlap", "item_id").agg(F.avg(F.col("rank").isNotNull().cast("int")).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))
    means = per.groupBy("target", "overlap").agg(F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("reciprocal_rank"))
    return sizes.join(means, ["target", "overlap"], "left")


def chunk_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every size of chunks with what is found, and which is best: by recall, then by reciprocal rank, of equals the first of the grid."""
    rates = written(_rounded(_chunk_rates(spark, sf_dir), "recall", "reciprocal_rank"), "rates")
    placed = rates.withColumn("place", F.col("target") * 1000 + F.col("overlap"))
    best = metrics.best_by(placed.withColumn("name", F.struct("target", "overlap")), "name", "place", "recall", "reciprocal_rank")
    # One row.
    return rates.crossJoin(F.broadcast(best.select("name"))).select(*rates.columns, (F.struct("target", "overlap") == F.col("name")).alias("best"))


def _vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("wanted"))
    found = search_dense(vectors, asked, K, apart=(F.col("query_id"), F.col("vec_id")))
    return found.join(vectors.select("vec_id", "label"), "vec_id").join(asked.select("query_id", "wanted"), "query_id").withColumn("relevant", F.col("label") == F.col("wanted"))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hits are relevant where they share the query's label."""
    return _rounded(metrics.ranking_metrics(_vector_hits(spark, sf_dir), K), "precision", "reciprocal_rank")


def _abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top score of each question, and whether it is to be answered."""
    asked = golden_set(spark, sf_dir)
    return metrics.top_scores(asked, _hits(spark, sf_dir), "item_id").join(asked.select("item_id", "expected"), "item_id")


def top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_abstention(spark, sf_dir), "top_score")


def score_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overlap(_abstention(spark, sf_dir), F.col("expected") == "answer", F.round("top_score", 9))


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.summary(_abstention(spark, sf_dir), F.col("top_score")), "least", "mean", "median", "most")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")


def score_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.auc(_judged(spark, sf_dir), F.col("quality") == 1, F.col("n_chars")), "auc")


def threshold_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_judged(spark, sf_dir), F.col("quality") == 1, F.col("n_chars"), 1000)


def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.best_thresholds(_judged(spark, sf_dir), F.col("quality") == 1, F.col("n_chars")), "accuracy")


def paired_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.paired_auc(fixture(spark, sf_dir, "paired_scores"), F.col("expected") == "answer", F.col("rerank_score"), F.col("cosine_score")), "auc_first", "auc_second", "delta")


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.paired_bootstrap(fixture(spark, sf_dir, "paired_scores"), F.col("expected") == "answer", F.col("rerank_score"), F.col("cosine_score"), F.col("id")), "low", "high")


def answer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.answer_labels(fixture(spark, sf_dir, "results")).select("id", "label", "stage")


def abstention_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.abstention_matrix(metrics.answer_labels(fixture(spark, sf_dir, "results")))


def answer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the questions to be answered, those answered rightly, by language; and the latency's median and greatest value."""
    rows = fixture(spark, sf_dir, "results")
    right = F.coalesce("content_ok", F.lit(False))
    return rows.groupBy("lang").agg(*metrics.rate(right, F.col("expected") == "answer"), F.percentile("latency", F.lit(0.5)).alias("median_latency"), F.max("latency").alias("most_latency"))


def judge_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.judge_report(fixture(spark, sf_dir, "results").withColumn("det_ok", F.coalesce("content_ok", F.lit(False))), "category")


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content and citations of answers; quotes without numbers must stand there word for word."""
    return golden.answer_checks(fixture(spark, sf_dir, "given_answers"), fixture(spark, sf_dir, "anchors"), fixture(spark, sf_dir, "cited"), fuzzy=False)


def quote_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a fuzzy measure of words."""
    return golden.answer_checks(fixture(spark, sf_dir, "given_answers"), fixture(spark, sf_dir, "anchors"), fixture(spark, sf_dir, "cited"))


def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each item, in order, and of its canonical text the length."""
    items = read_table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.array_join(F.array_sort(T.numbers(F.col("text"))), " ").alias("numbers"), F.length(T.canonical(F.col("text"))).alias("length"))


def anchor_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.anchor_status(fixture(spark, sf_dir, "anchors"), fixture(spark, sf_dir, "pages_read"), fuzzy=False)


def index_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.index_status(fixture(spark, sf_dir, "anchors"), fixture(spark, sf_dir, "chunks_read"))


def anchor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of every document of the golden set, and documents without any."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return golden.coverage(docs, _anchors(spark, sf_dir).withColumnRenamed("item_id", "id"), "doc_id")


def remapped_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.remapped(fixture(spark, sf_dir, "anchors"), ("rules", "other"), "rules-v2").select("id", "place", "doc")


def turkish_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "pages_read").select("doc", "page_no", T.turkish_lower(F.col("text")).alias("text"), T.occurrences(F.col("text"), F.lit("e")).alias("n"))


def character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate of every reading of an item's whole text, both sides normalised."""
    pairs = fixture(spark, sf_dir, "runs").join(fixture(spark, sf_dir, "truths"), "doc")
    return pairs.select("method", "doc", F.round(T.error_rate(T.normalize(F.col("text")), T.normalize(F.col("reference"))), PLACES).alias("cer"))


def method_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = recognition.scored_runs(*(fixture(spark, sf_dir, n) for n in ("runs", "truths", "languages", "elapsed")))
    return _rounded(recognition.method_ranking(scored), "cer_tr", "cer_en", "worst", "seconds")


def reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.reference_texts(*(fixture(spark, sf_dir, n) for n in ("compared", "manual", "overrides", "pages_read")))


def best_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_by(fixture(spark, sf_dir, "settings"), "name", "place", "tr", "cross_lingual", "mrr")


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.repeated_summary(fixture(spark, sf_dir, "latencies"), "pair", "seconds")


QUERIES = {f.__name__: f for f in (golden_set, anchor_ranks, missing_anchors, recall_curve, retrieval_recall, recall_groups, chosen_recall, tokenizer_differences, retriever_differences, chunk_sweep, retrieval_metrics, top_scores, score_overlap, score_summary, score_auc, threshold_confusion, threshold_search, paired_scores, bootstrap_interval, answer_labels, abstention_matrix, answer_rates, judge_reports, answer_checks, quote_likeness, canonical_numbers, anchor_statuses, index_statuses, anchor_coverage, remapped_anchors, turkish_folding, character_errors, method_ranking, reference_texts, best_setting, latency_summary)}

_QUESTIONS = f"benchmark_ as (select item_id, array_to_string(({tokens_sql('keep')})[1:12], ' ') as question, text as quote from benchmark)"
_ANCHORS = "anchored as (select b.item_id, d.doc_id, d.lang, b.text as quote from documents d join benchmark b on contains(d.text, b.text))"
_GOLDEN = f"""{_QUESTIONS}, {_ANCHORS}, counted as (select item_id, count(*) as n, arg_min(lang, doc_id) as lang from anchored group by item_id),
golden as (select item_id, question, case when n is null then 'refuse' else 'answer' end as expected, case when n is null then 'unanswerable' when n > 1 then 'multi_doc' else 'single_doc' end as category, coalesce(lang, '??') as lang from benchmark_ left join counted using (item_id))"""


def _hits_sql(p: str, pattern: str) -> str:
    """Common table expressions ending in {p}hits: BM25 hits of the questions, with the text."""
    found = bm25_sql(pattern, DEPTH, p, question="question").replace("from benchmark)", "from benchmark_)")
    return f"{found}, {p}hits as (select r.item_id, r.doc_id, r.rank, r.score, d.text from {p}ranked r join documents d using (doc_id))"


def _measured_sql(p: str, pattern: str) -> str:
    """Common table expressions ending in {p}measured."""
    return f"{_hits_sql(p, pattern)}, {_rates_sql(p)}"


def _rates_sql(p: str) -> str:
    """From {p}hits to {p}measured."""
    return f"""{p}at as (select a.item_id, a.doc_id, min(h.rank)::int as rank from anchored a left join {p}hits h on h.item_id = a.item_id and h.doc_id = a.doc_id group by a.item_id, a.doc_id),
    {p}rel as (select h.item_id, h.rank, exists (select 1 from anchored a where a.item_id = h.item_id and a.doc_id = h.doc_id) as relevant from {p}hits h),
    {p}prec as (select item_id, count(*) filter (relevant and rank <= {K}) / {K}::double as precision, coalesce(1::double / min(rank) filter (relevant and rank <= {K}), 0) as reciprocal_rank, (min(rank) filter (relevant))::int as first_rank from {p}rel group by item_id),
    {p}measured as (select item_id, recall, coalesce(precision, 0) as precision, coalesce(reciprocal_rank, 0) as reciprocal_rank, first_rank from (select item_id, avg(coalesce(rank <= {K}, false)::int) as recall from {p}at group by item_id) left join {p}prec using (item_id))"""


def _dense_measured_sql() -> str:
    """Common table expressions ending in v_measured: the ranking by vectors."""
    cosine = "round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9)"
    return f"""v_hits as (select q.vec_id as item_id, v.vec_id as doc_id, row_number() over (partition by q.vec_id order by {cosine} desc, v.vec_id) as rank, d.text
    from embeddings q join embeddings v on q.vec_id in (select item_id from benchmark) join documents d on d.doc_id = v.vec_id qualify rank <= {DEPTH}), {_rates_sql('v_')}"""


def _sweep_sql() -> str:
    """Common table expressions ending in rates: every setting's chunks by the recursive fold, and their BM25."""
    part = " union all by name ".join(f"select {t} as target, {o} as overlap, * from ({chunks_of_size_sql(t, o)})" for t, o in GRID)
    words = tokens_sql("keep")
    return f"""{_GOLDEN}, cut as materialized (select target, overlap, doc_id, ordinal, text from ({part})),
    cut_tok as (select target, overlap, doc_id, ordinal, {words} as t from cut),
    cut_all as (select target, overlap, count(*) as n, avg(len(t)) as average from cut_tok group by target, overlap),
    cut_post as (select target, overlap, doc_id, ordinal, term, count(*) as tf, max(length) as length from (select target, overlap, doc_id, ordinal, len(t) as length, unnest(t) as term from cut_tok) group by all),
    cut_idf as (select target, overlap, term, ln(1 + (any_value(n) - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf, any_value(average) as average from cut_post join cut_all using (target, overlap) group by target, overlap, term),
    cut_ask as (select item_id, term, count(*) as asked from (select item_id, unnest({tokens_sql('keep', 'question')}) as term from benchmark_) group by all),
    cut_hits as (select target, overlap, item_id, doc_id, ordinal, row_number() over (partition by target, overlap, item_id order by round(score, 9) desc, doc_id, ordinal) as rank from (
        select target, overlap, item_id, doc_id, ordinal, sum(asked * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * length / average))) as score from cut_ask join cut_idf using (term) join cut_post using (target, overlap, term) group by all) qualify rank <= {K}),
    cut_found as (select h.*, c.text from cut_hits h join cut c using (target, overlap, doc_id, ordinal)),
    cut_at as (select s.target, s.overlap, a.item_id, a.doc_id, min(case when contains(h.text, a.quote) then h.rank end) as rank from anchored a cross join cut_all s left join cut_found h on h.target = s.target and h.overlap = s.overlap and h.item_id = a.item_id and h.doc_id = a.doc_id group by all),
    cut_per as (select target, overlap, item_id, avg((rank is not null)::int) as recall, coalesce(1::double / min(rank), 0) as reciprocal_rank from cut_at group by all),
    rates as (select target, overlap, n as chunks, round(avg(recall), 6) as recall, round(avg(reciprocal_rank), 6) as reciprocal_rank from cut_all left join cut_per using (target, overlap) group by all)"""


_MEASURED = f"{_GOLDEN}, {_measured_sql('k_', 'keep')}"
_TOP = f"{_GOLDEN}, {_hits_sql('k_', 'keep')}, tops as (select item_id, expected, coalesce(score, 0) as top_score from golden left join (select item_id, score from k_hits where rank = 1) using (item_id))"
_COSINE = "round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9)"
_DENSE = f"hits as (select q.vec_id as query_id, q.label = v.label as relevant, row_number() over (partition by q.vec_id order by {_COSINE} desc, v.vec_id) as rank from embeddings q join embeddings v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id qualify rank <= {K})"
_JUDGED = "judged as (select quality, n_chars from labels join documents using (doc_id))"
_LABEL = "case when expected = 'refuse' and not refused then 'fabricated' when expected = 'refuse' then 'correct_refusal' when refused then 'needless_refusal' when coalesce(content_ok, false) then 'correct' else 'wrong' end"
_STAGE = "case when refused then case when gated then 'stage1' else 'stage2' end end"
_LABELLED = f"labelled as (select *, {_LABEL} as label, {_STAGE} as stage from results)"
_CANON = r"trim(regexp_replace(regexp_replace(lower({0}), '(\d)[.,](\d)', '\1.\2', 'g'), '\s+', ' ', 'g'))"
_TR = "lower(translate({0}, 'Iİ', 'ıi'))"
_CER = "levenshtein(text, reference) / greatest(length(reference), 1)::double"

ORACLES = {
    "golden_set": f"with {_GOLDEN} select * from golden",
    "anchor_ranks": f"with {_MEASURED} select item_id, doc_id as doc, rank from k_at",
    "missing_anchors": f"with {_MEASURED} select item_id, doc_id as doc from k_at where coalesce(rank > {K}, true)",
    "recall_curve": f"with {_MEASURED} select item_id, {', '.join(f'round(avg(coalesce(rank <= {k}, false)::int), 6) as recall_{k}' for k in metrics.CURVE)} from k_at group by item_id",
    "retrieval_recall": f"with {_MEASURED} select item_id, round(recall, 6) as recall, round(precision, 6) as precision, round(reciprocal_rank, 6) as reciprocal_rank, first_rank from k_measured",
    "recall_groups": f"with {_MEASURED} select lang, category, count(*) as n, round(coalesce(avg(recall), 0), 6) as recall, round(coalesce(avg(precision), 0), 6) as precision, round(coalesce(avg(reciprocal_rank), 0), 6) as reciprocal_rank from k_measured join golden using (item_id) group by grouping sets ((), (lang), (category))",
    "chosen_recall": f"with {_MEASURED} select round(coalesce(avg(recall) filter (item_id in (1, 3, 5, 7, 11)), 0), 6) as recall from k_measured",
    "tokenizer_differences": f"with {_MEASURED}, {_measured_sql('s_', 'split')} select item_id, round(s.reciprocal_rank, 6) as before, round(k.reciprocal_rank, 6) as after, round(k.reciprocal_rank - s.reciprocal_rank, 6) as difference from s_measured s join k_measured k using (item_id) where abs(k.reciprocal_rank - s.reciprocal_rank) > 1e-9",
    "retriever_differences": f"with {_MEASURED}, {_dense_measured_sql()} select item_id, round(v.reciprocal_rank, 6) as before, round(k.reciprocal_rank, 6) as after, round(k.reciprocal_rank - v.reciprocal_rank, 6) as difference from v_measured v join k_measured k using (item_id) where abs(k.reciprocal_rank - v.reciprocal_rank) > 1e-9",
    "chunk_sweep": f"with {_sweep_sql()} select *, row_number() over (order by recall desc, reciprocal_rank desc, target, overlap) = 1 as best from rates",
    "retrieval_metrics": f"with {_DENSE} select query_id, round(count(*) filter (relevant) / {K}::double, 6) as precision, round(coalesce(1::double / min(rank) filter (relevant), 0), 6) as reciprocal_rank, (min(rank) filter (relevant))::int as first_rank from hits group by query_id",
    "top_scores": f"with {_TOP} select item_id, expected, round(top_score, 6) as top_score from tops",
    "score_overlap": f"with {_TOP} select count(*) filter (expected <> 'answer' and round(top_score, 9) >= (select min(round(top_score, 9)) from tops where expected = 'answer')) as overlap from tops",
    "score_summary": f"with {_TOP} select round(min(top_score), 6) as least, round(avg(top_score), 6) as mean, round(median(top_score), 6) as median, round(max(top_score), 6) as most from tops",
    "score_auc": f"with {_JUDGED}, r as (select quality, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2::double as rk from judged) select count(*) filter (quality = 1) as n_pos, count(*) filter (quality = 0) as n_neg, round((sum(rk) filter (quality = 1) - count(*) filter (quality = 1) * (count(*) filter (quality = 1) + 1) / 2::double) / (count(*) filter (quality = 1) * count(*) filter (quality = 0)), 6) as auc from r",
    "threshold_confusion": f"with {_JUDGED} select count(*) filter (quality = 1 and n_chars >= 1000) as true_accept, count(*) filter (quality <> 1 and n_chars >= 1000) as false_accept, count(*) filter (quality = 1 and n_chars < 1000) as false_refuse, count(*) filter (quality <> 1 and n_chars < 1000) as true_refuse from judged",
    "threshold_search": f"""with {_JUDGED}, t as (select distinct n_chars::double as s from judged), a as (select s, (select count(*) filter ((quality = 1) = (n_chars >= s)) / count(*)::double from judged) as accuracy from t)
    select arg_max(s, (accuracy, -s)) as threshold, round(max(accuracy), 6) as accuracy, (select max(n_chars) from judged where quality = 0)::double + 1e-9 as no_false_accept from a""",
    "paired_scores": f"""with {with_fixtures('paired_scores')}, p as (select case when a.rerank_score > b.rerank_score then 1 when a.rerank_score = b.rerank_score then 0.5 else 0 end::double as x, case when a.cosine_score > b.cosine_score then 1 when a.cosine_score = b.cosine_score then 0.5 else 0 end::double as y from paired_scores a, paired_scores b where a.expected = 'answer' and b.expected = 'refuse')
    select round(avg(x), 6) as auc_first, round(avg(y), 6) as auc_second, round(avg(x) - avg(y), 6) as delta, count(*) filter (x = 1 and y < 1) as only_first, count(*) filter (x < 1 and y = 1) as only_second from p""",
    "answer_labels": f"with {with_fixtures('results')}, {_LABELLED} select id, label, stage from labelled",
    "abstention_matrix": f"with {with_fixtures('results')}, {_LABELLED} select count(*) as n, {', '.join(f'count(*) filter (label = {x!r}) as {x}' for x in ('fabricated', 'correct_refusal', 'needless_refusal', 'correct', 'wrong'))}, count(*) filter (stage = 'stage1') as stage1, count(*) filter (stage = 'stage2') as stage2 from labelled",
    "answer_rates": f"with {with_fixtures('results')} select lang, count(*) filter (coalesce(content_ok, false) and expected = 'answer') as hit, count(*) filter (expected = 'answer') as total, 100 * count(*) filter (coalesce(content_ok, false) and expected = 'answer') / nullif(count(*) filter (expected = 'answer'), 0)::double as percent, median(latency) as median_latency, max(latency) as most_latency from results group by lang",
    "judge_reports": f"with {with_fixtures('results')} select category, count(*) as n, count(*) filter (coalesce(content_ok, false)) as by_checks, count(*) filter (judge_verdict = 'right') as by_judge, count(*) filter (judge_verdict is null) as undecided, count(*) filter ((judge_verdict = 'right') <> coalesce(content_ok, false)) as disagreed from results group by category",
    "answer_checks": f"""with {with_fixtures('anchors', 'given_answers', 'cited')}, c as (select a.id, len({numbers_sql('quote')}) > 0 as numeric_, len(list_filter({numbers_sql('quote')}, lambda x: not list_contains({numbers_sql('answer')}, x))) = 0 as by_numbers, contains({_CANON.format('answer')}, {_CANON.format('quote')}) as by_words,
    exists (select 1 from cited k where k.id = a.id and k.doc = a.doc and k.page = a.page) as named from anchors a join given_answers g on a.id = g.id)
    select id, bool_and(case when numeric_ then by_numbers else by_words end) as content_ok, bool_and(named) as citation_ok, count(*) filter (case when numeric_ then by_numbers else by_words end) as anchors_found from c group by id""",
    "canonical_numbers": f"select item_id, array_to_string(list_sort({numbers_sql('text')}), ' ') as numbers, length({_CANON.format('text')})::int as length from benchmark",
    "anchor_statuses": f"""with {with_fixtures('anchors', 'pages_read')}, s as (select a.*, (select max(page_no) from pages_read p where p.doc = a.doc) as last_page, exists (select 1 from pages_read p where p.doc = a.doc and p.page_no = a.page and contains(p.text, a.quote)) as exact,
    exists (select 1 from pages_read p where p.doc = a.doc and p.page_no = a.page and contains({_TR.format('p.text')}, {_TR.format('a.quote')})) as folded, exists (select 1 from pages_read p where p.doc = a.doc and contains({_TR.format('p.text')}, {_TR.format('a.quote')})) as other from anchors a)
    select id, place, doc, page, case when doc is null or page is null or coalesce(quote, '') = '' then 'schema' when last_page is null then 'no_file' when page < 1 or page > last_page then 'page_range' when exact then 'ok' when folded then 'case' when other then 'wrong_page' else 'not_found' end as status from s""",
    "index_statuses": f"""with {with_fixtures('anchors', 'chunks_read')} select id, place, a.doc, page, case when count(c.text) = 0 then 'no_doc' when not coalesce(bool_or(contains(c.text, quote)), false) then 'split' when bool_or(contains(c.text, quote) and page between page_start and page_end) then 'ok' else 'page_off' end as status from anchors a left join chunks_read c on a.doc = c.doc group by id, place, a.doc, page, quote""",
    "anchor_coverage": f"with {_ANCHORS} select d.doc_id, count(a.item_id) as n_anchors, count(distinct a.item_id) as n_questions from documents d left join anchored a using (doc_id) group by d.doc_id",
    "remapped_anchors": f"with {with_fixtures('anchors')} select id, place, case when doc in ('rules', 'other') then 'rules-v2' else doc end as doc from anchors",
    "turkish_folding": f"with {with_fixtures('pages_read')} select doc, page_no, {_TR.format('text')} as text, (length(text) - length(replace(text, 'e', '')))::int as n from pages_read",
    "character_errors": f"with {with_fixtures('runs', 'truths')} select method, doc, round({_CER}, 6) as cer from runs join truths using (doc)",
    "method_ranking": f"""with {with_fixtures('runs', 'truths', 'languages', 'elapsed')}, s as (select r.method, coalesce(l.lang, '??') as lang, {_CER.replace('text', 'r.text')} as cer, e.seconds, coalesce(f.scope, 'document') as scope from runs r left join truths f on r.doc = f.doc left join languages l on r.doc = l.doc left join elapsed e on r.doc = e.doc and r.method = e.method),
    m as (select method, avg(cer) filter (lang = 'TR') as cer_tr, avg(cer) filter (lang = 'EN') as cer_en, avg(seconds) as seconds from s where scope = 'document' group by method)
    select method, round(cer_tr, 6) as cer_tr, round(cer_en, 6) as cer_en, round(seconds, 6) as seconds, round(greatest(cer_tr, cer_en), 6) as worst, (row_number() over (order by greatest(cer_tr, cer_en) nulls last, seconds nulls last, method))::int as rank from m""",
    "reference_texts": f"""with {with_fixtures('compared', 'manual', 'overrides', 'pages_read')}, o as (select v.doc, string_agg(p.text, ' ' order by p.page_no) as t from overrides v join pages_read p on p.doc = v.of_doc and p.page_no between v.page_from and v.page_to group by v.doc), own as (select doc, string_agg(text, ' ' order by page_no) as t from pages_read group by doc)
    select c.doc, coalesce(m.text, o.t, own.t) as reference, case when m.text is null and o.t is not null then 'pages' else 'document' end as scope from compared c left join manual m on c.doc = m.doc left join o on c.doc = o.doc left join own on c.doc = own.doc""",
    "best_setting": f"with {with_fixtures('settings')} select arg_min(name, place) as name, count(*) as n_tied from settings where (tr, cross_lingual, mrr) = (select max((tr, cross_lingual, mrr)) from settings)",
    "latency_summary": f"with {with_fixtures('latencies')}, g as (select median(seconds) as x from latencies group by pair) select min(x) as least, avg(x) as mean, median(x) as median, max(x) as most from g",
}
