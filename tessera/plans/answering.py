"""Queries of gates, prompts, answers and stored pages, over hits of the benchmark and turns of conversations, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config, options
from tessera.functions import text as T
from tessera.operators import answers
from tessera.plans.fixtures import fixture, with_fixtures
from tessera.providers import QuotingGenerator
from tessera.sources.sinks import open_runs
from tessera.streaming.upserts import documents_of, replace_documents, upsert_report


def gated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.score_gate(fixture(spark, sf_dir, "questions"), fixture(spark, sf_dir, "hits"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "hits").select("query_id", "rank", T.page_label(F.col("page_start"), F.col("page_end")).alias("label"))


def question_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.prompts(fixture(spark, sf_dir, "questions"), answers.contexts(fixture(spark, sf_dir, "hits"))).select("query_id", "prompt")


def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.grounding_gate(fixture(spark, sf_dir, "raw_answers"))


def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited pages of each answer, numbered in the order of their first mark."""
    found = answers.citations(answers.grounding_gate(fixture(spark, sf_dir, "raw_answers")), fixture(spark, sf_dir, "hits"))
    order = F.array_sort(F.collect_list(F.struct("place", "doc", "page_start", "page_end")))
    listed = found.groupBy("query_id").agg(order.alias("held"))
    return listed.select("query_id", F.posexplode("held").alias("at", "c")).select("query_id", "at", "c.doc", "c.page_start", "c.page_end")


def cited_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fixture(spark, sf_dir, "hits")
    cited = answers.citations(answers.grounding_gate(fixture(spark, sf_dir, "raw_answers")), hits)
    return answers.passages(hits, cited, chars=10).select("query_id", "rank", "cited", "preview")


def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way with a stand-in that quotes the first passage."""
    done = answers.answer_questions(fixture(spark, sf_dir, "questions"), fixture(spark, sf_dir, "hits"), QuotingGenerator())
    return done.select("query_id", "answer", "refused", "reason", F.array_join(F.transform("sources", lambda s: F.concat_ws(" ", s["doc"], s["page"].cast("string"))), "; ").alias("sources"))


def thinking_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with thinking forced on and off."""
    asked = answers.prompts(fixture(spark, sf_dir, "questions"), answers.contexts(fixture(spark, sf_dir, "hits")))
    return answers.thinking_probe(asked, QuotingGenerator(), options("large-instruct", Config()))


def folded_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers put together from a stream's parts, and whether what is there may still become a refusal."""
    folded = answers.folded_stream(fixture(spark, sf_dir, "deltas"))
    return folded.withColumn("may_refuse", answers.may_become_refusal(F.col("answer")))


def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "said").select("id", answers.verdict(F.col("said")).alias("verdict"))


def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a judge, which quotes nothing and so refuses: no verdict."""
    rows = fixture(spark, sf_dir, "given_answers").select(F.col("id").alias("question"), F.lit(None).cast("string").alias("reference_answer"), "answer")
    return answers.judge_answers(rows, QuotingGenerator(), {"temperature": 0}).select("question", "judge_verdict", "judge_reason")


def upserted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_documents(fixture(spark, sf_dir, "stored"), fixture(spark, sf_dir, "arriving"), "doc")


def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(replace_documents(fixture(spark, sf_dir, "stored"), fixture(spark, sf_dir, "arriving"), "doc"))


def upsert_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch of pages brings, each page a chunk, by document with a name."""
    batch = fixture(spark, sf_dir, "arriving").where("doc is not null")
    return upsert_report(fixture(spark, sf_dir, "stored"), batch, batch)


def open_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_runs(fixture(spark, sf_dir, "planned"), fixture(spark, sf_dir, "done"))


QUERIES = {f.__name__: f for f in (gated_questions, page_labels, question_prompts, grounded_answers, answer_citations, cited_passages, answered_questions, thinking_compared, folded_streams, judge_verdicts, judged_answers, upserted_documents, listed_documents, upsert_reports, open_configurations)}

_CLEAN = r"regexp_replace(regexp_replace(coalesce(answer, ''), '(?is)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g')"
_GROUNDED = f"""grounded as (select query_id, a as answer, a = '' or contains(a, '{T.REFUSAL}') as refused, case when a = '' then '{answers.NO_ANSWER}' when contains(a, '{T.REFUSAL}') then coalesce(nullif(trim(replace(a, '{T.REFUSAL}', '')), ''), '{answers.NOT_THERE}') end as reason
from (select query_id, {_CLEAN} as a from raw_answers))"""
_CITED = r"""marks as (select query_id, unnest(m) as mark, generate_subscripts(m, 1) as place from (select query_id, regexp_extract_all(answer, '\[(\d+)\]', 1) as m from grounded)),
cited as (select query_id, doc, page_start, min(place) as place, arg_min(page_end, place) as page_end from marks join hits using (query_id) where rank = try_cast(mark as int) group by query_id, doc, page_start)"""
_LABEL = "case when page_start = page_end then 's.' || page_start::varchar else 's.' || page_start::varchar || '-' || page_end::varchar end"
_CONTEXT = f"contexts as (select query_id, string_agg('[' || rank::varchar || '] ' || doc || ' ' || {_LABEL} || chr(10) || text, chr(10) || chr(10) order by rank) as context from hits group by query_id)"
_EARLY = "early as (select query_id, question, score as top_score, coalesce(score < 0.003, true) as refused from questions left join (select query_id, score from hits where rank = 1) using (query_id))"
_REPLACED = "replaced as (select * from stored s where not exists (select 1 from arriving a where a.doc is not distinct from s.doc) union all select * from arriving)"

ORACLES = {
    "gated_questions": f"with {with_fixtures('questions', 'hits')}, {_EARLY} select * from early",
    "page_labels": f"with {with_fixtures('hits')} select query_id, rank, {_LABEL} as label from hits",
    "question_prompts": f"""with {with_fixtures('questions', 'hits')}, {_CONTEXT} select query_id, '{answers.RULES.replace("'", "''")}' || chr(10) || chr(10) || '{answers.DOCUMENTS_MARK}' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || '{answers.QUESTION_MARK} ' || question as prompt from questions left join contexts using (query_id)""",
    "grounded_answers": f"with {with_fixtures('raw_answers')}, {_GROUNDED} select * from grounded",
    "answer_citations": f"with {with_fixtures('raw_answers', 'hits')}, {_GROUNDED}, {_CITED} select query_id, (row_number() over (partition by query_id order by place) - 1)::int as at, doc, page_start, page_end from cited",
    "cited_passages": f"with {with_fixtures('raw_answers', 'hits')}, {_GROUNDED}, {_CITED} select h.query_id, h.rank, c.doc is not null as cited, case when length(text) > 10 then left(text, 10) || '…' else text end as preview from hits h left join cited c on h.query_id = c.query_id and h.doc = c.doc and h.page_start = c.page_start",
    "answered_questions": f"""with {with_fixtures('questions', 'hits')}, {_EARLY} select query_id, case when refused then '' else text || ' [1]' end as answer, refused, case when refused then '{answers.NO_HITS}' end as reason, case when refused then '' else doc || ' ' || page_start::varchar end as sources
    from early left join (select * from hits where rank = 1) using (query_id)""",
    "thinking_compared": f"""with {with_fixtures('questions', 'hits')} select query_id, coalesce(text || ' [1]', '{T.REFUSAL}') as "on", coalesce(text || ' [1]', '{T.REFUSAL}') as "off", true as same from questions left join (select * from hits where rank = 1) using (query_id)""",
    "folded_streams": f"""with {with_fixtures('deltas')}, f as (select query_id, string_agg(coalesce(content, ''), '' order by seq) as answer, min(seq) filter (length(thinking) > 0) as thinking_from, min(seq) filter (length(content) > 0) as writing_from from deltas group by query_id)
    select *, starts_with('{T.REFUSAL}', ltrim(answer)) or starts_with(ltrim(answer), '{T.REFUSAL}') as may_refuse from f""",
    "judge_verdicts": f"""with {with_fixtures('said')}, m as (select id, least(nullif(strpos(upper(said), 'DOĞRU'), 0), nullif(strpos(upper(said), 'DOGRU'), 0)) as r, least(nullif(strpos(upper(said), 'YANLIŞ'), 0), nullif(strpos(upper(said), 'YANLIS'), 0)) as w from said)
    select id, case when r is null and w is null then null when w is null or r < w then 'right' else 'wrong' end as verdict from m""",
    "judged_answers": f"with {with_fixtures('given_answers')} select id as question, null::varchar as judge_verdict, '{T.REFUSAL}' as judge_reason from given_answers",
    "upserted_documents": f"with {with_fixtures('stored', 'arriving')}, {_REPLACED} select * from replaced",
    "listed_documents": f"with {with_fixtures('stored', 'arriving')}, {_REPLACED} select doc, count(*) as chunks, min(pos) as first from replaced group by doc",
    "upsert_reports": f"with {with_fixtures('stored', 'arriving')} select doc, count(*) as pages, count(*) filter (method <> 'text_layer') as ocr_pages, count(*) as chunks, doc in (select doc from stored where doc is not null) as updated from arriving where doc is not null group by doc",
    "open_configurations": f"with {with_fixtures('planned', 'done')} select * from planned p where not exists (select 1 from done d where d.config = p.config and d.doc = p.doc)",
}
