"""Inputs that the standard tables don't hold as such, made of them by SQL that Spark and DuckDB read alike.

Pages, answers, runs and results are rows of documents, benchmark and conversations with a new role; the
cases that matter (a threshold's either side, blanks, nulls, strange signs) are spread over all rows by their
numbers, so a query works on as many rows as the tables have. {name} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.dense import search_dense
from tessera.sources.tables import read_table

#: A turn's number over all conversations, and conversations as documents of pages.
_TURN = "conv_id * 1000 + turn"
_DOC = "'conv-' || cast(conv_id as string)"

FIXTURES = {
    # Pages for every reason of the router, and at either side of its thresholds.
    "routed": """select doc_id as id, cast(doc_id % 10 as double) / 10 as image_share, case doc_id % 13 when 0 then cast(null as string) when 1 then ' ' || left(text, 119) when 2 then left(text, 120) when 3 then text || '(cid:12)'
        when 4 then text || 'Ã©' when 5 then left(text, 120) || 'þ' when 6 then left(text, 999) || 'þ' when 7 then left(text, 120) || chr(1) || chr(2) when 8 then left(text, 398) || chr(1) || chr(2) when 9 then left(text, 700)
        when 10 then left(text, 130) when 11 then text || 'â€x' else text end as text from {documents}""",
    "words_read": "select conv_id as page, cast(case when turn % 4 = 3 then -1 else length(text) % 101 end as double) as confidence from {conversations}",
    "spreads": "select doc_id as page, cast(length(text) % 500 as double) / 10 as spread from {documents}",
    "spaced": f"""select {_TURN} as id, case {_TURN} % 6 when 0 then replace(text, ' ', '-' || chr(10) || '  ') when 1 then chr(9) || ' ' || replace(text, ' ', '  ') || chr(13) || chr(10) when 2 then replace(text, ' ', chr(133) || chr(160))
        when 3 then '' when 4 then cast(null as string) else replace(text, ' ', ' - ') end as text from {{conversations}}""",
    "blank_docs": f"select {_TURN} as doc_id, case {_TURN} % 5 when 0 then '' when 1 then '  ' || chr(10) when 2 then cast(null as string) else text end as text from {{conversations}}",
    "models": "select doc_id as id, case doc_id % 6 when 0 then 'turbo' when 1 then 'large' when 2 then source || '/multilingual-E5-base' when 3 then source || '-r1' when 4 then 'large-instruct' else source end as model from {documents}",
    "paths": "select case page_id % 5 when 0 then url || '/Report.v2.PDF' when 1 then url || '/scan.JPG' when 2 then '../../' || url || '/x.png' when 3 then url || '/.hidden' else url end as path from {pages}",
    "questions": "select item_id as query_id, text as question from {benchmark}",
    "raw_answers": """select conv_id as query_id, case conv_id % 6 when 0 then '<THINK>' || text || chr(10) || 'well</THINK> ' || text || ' [2][1][2][9], see [3].' || chr(10) when 1 then '<think>' || text || '</think>' || chr(10) || chr(10)
        when 2 then text || ' [YANITLANAMADI] not said' when 3 then '[YANITLANAMADI]' when 4 then cast(null as string) else text || ' [1]' end as answer from {conversations} where turn = 1""",
    "deltas": """select conv_id as query_id, turn as seq, case when conv_id % 7 = 0 and turn = 0 then '[YANIT' when conv_id % 7 = 0 and turn = 1 then 'LANAMADI]' when turn % 3 = 2 then cast(null as string) when conv_id % 5 = 1 then '' else text end as content,
        case when turn % 3 = 2 then text when turn % 3 = 1 then '' end as thinking from {conversations}""",
    "said": f"select {_TURN} as id, case {_TURN} % 7 when 0 then 'DOĞRU. ' || text when 1 then 'yanlis' when 2 then 'YANLIŞ, ' || text || ' not DOĞRU' when 3 then cast(null as string) when 4 then 'DOGRU or YANLIS' when 5 then text || ' yanlış' else text end as said from {{conversations}}",
    "results": """select doc_id as id, lang, case doc_id % 5 when 0 then 'single_doc' when 1 then 'table' when 2 then 'out_of_domain' when 3 then 'unanswerable' else 'false_premise' end as category, case when quality = 1 then 'answer' else 'refuse' end as expected,
        doc_id % 3 = 0 as refused, doc_id % 6 = 0 as gated, case when doc_id % 3 > 0 then length(text) % 2 = 0 end as content_ok, case doc_id % 4 when 0 then cast(null as string) when 1 then 'wrong' else 'right' end as judge_verdict, cast(length(text) % 4096 as double) / 256 as latency
        from {documents} join {labels} using (doc_id)""",
    # Two scores of the labelled texts: their length, and how many of their signs aren't letters e.
    "paired_scores": "select doc_id as id, case when quality = 1 then 'answer' else 'refuse' end as expected, cast(length(text) as double) as rerank_score, cast(length(replace(text, 'e', '')) % 512 as double) as cosine_score from {documents} join {labels} using (doc_id)",
    "pages_read": f"select {_DOC} as doc, cast(turn + 1 as int) as page_no, text from {{conversations}}",
    # Quotes: as they stand, in capitals, of the next page, of no page, empty.
    "anchors": f"""select 'q' || cast(conv_id as string) as id, cast(turn as int) as place, case when {_TURN} % 11 = 10 then 'other' else {_DOC} end as doc, cast(case when {_TURN} % 9 = 8 then 99 when {_TURN} % 9 = 7 then turn + 2 else turn + 1 end as int) as page,
        case {_TURN} % 8 when 0 then '' when 1 then 'nowhere at all to be found 2,50' when 2 then upper(substr(text, 3, 20)) when 3 then 'zzz' || substr(text, 3, 20) else substr(text, 2, 30) end as quote from {{conversations}}""",
    "chunks_read": f"select {_DOC} as doc, cast(turn + 1 as int) as page_start, cast(turn + 1 + turn % 2 as int) as page_end, substr(text, 1 + cast(turn % 3 as int), 400) as text from {{conversations}}",
    "given_answers": "select 'q' || cast(conv_id as string) as id, 'It is 2.50: ' || text as answer from {conversations} where turn = 0",
    "cited": f"select 'q' || cast(conv_id as string) as id, {_DOC} as doc, cast(turn + 1 as int) as page from {{conversations}} where turn % 2 = 0",
    # Readings of the benchmark by three methods; DuckDB's edit distance counts bytes, so signs beyond ASCII are left out.
    "texts_read": "select item_id, trim(regexp_replace(regexp_replace(text, '[^!-~]', ' ', 'g'), ' +', ' ', 'g')) as text from {benchmark}",
    "runs": """select 'raw' as method, 'd' || cast(item_id as string) as doc, replace(text, 'e', 'c') as text from ({texts_read}) as r union all select 'clean', 'd' || cast(item_id as string), replace(text, 'th', 't') from ({texts_read}) as c where item_id % 5 < 4
        union all select 'slow', 'd' || cast(item_id as string), text from ({texts_read}) as s where item_id % 2 = 0""",
    "truths": "select 'd' || cast(item_id as string) as doc, text as reference, case when item_id % 4 = 3 then 'pages' else 'document' end as scope from ({texts_read}) as r where item_id % 7 < 6",
    "languages": "select 'd' || cast(item_id as string) as doc, case item_id % 3 when 0 then 'TR' else 'EN' end as lang from {benchmark} where item_id % 11 < 10",
    "elapsed": "select 'd' || cast(item_id as string) as doc, method, cast(length(text) % 17 + weight as double) as seconds from {benchmark} cross join (values ('raw', 1), ('clean', 4), ('slow', 9)) as m(method, weight) where method <> 'slow' or item_id % 3 = 0",
    "manual": f"select {_DOC} as doc, 'by hand: ' || text as text from {{conversations}} where turn = 0 and conv_id % 5 = 0",
    "overrides": "select 'conv-' || cast(conv_id as string) as doc, 'conv-' || cast(conv_id + 1 as string) as of_doc, cast(1 as int) as page_from, cast(2 as int) as page_to from {conversations} where turn = 0 and conv_id % 3 = 0",
    "compared": "select distinct 'conv-' || cast(conv_id + 1 as string) as doc from {conversations}",
    "settings": "select source as name, cast(min(doc_id) as int) as place, cast(count(distinct lang) as double) as tr, cast(min(length(lang)) as double) as cross_lingual, cast(max(length(text)) // 1000 as double) as mrr from {documents} group by source",
    "latencies": "select source || lang as pair, cast(length(text) as double) / 128 as seconds from {documents}",
    # A store of pages, a document without a name among them, and a batch that brings some again and others anew.
    "stored": f"select case when conv_id % 50 = 7 then cast(null as string) else {_DOC} end as doc, {_TURN} as pos, case when turn % 3 = 1 then 'ocr_raw' else 'text_layer' end as method, text from {{conversations}}",
    "arriving": f"select case when conv_id % 50 = 7 then cast(null as string) when conv_id % 6 = 1 then 'new-' || cast(conv_id as string) else {_DOC} end as doc, 1000000000 + {_TURN} as pos, case when turn % 2 = 1 then 'ocr_raw' else 'text_layer' end as method, upper(text) as text from {{conversations}} where conv_id % 3 = 1 and turn < 3",
    "grid": "select cast(depth as int) as depth, cast(constant as int) as constant, cast(weight as double) as weight from (values (10, 10, 1), (10, 10, 2), (10, 10, 3), (10, 60, 1), (10, 60, 2), (10, 60, 3), (20, 10, 1), (20, 10, 2), (20, 10, 3), (20, 60, 1), (20, 60, 2), (20, 60, 3)) as t(depth, constant, weight)",
    "planned": "select 'c' || cast(length(text) % 3 as string) as config, 'd' || cast(doc_id as string) as doc from {documents}",
    "done": "select 'c' || cast(doc_id % 3 as string) as config, 'd' || cast(doc_id as string) as doc from {documents} union all select 'c1', 'd' || cast(doc_id as string) from {documents}",
}

# Hits of the benchmark's items among the documents, by the vectors of their numbers: pages are made of a document's number, and a
# score near 0 is one that the gate refuses.
HITS, CONTEXT_HITS, LEAST_COSINE = "hits", 5, 0.3
_HITS_SQL = f"""select q.vec_id as query_id, cast(row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) desc, v.vec_id) as int) as rank,
    greatest(round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) - {LEAST_COSINE}, 0) as score, 'doc-' || (v.vec_id % 40) as doc, (1 + v.vec_id % 5)::int as page_start, (1 + v.vec_id % 5 + v.vec_id % 2)::int as page_end, d.text
    from embeddings q join embeddings v on q.vec_id in (select item_id from benchmark) join documents d on d.doc_id = v.vec_id qualify rank <= {CONTEXT_HITS}"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items, vectors = (read_table(spark, sf_dir, n) for n in ("documents", "benchmark", "embeddings"))
    of_docs = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    found = search_dense(of_docs.select("vec_id", "embedding"), asked, CONTEXT_HITS)
    first = (1 + F.col("vec_id") % 5).cast("int")
    score = F.greatest(F.round("score", 9) - LEAST_COSINE, F.lit(0.0))
    rows = found.select("query_id", F.col("rank").cast("int").alias("rank"), score.alias("score"), F.concat(F.lit("doc-"), F.col("vec_id") % 40).alias("doc"), first.alias("page_start"), (first + F.col("vec_id") % 2).cast("int").alias("page_end"), F.col("vec_id").alias("doc_id"))
    return rows.join(docs.select("doc_id", "text"), "doc_id").drop("doc_id")


#: Signs whose capital is several signs in Spark (ß: SS), and the one sign that DuckDB has for each; itself where there is none.
_LONG = "".join(c for c in map(chr, range(0x80, 0xFB18)) if len(c.upper()) > 1)
_SHORT = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _LONG)


def _upper(text: str) -> str:
    """Spark's SQL for capitals sign by sign. A ß is frequent and exchanged beforehand; texts with another such sign are taken apart."""
    each = f"array_join(transform(split({text}, ''), c -> case when instr('{_LONG}', c) > 0 then translate(c, '{_LONG}', '{_SHORT}') else upper(c) end), '')"
    return f"case when {text} rlike '[{_LONG.replace('ß', '')}]' then {each} else upper(translate({text}, 'ß', 'ẞ')) end"


def _for_spark(sql: str) -> str:
    """Whole quotients, replacements of all occurrences and capitals are written otherwise in Spark."""
    sql = re.sub(r"\bupper\(((?:[^()]|\([^()]*\))*)\)", lambda m: _upper(m[1]), sql)
    return sql.replace(", 'g')", ")").replace(" // ", " div ")


def _tables(sql: str) -> set[str]:
    return {n for n in re.findall(r"\{(\w+)\}", sql)}


def _expanded(name: str) -> str:
    """The SQL with other inputs put in where they are named."""
    sql = FIXTURES[name]
    for other in _tables(sql) & FIXTURES.keys():
        sql = sql.replace("{" + other + "}", _expanded(other))
    return sql


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == HITS:
        return _hits(spark, sf_dir)
    sql = _for_spark(_expanded(name))
    return spark.sql(sql, **{n: read_table(spark, sf_dir, n) for n in _tables(sql)})


def with_fixtures(*names: str) -> str:
    """Common table expressions of the inputs, for the beginning of an oracle's SQL."""
    sql = {n: _HITS_SQL if n == HITS else re.sub(r"\{(\w+)\}", r"\1", _expanded(n)) for n in names}
    return ",\n".join(f"{n} as ({s})" for n, s in sql.items())
