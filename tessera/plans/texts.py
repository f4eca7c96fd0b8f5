"""Queries of page routing, text functions and chunks, with the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config, model_prefix, reasons, tier_model, token_limit
from tessera.functions import text as T
from tessera.operators import chunking
from tessera.operators.routing import label_histogram, majority_label, ocr_confidence, ocr_method, page_ratios, route_pages
from tessera.plans.fixtures import fixture, with_fixtures
from tessera.sources.tables import read_table

PLACES = 6


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, PLACES) for n in names})


def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_pages(_docs(spark, sf_dir)).select("doc_id", "reason", "needs_ocr")


def routing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_histogram(route_pages(_docs(spark, sf_dir)))


def routing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_pages(fixture(spark, sf_dir, "routed"), image_share=F.col("image_share")).select("id", "reason", "needs_ocr")


def routing_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the router measures on each document, and on the cases, whose ids are negative."""
    pages = _docs(spark, sf_dir).select("doc_id", "text").unionByName(fixture(spark, sf_dir, "routed").select((-F.col("id")).cast("long").alias("doc_id"), "text"))
    measured = page_ratios(F.col("text"))
    return _rounded(pages.select("doc_id", *(c.alias(n) for n, c in measured.items())), "misread_share", "garbage_share")


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority reason and share of Turkish letters of each source."""
    routed = route_pages(_docs(spark, sf_dir))
    shares = routed.groupBy("source").agg(F.round(F.avg(T.turkish_share(F.col("text"))), PLACES).alias("turkish_share"))
    return majority_label(routed, "source").join(shares, "source")


def recognition_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_confidence(fixture(spark, sf_dir, "words_read"), "page")


def recognition_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "spreads").select("page", ocr_method(F.col("spread")).alias("method"))


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "spaced").select("id", T.normalize(F.col("text")).alias("text"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _docs(spark, sf_dir).select("doc_id", F.transform(chunking.sentences(T.normalize(F.col("text"))), lambda s: F.length(s)).alias("n"))
    return parts.select("doc_id", F.size("n").alias("sentences"), F.array_max("n").alias("longest"), F.aggregate("n", F.lit(0), lambda s, x: s + x).alias("total"))


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document as one sentence without an end."""
    rows = _docs(spark, sf_dir).select("doc_id", F.regexp_replace(T.normalize(F.col("text")), "[.!?…]", "").alias("text"))
    return chunking.sentence_lines(rows, "text").select("doc_id", F.posexplode("lines").alias("place", "line"))


def _lines_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as pages, read by two methods in turn."""
    lines = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return lines.select("doc", (F.col("at") + 1).alias("page_no"), "text", F.when(F.col("at") % 2 == 0, "text_layer").otherwise("ocr_raw").alias("method"))


def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _lines_as_pages(spark, sf_dir).withColumn("text", T.normalize(F.col("text")))
    return chunking.page_offsets(pages).select("doc", "page_no", "start")


def offset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join of every 500th place with the pages."""
    pages = _lines_as_pages(spark, sf_dir).withColumn("text", T.normalize(F.col("text")))
    starts = chunking.page_offsets(pages)
    ends = starts.groupBy("doc").agg(F.max(F.col("start") + F.length("text")).alias("n"))
    asked = ends.select("doc", F.explode(F.sequence(F.lit(0), F.col("n"), F.lit(500))).alias("offset"))
    return chunking.page_of_offsets(asked, starts.select("doc", "page_no", "start"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, sf_dir))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_pages(_lines_as_pages(spark, sf_dir))


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document, and those that aren't of the text layer alone."""
    return page_chunks(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("chunks"), F.count_if(F.col("method") != "text_layer").alias("ocr_chunks"))


def empty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixture(spark, sf_dir, "blank_docs")
    return chunking.without_chunks(docs, chunking.chunk_documents(docs), "doc_id").select("doc_id")


def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    composed = _docs(spark, sf_dir).select("doc_id", T.composed(text).alias("text"))
    return composed.select("doc_id", F.size(T.numbers(text, compose=False)).alias("n_numbers"), F.size(T.tokens(text, "split", compose=False)).alias("n_split"), F.size(T.tokens(text, "keep", compose=False)).alias("n_keep"))


def model_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, model = Config(), tier_model(F.col("model"), Config())
    return fixture(spark, sf_dir, "models").select("model", model.alias("resolved"), token_limit(model, config).alias("token_limit"), reasons(model, config).alias("reasons"), model_prefix(model, "query").alias("query_prefix"), T.slug(model).alias("slug"))


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return fixture(spark, sf_dir, "paths").select("path", T.base_name(path).alias("name"), T.stem(path).alias("stem"), T.is_image(path).alias("is_image"))


QUERIES = {f.__name__: f for f in (page_routing, routing_reasons, routing_cases, routing_ratios, source_labels, recognition_confidence, recognition_methods, normalized_text, sentence_counts, wrapped_lines, page_offsets, offset_pages, chunks, page_chunks, chunk_counts, empty_documents, text_numbers, model_options, path_names)}

_SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\pZ]"
_SPLIT, _KEEP = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}_]+(?:[.,/:\-][\p{L}\p{N}_]+)*"


def tokens_sql(pattern: str, column: str = "text") -> str:
    return f"regexp_extract_all(replace(lower({column}), chr(775), ''), '{_KEEP if pattern == 'keep' else _SPLIT}')"


def normalized_sql(column: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({column}, '-{_SPACE}*\\n{_SPACE}*', '', 'g'), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def numbers_sql(column: str) -> str:
    return rf"list_distinct(regexp_extract_all(regexp_replace(lower({column}), '(\d)[.,](\d)', '\1.\2', 'g'), '\d+(?:\.\d+)?'))"


_MISREAD = "(length(b) - length(translate(b, 'ðþýÐÞÝ', ''))) / greatest(length(b), 1)"
_GARBAGE = r"len(regexp_extract_all(b, '[\x{0}-\x{8}\x{e}-\x{1b}\x{7f}-\x{84}\x{86}-\x{9f}\x{e000}-\x{f8ff}]')) / greatest(length(b), 1)"
_REASON = rf"""case when length(b) < 120 then 'no_text' when regexp_matches(b, '\(cid:\d+\)') then 'broken_font'
when {_MISREAD} > 0.001 or regexp_matches(b, 'â€.|Ã[\x{{80}}-\x{{ff}}]') then 'mojibake' when {_GARBAGE} > 0.005 then 'garbage_chars'
when image_share > 0.75 and length(b) < 600 then 'image_heavy' else 'text_layer' end"""
_STRIPPED = rf"regexp_replace(coalesce(text, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_ROUTED = f"select *, {_REASON} as reason from (select *, {_STRIPPED} as b, 0::double as image_share from documents)"
_WRAP = """case when length(p) <= 800 then [p] else (list_transform([list_reduce(string_split(p, ' '), lambda s, w: case when s.line is not null and length(s.line) + length(w) + 2 > 800
then {'full': list_append(s.full, s.line), 'line': w} else {'full': s.full, 'line': case when s.line is null then w else s.line || ' ' || w end} end, {'full': []::varchar[], 'line': null::varchar})], lambda s: list_append(s.full, s.line)))[1] end"""
_CUT = r"string_split(regexp_replace({0}, '([.!?…])(\s+)([A-ZÇĞİÖŞÜ0-9(])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), chr(1))"
_LINE_PAGES = f"""lines as (select doc_id as doc, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1)::int as page_no from documents),
pages as (select doc, page_no, {normalized_sql("text")} as text, case when page_no % 2 = 1 then 'text_layer' else 'ocr_raw' end as method from lines)"""
_ONE_PAGE = f"pages as (select doc_id as doc, 1 as page_no, {normalized_sql('text')} as text, 'text_layer' as method from documents where text is not null)"
_STARTS = "starts as (select doc, page_no, text, method, coalesce(sum(length(text) + 1) over (partition by doc order by page_no rows between unbounded preceding and 1 preceding), 0)::int as start from pages)"
#: The last pieces of a list of lengths that weigh 150 with one each, or none if that takes all of them.
_TAIL = "case when list_min(list_filter(range(1, len({0})), lambda k: list_sum(({0})[len({0}) - k + 1:]) + k >= 150)) is null then []::int[] else ({0})[len({0}) - list_min(list_filter(range(1, len({0})), lambda k: list_sum(({0})[len({0}) - k + 1:]) + k >= 150)) + 1:] end"


def _chunks_sql(pages: str) -> str:
    """Common table expressions that end in chunked: a fold over pieces, one after the other."""
    return f"""{pages}, {_STARTS},
    body as (select doc, string_agg(text, ' ' order by page_no) as body, list(start order by page_no) as page_starts, list(method order by page_no) as methods from starts group by doc),
    parts as (select doc, unnest({_CUT.format("body")}) as p, generate_subscripts({_CUT.format("body")}, 1) as i from body where length(body) > 0),
    placed as (select *, coalesce(sum(length(p)) over (partition by doc order by i rows between unbounded preceding and 1 preceding), 0) as spot from parts),
    wrapped as (select doc, i, spot, unnest(w) as p, generate_subscripts(w, 1) as j from (select doc, i, spot, {_WRAP} as w from placed where i % 2 = 1)),
    pieces as (select doc, p, length(p)::int as l, row_number() over (partition by doc order by i, j) as n, (spot + coalesce(sum(length(p) + 1) over (partition by doc, i order by j rows between unbounded preceding and 1 preceding), 0))::int as o from wrapped),
    held as (select doc, count(*) as n, list(p order by n) as ps, list(o order by n) as os from pieces group by doc),
    fold as (
        select doc, 1::bigint as i, []::int[] as buf, []::struct(f bigint, s bigint)[] as done from held
        union all
        select doc, i + 1, case when full_ then {_TAIL.format("buf2")} else buf2 end, case when full_ then list_append(done1, {{'f': i + 1 - len(buf2), 's': i}}) else done1 end from (
            select doc, i, done1, list_append(buf1, l) as buf2, coalesce(list_sum(buf1), 0) + len(buf1) + l + 1 >= 800 as full_ from (
                select doc, i, l, case when early then {_TAIL.format("buf")} else buf end as buf1, case when early then list_append(done, {{'f': i - len(buf), 's': i - 1}}) else done end as done1 from (
                    select r.doc, r.i, r.buf, r.done, p.l, len(r.buf) > 0 and list_sum(r.buf) + len(r.buf) + p.l > 1600 as early from fold r join pieces p on p.doc = r.doc and p.n = r.i)))),
    ended as (select doc, buf, done, n, ps, os, len(done) > 0 and len(buf) > 0 and list_sum(buf) + len(buf) - 1 < 200 as joins from fold join held using (doc) where i = n + 1),
    ranged as (select doc, n, ps, os, joins, len(buf) as rest, case when len(buf) > 0 and not joins then list_append(done, {{'f': n + 1 - len(buf), 's': n}}) else done end as done from ended),
    each as (select *, unnest(done) as r, generate_subscripts(done, 1) as ordinal from ranged),
    texts as (select doc, (ordinal - 1)::int as ordinal, os[r.f] as a, os[r.s] + length(ps[r.s]) - 1 as z, joins and ordinal = len(done) as last_joins, os[n] as last_start,
        array_to_string(ps[r.f:r.s], ' ') as t, array_to_string(ps[n + 1 - rest:n], ' ') as more from each),
    spans as (select texts.*, methods, len(list_filter(page_starts, lambda s: s <= a))::int as page_start, len(list_filter(page_starts, lambda s: s <= z))::int as page_full, len(list_filter(page_starts, lambda s: s <= case when last_joins then last_start else z end))::int as page_end from texts join body using (doc)),
    chunked as (select doc, ordinal, doc::varchar || '#' || lpad(ordinal::varchar, 4, '0') as chunk_id, page_start, page_end, case when len(list_distinct(methods[page_start:page_full])) = 1 then methods[page_start] else 'mixed' end as method,
        case when last_joins then trim(t || ' ' || more) else t end as text from spans)"""


def chunks_of_size_sql(target: int, overlap: int) -> str:
    """Chunks of documents by the recursive fold, with another target, a limit of twice that, and another overlap."""
    sizes = {"800": str(target), "1600": str(2 * target), "150": str(overlap)}
    return re.sub(r"\b(800|1600|150)\b", lambda m: sizes[m[0]], f"with recursive {_chunks_sql(_ONE_PAGE)} select doc as doc_id, ordinal, text from chunked")


ORACLES = {
    "page_routing": f"select doc_id, reason, reason <> 'text_layer' as needs_ocr from ({_ROUTED})",
    "routing_reasons": f"select reason, count(*) as n from ({_ROUTED}) group by reason",
    "routing_cases": f"with {with_fixtures('routed')} select id, reason, reason <> 'text_layer' as needs_ocr from (select *, {_REASON} as reason from (select *, {_STRIPPED} as b from routed))",
    "routing_ratios": f"with {with_fixtures('routed')} select doc_id, length(b)::int as length, round({_MISREAD}, 6) as misread_share, round({_GARBAGE}, 6) as garbage_share from (select doc_id, {_STRIPPED} as b from (select doc_id, text from documents union all select -id::bigint, text from routed))",
    "source_labels": f"""with r as ({_ROUTED}), n as (select source, reason, row_number() over (partition by source order by count(*) desc, reason) as nth from r group by source, reason),
    s as (select source, round(avg((length(text) - length(translate(text, 'çğıöşüÇĞİÖŞÜ', ''))) / greatest(length(text), 1)), 6) as turkish_share from documents group by source) select source, reason, turkish_share from n join s using (source) where nth = 1""",
    "recognition_confidence": f"with {with_fixtures('words_read')} select page, coalesce(avg(confidence) filter (confidence >= 0), 0) as confidence from words_read group by page",
    "recognition_methods": f"with {with_fixtures('spreads')} select page, case when spread >= 25 then 'ocr_preprocessed' else 'ocr_raw' end as method from spreads",
    "normalized_text": f"with {with_fixtures('spaced')} select id, {normalized_sql('text')} as text from spaced",
    "sentence_counts": f"select doc_id, len(n)::int as sentences, list_max(n)::int as longest, list_sum(n)::int as total from (select doc_id, list_transform(list_filter({_CUT.format(normalized_sql('text'))}, lambda p, i: i % 2 = 1), lambda p: length(p)) as n from documents)",
    "wrapped_lines": f"select doc_id, (generate_subscripts(w, 1) - 1)::int as place, unnest(w) as line from (select doc_id, {_WRAP} as w from (select doc_id, regexp_replace({normalized_sql('text')}, '[.!?…]', '', 'g') as p from documents))",
    "page_offsets": f"with {_LINE_PAGES}, {_STARTS} select doc, page_no, start from starts",
    "offset_pages": f"""with {_LINE_PAGES}, {_STARTS}, asked as (select doc, unnest(range(0, n + 1, 500))::int as "offset" from (select doc, max(start + length(text)) as n from starts group by doc))
    select a.doc, a."offset", s.page_no from asked a asof join starts s on a.doc = s.doc and a."offset" >= s.start""",
    "chunks": f"with recursive {_chunks_sql(_ONE_PAGE)} select doc as doc_id, * exclude (doc) from chunked",
    "page_chunks": f"with recursive {_chunks_sql(_LINE_PAGES)} select * from chunked",
    "chunk_counts": f"with recursive {_chunks_sql(_LINE_PAGES)} select doc, count(*) as chunks, count(*) filter (method <> 'text_layer') as ocr_chunks from chunked group by doc",
    "empty_documents": f"with {with_fixtures('blank_docs')} select doc_id from blank_docs where coalesce({normalized_sql('text')}, '') = ''",
    "text_numbers": f"select doc_id, len({numbers_sql('text')})::int as n_numbers, len({tokens_sql('split')})::int as n_split, len({tokens_sql('keep')})::int as n_keep from documents",
    "model_options": f"""with {with_fixtures('models')}, m as (select model, case model when 'turbo' then 'small-instruct' when 'large' then 'large-instruct' else model end as resolved from models)
    select model, resolved, case when resolved = 'large-instruct' then 1536 else 512 end::int as token_limit, regexp_matches(resolved, '(?i)(reason|think|r1)') as reasons, case when lower(resolved) like '%e5%' then 'query: ' else '' end as query_prefix, replace(resolved, '/', '__') as slug from m""",
    "path_names": f"""with {with_fixtures('paths')}, n as (select path, string_split(rtrim(path, '/'), '/')[-1] as name from paths) select path, name, case when strpos(substr(name, 2), '.') > 0 then regexp_replace(name, '\\.[^.]*$', '') else name end as stem, regexp_matches(lower(path), '\\.(png|jpg|jpeg)$') as is_image from n""",
}
