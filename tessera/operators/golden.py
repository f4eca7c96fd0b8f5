"""Golden sets: reading them, checking their labels against documents and indexes, and judging answers by their quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.similarity import partial_ratio_from, token_set_ratio

# Categories, those of them that must be refused or need two documents, languages, and the least fuzzy likeness.
CATEGORIES = ("single_doc", "multi_doc", "unanswerable", "false_premise", "conflict", "table", "cross_lingual", "out_of_domain")
REFUSED, TWO_DOCUMENTS = ("unanswerable", "false_premise", "out_of_domain"), ("multi_doc", "conflict")
LANGUAGES, EXPECTED = ("tr", "en"), ("answer", "refuse")
LEAST_LIKENESS = 85.0
GOLDEN = "id string, question string, category string, lang string, expected string, anchors array<struct<doc: string, page: int, quote: string>>, reference_answer string, exclude_docs array<string>, note string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions of a YAML file on the driver; fields that a question leaves out are null, anchors empty."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f) or []
    names = [field.split()[0] for field in ("id", "question", "category", "lang", "expected", "anchors", "reference_answer", "exclude_docs", "note")]
    anchors = lambda r: [(a.get("doc"), a.get("page"), a.get("quote")) for a in r.get("anchors") or []]
    return spark.createDataFrame([tuple(anchors(r) if n == "anchors" else r.get(n) for n in names) for r in rows], GOLDEN)


def anchors_of(golden: DataFrame) -> DataFrame:
    """Rows (id, place, doc, page, quote)."""
    return golden.select("id", F.posexplode("anchors").alias("place", "a")).select("id", "place", "a.doc", "a.page", "a.quote")


def remapped(rows: DataFrame, group: Sequence[str], variant: str, doc: str = "doc") -> DataFrame:
    """Documents that exclude each other stand for the one that is indexed."""
    return rows.withColumn(doc, F.when(F.col(doc).isin(list(group)), variant).otherwise(F.col(doc)))


def duplicate_ids(golden: DataFrame) -> DataFrame:
    return golden.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def label_problems(golden: DataFrame) -> DataFrame:
    """Rows (id, problem): every rule that a golden question breaks."""
    blank = lambda c: F.coalesce(T.stripped(F.col(c)), F.lit("")) == ""
    anchors = F.coalesce("anchors", F.array().cast("array<struct<doc: string, page: int, quote: string>>"))
    docs = F.array_distinct(F.transform(anchors, lambda a: a["doc"]))
    exclude = F.coalesce("exclude_docs", F.array().cast("array<string>"))
    turkish = F.col("question").rlike(f"[{T.TURKISH_LETTERS}]")
    bare = F.exists(anchors, lambda a: a["quote"].rlike(r"^[\d\s.,%]+$"))
    rules = {
        **{f"no {c}": blank(c) for c in ("id", "question", "category", "lang", "expected", "reference_answer")},
        "unknown category": ~F.col("category").isin(*CATEGORIES),
        "unknown language": ~F.col("lang").isin(*LANGUAGES),
        "unknown expectation": ~F.col("expected").isin(*EXPECTED),
        "answer without anchors": (F.col("expected") == "answer") & (F.size(anchors) == 0),
        "refusal with anchors": (F.col("expected") == "refuse") & (F.size(anchors) > 0),
        "category wants a refusal": F.col("category").isin(*REFUSED) & (F.col("expected") != "refuse"),
        "category wants an answer": F.col("category").isin(*CATEGORIES) & ~F.col("category").isin(*REFUSED) & (F.col("expected") != "answer"),
        "fewer than two documents": F.col("category").isin(*TWO_DOCUMENTS) & (F.size(docs) < 2),
        "anchor in an excluded document": F.arrays_overlap(docs, exclude),
        "Turkish letters in an English question": (F.col("lang") == "en") & turkish,
        "anchor of digits alone": (F.col("category") != "table") & bare,
        "anchor without a quote": F.exists(anchors, lambda a: F.coalesce(T.stripped(a["quote"]), F.lit("")) == ""),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules.items())))
    return golden.select("id", F.explode(found).alias("problem"))


def anchor_status(anchors: DataFrame, pages: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Rows (id, place, doc, page, status): where a quote stands. pages: rows (doc, page_no, text).

    schema: no document, page or quote; no_file; page_range; ok: on its page; case: there but for Turkish case; wrong_page: on
    another page of the document; fuzzy: something like it on its page; not_found. The first that holds.
    """
    known = pages.groupBy("doc").agg(F.max("page_no").alias("last_page"))
    exact, folded = F.col("text").contains(F.col("quote")), T.turkish_lower(F.col("text")).contains(T.turkish_lower(F.col("quote")))
    key, own = ["id", "place", "doc", "page", "quote"], F.col("page_no") == F.col("page")
    seen = anchors.join(pages, "doc", "left").groupBy(*key).agg(*(F.coalesce(F.max(c.cast("int")), F.lit(0)).alias(n) for c, n in ((exact & own, "exact"), (folded & own, "folded"), (exact | folded, "other"))), F.max(F.when(own, F.col("text"))).alias("own_text"))
    # Only quotes that every exact test leaves open are compared letter by letter.
    open_ = F.when((F.col("exact") + F.col("folded") + F.col("other") == 0) & (F.length("quote") > 0), F.col("own_text"))
    likeness = partial_ratio_from(LEAST_LIKENESS)(F.col("quote"), open_) if fuzzy else F.lit(None).cast("double")
    rows = seen.withColumn("likeness", likeness).join(known, "doc", "left")
    broken = F.col("doc").isNull() | F.col("page").isNull() | (F.coalesce("quote", F.lit("")) == "")
    status = F.when(broken, "schema").when(F.col("last_page").isNull(), "no_file").when((F.col("page") < 1) | (F.col("page") > F.col("last_page")), "page_range")
    status = status.when(F.col("exact") == 1, "ok").when(F.col("folded") == 1, "case").when(F.col("other") == 1, "wrong_page").when(F.coalesce(F.col("likeness") >= LEAST_LIKENESS, F.lit(False)), "fuzzy").otherwise("not_found")
    return rows.select("id", "place", "doc", "page", status.alias("status"))


def index_status(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (id, place, doc, page, status): no_doc, split (no chunk holds the quote), ok (a chunk that spans its page does), page_off."""
    key, holds = ["id", "place", "doc", "page", "quote"], F.col("text").contains(F.col("quote"))
    spans = F.col("page").between(F.col("page_start"), F.col("page_end"))
    seen = anchors.join(chunks.select("doc", "page_start", "page_end", "text"), "doc", "left").groupBy(*key).agg(F.count("text").alias("n"), F.coalesce(F.max(holds.cast("int")), F.lit(0)).alias("held"), F.coalesce(F.max((holds & spans).cast("int")), F.lit(0)).alias("right"))
    status = F.when(F.col("n") == 0, "no_doc").when(F.col("held") == 0, "split").when(F.col("right") == 1, "ok").otherwise("page_off")
    return seen.select("id", "place", "doc", "page", status.alias("status"))


def coverage(documents: DataFrame, anchors: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows (doc, n_anchors, n_questions) for every document, those without any included."""
    counts = anchors.groupBy(doc).agg(F.count("*").alias("n_anchors"), F.countDistinct("id").alias("n_questions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.select(doc).distinct().join(counts, doc, "left").select(doc, zero("n_anchors"), zero("n_questions"))


def quote_words(text: Column) -> Column:
    return T.canonical(text)


def covers(answer: Column, quote: Column, fuzzy: bool = True) -> Column:
    """Does an answer say what a quote does: all its numbers, where it has any, otherwise enough of its words."""
    wanted = T.numbers(quote)
    by_numbers = F.size(F.array_except(wanted, T.numbers(answer))) == 0
    # Rows with numbers reach the fuzzy measure as nulls.
    some = F.size(wanted) > 0
    by_words = F.coalesce(token_set_ratio(F.when(~some, T.canonical(answer)), T.canonical(quote)) >= LEAST_LIKENESS, F.lit(False)) if fuzzy else T.canonical(answer).contains(T.canonical(quote))
    return F.when(some, by_numbers).otherwise(by_words)


def answer_checks(answers: DataFrame, anchors: DataFrame, cited: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Rows (id, content_ok, citation_ok, anchors_found): does the answer cover every anchor, and cite every anchor's page? answers: (id, answer); cited: (id, doc, page)."""
    pages = cited.select("id", "doc", "page", F.lit(True).alias("named")).distinct()
    rows = anchors.join(answers.select("id", "answer"), "id").join(pages, ["id", "doc", "page"], "left")
    checked = rows.withColumn("covered", covers(F.coalesce("answer", F.lit("")), F.col("quote"), fuzzy))
    return checked.groupBy("id").agg(F.bool_and("covered").alias("content_ok"), F.bool_and(F.coalesce("named", F.lit(False))).alias("citation_ok"), F.count_if("covered").alias("anchors_found"))
