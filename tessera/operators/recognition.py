"""Comparing recognition methods by character error rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

LANGUAGES = ("TR", "EN")
UNKNOWN = "??"


def reference_texts(documents: DataFrame, manual: DataFrame, overrides: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (doc, reference, scope): a manual transcription goes before another document's pages, those before a document's own text layer.

    documents: (doc); manual: (doc, text); overrides: (doc, of_doc, page_from, page_to); pages: (doc, page_no, text). scope is pages
    where only some pages are compared, which keeps the document out of rankings; a document without any text has a null reference.
    """

    def joined(rows: DataFrame, name: str) -> DataFrame:
        held = F.array_sort(F.collect_list(F.struct("page_no", "text")))
        return rows.groupBy("doc").agg(F.array_join(held["text"], " ").alias(name))

    other = overrides.join(pages.withColumnRenamed("doc", "of_doc"), "of_doc").where(F.col("page_no").between(F.col("page_from"), F.col("page_to")))
    rows = documents.join(manual.select("doc", F.col("text").alias("by_hand")), "doc", "left").join(joined(other, "by_pages"), "doc", "left").join(joined(pages, "own"), "doc", "left")
    scope = F.when(F.col("by_hand").isNull() & F.col("by_pages").isNotNull(), "pages").otherwise("document")
    return rows.select("doc", F.coalesce("by_hand", "by_pages", "own").alias("reference"), scope.alias("scope"))


def scored_runs(runs: DataFrame, references: DataFrame, languages: DataFrame, elapsed: DataFrame) -> DataFrame:
    """The runs (method, doc, text) with cer, lang (?? where unknown), seconds (null where not measured) and scope; documents without a reference have no cer."""
    rows = runs.join(references, "doc", "left").join(languages.select("doc", "lang"), "doc", "left").join(elapsed.select("doc", "method", "seconds"), ["doc", "method"], "left")
    cer = T.error_rate(F.coalesce(T.normalize(F.col("text")), F.lit("")), T.normalize(F.col("reference")))
    return rows.select("method", "doc", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "scope", cer.alias("cer"), "seconds")


def method_ranking(scored: DataFrame, by: str = "method", languages: Sequence[str] = LANGUAGES, least_seconds: Column | None = None) -> DataFrame:
    """Rows (by, a mean cer a language, worst, seconds, rank): rank 1 has the smallest worst language, of equals the fastest, then the first by name.

    Runs over some pages only are left out; a language without runs doesn't count.
    """
    whole = scored.where(F.coalesce(F.col("scope"), F.lit("document")) == "document")
    means = whole.groupBy(by).agg(*(F.avg(F.when(F.col("lang") == x, F.col("cer"))).alias(f"cer_{x.lower()}") for x in languages), F.avg("seconds").alias("seconds"))
    rows = means.withColumn("worst", F.greatest(*(f"cer_{x.lower()}" for x in languages)))
    order = Window.orderBy(F.col("worst").asc_nulls_last(), F.col("seconds").asc_nulls_last(), by)
    return rows.withColumn("rank", F.row_number().over(order))
