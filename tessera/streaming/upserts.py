"""Documents that arrive over time: each batch replaces the documents that it brings again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_documents(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of other documents, then the new ones. Null is a document like any other."""
    brought = new.select(F.col(key).alias("brought")).distinct()
    return old.join(brought, F.col(key).eqNullSafe(F.col("brought")), "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each document the rows of its greatest `order`, all of them."""
    last = rows.groupBy(key).agg(F.max(order).alias("greatest")).withColumnRenamed(key, "of")
    return rows.join(last, F.col(key).eqNullSafe(F.col("of")) & F.col(order).eqNullSafe(F.col("greatest"))).drop("of", "greatest")


def documents_of(index: DataFrame, doc: str = "doc", pos: str = "pos") -> DataFrame:
    """Rows (doc, chunks, first) in the order in which documents came."""
    return index.groupBy(doc).agg(F.count("*").alias("chunks"), F.min(pos).alias("first")).orderBy("first")


def upsert_report(old: DataFrame, pages: DataFrame, chunks: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows (doc, pages, ocr_pages, chunks, updated): what a batch brought, and whether the document was there before."""
    ocr = F.count_if(F.col("method") != "text_layer")
    rows = pages.groupBy(doc).agg(F.count("*").alias("pages"), ocr.alias("ocr_pages"))
    counts = chunks.groupBy(doc).agg(F.count("*").alias("chunks"))
    known = old.select(doc, F.lit(True).alias("updated")).distinct()
    return rows.join(counts, doc, "left").join(known, doc, "left").select(doc, "pages", "ocr_pages", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("updated", F.lit(False)).alias("updated"))
