"""Documents to packed sequences: language, quality, near duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four
return rows of documents as they are, columns and all; a row's identity is the row, so null and
repeated ids do no harm. The last gives the pieces of sequences with their token ids. Thresholds reject only what the models are clear about.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontamination import decontaminate
from tessera.llm.language import UNDETERMINED, score_languages, train_language_model
from tessera.llm.near_duplicates import link_near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.quality import score_quality, train_quality_model
from tessera.llm.queries import CAPACITY, END_ID, learned, vocabulary
from tessera.llm.shared import Scratch, materialize, table

#: Share of the winning language from which a document is of that language.
LEAST_LANGUAGE = 0.5
#: Score below which a document is rejected.
LEAST_QUALITY = 0.5


def _passed(docs: DataFrame, flag: Callable[[DataFrame, list[str], str], DataFrame], condition: str) -> DataFrame:
    """The rows of which flag(rows, their columns, their text) says the condition, columns and all, whatever their names."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    text = plain[docs.columns.index("text")]
    return flag(docs.toDF(*plain), plain, text).where(condition).select(*plain).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that was learned; null texts and texts without a letter go. Without labels of languages nothing stays."""
    trees = train_language_model(learned(docs, 4, 2))
    return _passed(docs, lambda rows, kept, text: score_languages(rows, trees, kept, text), f"lang_pred <> '{UNDETERMINED}' and score >= {LEAST_LANGUAGE}")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't hold for class 0; without labels of both classes all stay, or where all are 0, none."""
    model = train_quality_model(learned(docs, 4, 2), labels=learned(table(spark, sf_dir, "labels"), 4, 2))
    return _passed(docs, lambda rows, kept, text: score_quality(rows, model, kept, text), f"score >= {LEAST_QUALITY}")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group stays, null last; of rows that share it, one; of rows equal in every column, one.

    Texts without words are no copies of each other. A row is known by its id and two hashes of all its columns."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (plain[docs.columns.index(c)] for c in ("doc_id", "text"))
    # Maps have no hash of their own.
    hashed = [F.col(c).cast("string") if "map<" in t else F.col(c) for c, t in docs.toDF(*plain).dtypes]
    marks = [F.xxhash64(F.lit(i), *hashed).alias(f"mark{i}") for i in (0, 1)]
    rows = docs.toDF(*plain).withColumn("row", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), *marks))
    kept = link_near_duplicates(rows, "row", text).where("kept").select("row").distinct()
    return rows.dropDuplicates(["row"]).join(kept, "row", "left_semi").select(*plain).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of any item; all, where there are no items."""
    return _passed(docs, lambda rows, kept, text: decontaminate(rows, table(spark, sf_dir, "benchmark"), kept, text), "not contaminated")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids; a null or empty text is the end id alone."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), END_ID, CAPACITY, with_ids=True)


STAGES = [("language_id", language_id), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Models and tokens aren't expressible in SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are a table that goes when the next one is written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), "documents")
    return STAGES[-1][1](spark, docs, sf_dir)
