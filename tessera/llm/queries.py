"""The thin queries over the standard tables, by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import decontaminate
from .language import score_languages, train_language_model
from .language_model import score_texts
from .near_duplicates import link_near_duplicates
from .packing import pack_documents
from .periodic_runs import find_runs
from .quality import score_quality, train_quality_model
from .secret_scan import PATTERNS, scan_secrets
from .shared import fresh_path, remainder, table
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .toxicity import score_toxicity, train_toxicity
from .vector_codes import code_vectors
from .vector_duplicates import link_vectors

#: Documents of more tokens than this don't fit one context.
TOKEN_LIMIT = 512
END_ID = 1
CAPACITY = 2048
#: From this score on a document is of the class.
LIKELY = 0.7


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(n: int, which: int):
    return (remainder(F.col("doc_id"), n) == which).alias("held_out")


def learned(rows: DataFrame, n: int, held_out: int) -> DataFrame:
    """Documents or labels outside the fold that is held out."""
    return rows.where(remainder(F.col("doc_id"), n) != held_out)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality_model(learned(docs, 4, 2), labels=learned(table(spark, sf_dir, "labels"), 4, 2))
    scored = score_quality(docs, model, ["doc_id"], "text", _held_out(4, 2))
    return scored.withColumn("predicted", (F.col("score") >= LIKELY).cast("int"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=0.85).drop("class", "copies")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train_language_model(learned(docs, 4, 2))
    return score_languages(docs, trees, ["doc_id"], "text", _held_out(4, 2))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.drop("items", "spans")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END_ID, CAPACITY)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), END_ID)
    return read_token_files(spark, path)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op9_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = train_toxicity(learned(docs, 3, 1), labels=learned(table(spark, sf_dir, "labels"), 3, 1))
    scored = score_toxicity(docs, lexicon, ["doc_id"], "text", _held_out(3, 1))
    return scored.withColumn("predicted", (F.col("score") >= LIKELY).cast("int"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code_vectors(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.hex("code")).alias("code")
    return found.rows.select("vec_id", code, "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("known", lambda s: s["kind"] == kind))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [_number(p.kind).cast("long").alias(f"n_{p.kind}") for p in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_listed("known"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def _with_periods(doc_id: Column, text: Column) -> tuple[Column, Column, Column]:
    """A text's words, whether its id chooses it (one in ten, a null id never), and the text whose words repeat from one on; that reads a column `words`."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    repeated = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.col("words")[(a + (i - a) % p).cast("int")]))
    return words, h % 10 == 0, F.array_join(repeated, " ")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, chosen, repeated = _with_periods(F.col("doc_id"), F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(chosen, words).alias("words"))
    docs = docs.select("doc_id", F.when(F.size("words") > 0, repeated).otherwise(F.col("text")).alias("text"))
    found = find_runs(docs, ["doc_id"])
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    best = found.withColumn("best", longest).withColumn("length", -F.col("best.shortness"))
    exponent = F.floor(1000 * F.col("length") / F.col("best.period")).alias("exponent_milli")
    digests = [F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")]
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"), exponent, *digests)


QUERIES = {f.__name__: f for f in (op1_quality, op2_token_counts, op3_near_duplicates, op4_language, op5_decontamination, op6_packing, op7_token_files, op8_language_model, op9_vector_duplicates, op10_toxicity, op11_vector_codes, op12_secrets, op13_periodic_runs)}
