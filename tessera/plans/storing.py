"""Queries of the store that batches and streams are put into, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_path
from tessera.sources.tables import read_table, stream_table
from tessera.streaming.store import Store, put_stream

#: Documents shorter than this are taken out again.
LEAST_CHARS = 300


def _revision(docs: DataFrame, number: int) -> DataFrame:
    """A later revision of a text holds no digits."""
    text = F.regexp_replace("text", "[0-9]", "") if number > 1 else F.col("text")
    return docs.select("doc_id", F.lit(number).alias("revision"), F.length(text).alias("length"), F.sha2(text, 256).alias("digest"))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents put at once; a stream with the second revision of those in English, put again from a checkpoint that begins anew, as is the first revision; short ones taken out."""
    docs = read_table(spark, sf_dir, "documents")
    store = Store(spark, shared_path(spark, "store"), _revision(docs, 1).schema, "doc_id", buckets=8, order="revision")
    store.put(_revision(docs, 1))
    arriving = stream_table(spark, sf_dir, "documents").where("lang = 'en'")
    for _ in range(2):
        put_stream(_revision(arriving, 2), store, shared_path(spark, "progress"), once=True).awaitTermination()
        store.put(_revision(docs, 1))
    store.remove(docs.where(F.length("text") < LEAST_CHARS).select("doc_id"))
    store.vacuum(1, grace=0)
    return store.rows()


QUERIES = {f.__name__: f for f in (stored_documents,)}

_SECOND = "case when lang = 'en' then regexp_replace(text, '[0-9]', '', 'g') else text end"

ORACLES = {
    "stored_documents": f"select doc_id, case when lang = 'en' then 2 else 1 end as revision, length({_SECOND})::int as length, sha256({_SECOND}) as digest from documents where length(text) >= {LEAST_CHARS} or text is null",
}
