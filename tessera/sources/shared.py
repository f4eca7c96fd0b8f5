"""Places that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that spark.checkpoint.dir names; without one, in a folder of its own, in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='tessera-')}/{name}-{uuid.uuid4().hex}"


#: Bytes of rows that go to a Python worker at a time, and Spark's setting for it. The default lets 10,000 texts come at once, each several times in memory.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at a time, for this session from here on; a smaller bound of the session's stays."""
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """The rows with a hint to broadcast them if there are `most` at most, else as they are. They are counted, so they should be cheap to read."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what is read more than once is worked out once."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def with_texts(hits: DataFrame, texts: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """The hits with the text of their keys. Hits are written, and broadcast if there are few, so that texts stay where they lie."""
    found = written(hits, "hits")
    return texts.select(*keys, text_col).join(bounded(found, 1_000_000), list(keys)).select(*found.columns, text_col)
