"""What the operators share: shared storage, folds of documents, slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Characters of text that a Python worker takes apart at a time; keeps memory flat whatever the batch holds.
SLICE_CHARS = 2 << 20
#: Bytes of text that a worker takes apart at a time where Arrow does it.
SLICE_BYTES = 2 << 20
#: Bytes of rows that go to a Python worker at a time, and Spark's setting for it. The default lets 10,000 texts come at once, each several times in memory.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's switch for removing shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of stored input to a partition that a shuffle of texts makes, and the most partitions.
PARTITION_BYTES, MOST_PARTITIONS = 32 << 20, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def struct(fields: Sequence[StructField], more: str) -> StructType:
    """Fields as they are, whatever their names, and more in DDL."""
    return StructType([StructField(f.name, f.dataType, True) for f in fields] + StructType.fromDDL(more).fields)


def in_arrow(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow with batches bounded in bytes, for this session from here on; a row is never parted, and a smaller bound of the session's stays."""
    spark = rows.sparkSession
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return rows.mapInArrow(work, schema)


def per_text(docs: DataFrame, text_col: str, kept: Sequence[str], work: Callable[[], Callable[[pa.Array], list[pa.Array]]], more: str, extra: Sequence[Column] = ()) -> DataFrame:
    """The kept columns, `extra` columns and `more`, which work()(texts) gives for an array of texts without nulls.

    work is called once a task. A text crosses to Python once, and back only where it is among the kept columns.
    """
    fields = [docs.schema[c] for c in kept]
    with_text = [f.name == text_col and f.dataType.typeName() == "string" for f in fields]
    others = [named(f.name) for f, own in zip(fields, with_text, strict=True) if not own]
    rows = docs.select(named(text_col).cast("string").alias("text"), *others, *extra)
    added = rows.schema.fields[1 + len(others) :]
    schema = struct([*fields, *added], more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = work()
        for batch in batches:
            texts = batch.column(0)
            found = [answer(pc.fill_null(texts[a:b], "")) for a, b in byte_slices(texts)]
            new = [pa.concat_arrays(x) for x in zip(*found, strict=True)] if found else [pa.array([], f.type) for f in answer(texts)]
            rest = iter(batch.columns[1:])
            yield pa.RecordBatch.from_arrays([*(texts if own else next(rest) for own in with_text), *rest, *new], names=schema.names)

    return in_arrow(rows, run, schema)


def partitions_for(docs: DataFrame) -> int:
    """Partitions for a shuffle of the texts of `docs`: by the size of its sources, the session's number at least."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sources = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(sources.apply(i).stats().sizeInBytes()) for i in range(sources.size())]
    # Sources of unknown size are given an impossible one.
    return max(least, min(MOST_PARTITIONS, sum(x for x in sizes if x < 1 << 60) // PARTITION_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a folder of our own, in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, and outlives any executor."""
    return Scratch(df.sparkSession).save(df, name)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of our own from the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables of one operator in the shared folder. What its result doesn't read is dropped as soon as it has been read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The rows as a table; one of the same name is dropped once this one is written."""
        path, old = fresh_path(self.spark, name), self.paths.get(name)
        # Nothing reads the shuffles of a written table again: they go with the write and don't wait for the driver's garbage.
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        if old:
            remove(self.spark, old)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key has remainder 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def rate_of(salt: str, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys alone: thresholds on it draw the same rows in every run."""
    return F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slice_of(text: Column, chars: int, salt: str) -> Column:
    """The text, or of a longer one `chars` characters from a place that its hash chooses."""
    places = F.greatest(F.char_length(text) - chars + 1, F.lit(1))
    return F.substring(text, (1 + F.pmod(F.xxhash64(text, F.lit(salt)), places)).cast("int"), F.lit(chars))


def labelled_sample(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, label_col: str, per_class: int, chars: int, salt: str) -> tuple[DataFrame | None, dict[int, int]]:
    """Rows (text, label) of about `per_class` ids a class, drawn by a hash of the id, and the labels by class.

    labels: where they lie in a table of their own. They are drawn before they meet any text, so that what
    is broadcast is bounded by `per_class` and texts stay where they are read. Null texts are left out; of
    a text of over `chars` characters a slice is taken, so the sample is bounded in bytes as well; of rows
    that repeat an id, one is taken; without labels the sample is None.
    """
    marks = (docs if labels is None else labels).select(named(id_col).alias("id"), named(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if not counts:
        return None, counts
    rates = F.create_map(*(x for label, n in counts.items() for x in (F.lit(label), F.lit(min(1.0, per_class / n)))))
    drawn = marks.where(rate_of(salt, "id") < rates[F.col("label")]).distinct()
    texts = docs.select(named(id_col).alias("id"), slice_of(named(text_col).cast("string"), chars, salt).alias("text")).where("text is not null")
    return texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label"), counts


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about `limit` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start, before = stop, int(ends[stop - 1])


def slices(texts: Sequence[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of about `limit` characters, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def null_to_empty(texts: Sequence[str | None]) -> list[str]:
    return ["" if t is None else t for t in texts]
