"""A table of documents that several writers put batches into: a log of versions, each written once.

Rows lie in buckets by a hash of the document's name. A write rewrites the buckets that it touches, into a
folder of its own that nobody else ever writes to, and then adds one entry to the log: the number after the
last, the folder of every bucket as of then, and the last batch of every stream. An entry is put in place by
a rename that fails where one is there already, so of two writers with the same number one goes again: over
the entry in between where that left its buckets alone, with a fresh rewrite where it didn't. Numbers are the
table's own: a batch's number only says, under the name of its stream, whether it has been put before.

Readers take the files of one entry, so they never see half a write, and older entries can be read until
`vacuum`. The log's entries are bounded by buckets and streams, not by rows. The rename must be exclusive, as it is on HDFS;
on a local disk it is checked, then done.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.streaming.upserts import latest, replace_documents

#: Parts of a table; a batch rewrites those that its documents fall into.
BUCKETS = 64
#: Column of the bucket's number, which no table may have itself.
BUCKET = "_bucket"
#: Seconds for which a folder that no entry names may still belong to a writer at work.
GRACE = 24 * 3600


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Version:
    """An entry of the log: its number, the folder of each bucket, and the last batch of each stream."""

    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"folders": self.folders, "streams": self.streams}, sort_keys=True)


class Store:
    """The table under `path`, which driver and executors share. order: a column whose greatest value tells which rows of a document count, whatever the order in which they were put."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = BUCKETS, order: str | None = None):
        if BUCKET in schema.names:
            raise ValueError(f"a stored table has no column {BUCKET}")
        self.spark, self.path, self.schema, self.key, self.buckets, self.order = spark, path.rstrip("/"), schema, key, buckets, order
        hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._files = hadoop.Path(self.path).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(hadoop.Path(self.path).toUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        self._keep[0] = getattr(hadoop, "Options$Rename").NONE

    def _place(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return [f.getPath().getName() for f in self._files.listStatus(place)] if self._files.exists(place) else []

    def versions(self) -> list[int]:
        """Numbers of the entries that are still there."""
        return sorted(int(n) for n in self._names("log") if n.isdigit())

    def version(self, number: int | None = None) -> Version:
        """An entry, the last if none is asked for; an empty one where nothing was put yet."""
        numbers = self.versions()
        if number is None and not numbers:
            return Version()
        if number is not None and number not in numbers:
            raise LookupError(f"version {number} is not, or no longer, in {self.path}")
        number = numbers[-1] if number is None else number
        source = self._files.open(self._place(f"log/{number:020d}"))
        try:
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()
        return Version(number, held["folders"], held["streams"])

    def _commit(self, version: Version) -> bool:
        """Puts the entry in the log, unless there is one of its number."""
        draft = self._place(f"drafts/{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        try:
            out.write(bytearray(version.text().encode()))
        finally:
            out.close()
        self._files.mkdirs(self._place("log"))
        try:
            self._context.rename(draft, self._place(f"log/{version.number:020d}"), self._keep)
        except Py4JJavaError as refused:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in refused.java_exception.getClass().getName():
                return False
            raise
        return True

    def _read(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self, version: int | None = None) -> DataFrame:
        """The table as of a version."""
        return self._read(self.version(version).folders)

    def exists(self) -> bool:
        return bool(self.version().folders)

    def put(self, batch: DataFrame, stream: str | None = None, number: int | None = None) -> int:
        """Replaces the batch's documents and gives the version that holds it. A batch of a stream that was put before changes nothing."""
        return self._apply(batch.select(*self.schema.names), batch.select(self.key), stream, number)

    def remove(self, keys: DataFrame) -> int:
        """Takes documents out. keys: a table with the store's key."""
        return self._apply(self.spark.createDataFrame([], self.schema), keys.select(self.key), None, None)

    def _apply(self, new: DataFrame, keys: DataFrame, stream: str | None, number: int | None) -> int:
        touched = {str(r[0]) for r in keys.select(bucket(F.col(self.key), self.buckets)).distinct().collect()}
        base, written = None, None
        while True:
            seen = self.version()
            if stream is not None and seen.streams.get(stream, -1) >= number:
                self._discard(written)
                return seen.number
            same = base is not None and all(base.folders.get(b) == seen.folders.get(b) for b in touched)
            if not same:
                self._discard(written)
                base, written = seen, uuid.uuid4().hex
                self._write(self._read({b: f for b, f in seen.folders.items() if b in touched}), new, keys, written)
            found = {n.partition("=")[2]: written for n in self._names(f"data/{written}") if n.startswith(f"{BUCKET}=")}
            folders = {b: f for b, f in seen.folders.items() if b not in touched} | found
            streams = seen.streams | ({stream: number} if stream is not None else {})
            if self._commit(Version(seen.number + 1, folders, streams)):
                return seen.number + 1

    def _write(self, old: DataFrame, new: DataFrame, keys: DataFrame, folder: str) -> None:
        if self.order:
            # Rows that are there and rows that come compete, and of equals those that come stay: the end is the same in any order of puts.
            brought = new.select(F.col(self.key).alias("_brought")).distinct()
            competing = old.join(brought, F.col(self.key).eqNullSafe(F.col("_brought")), "left_semi")
            turn = lambda rows, side: rows.withColumn("_turn", F.struct(F.col(self.order), F.lit(side)))
            new = latest(turn(competing, 0).unionByName(turn(new, 1)), self.key, "_turn").drop("_turn")
        gone = keys.select(F.col(self.key)).distinct()
        kept = old.join(gone.withColumnRenamed(self.key, "_gone"), F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti").unionByName(new)
        # A bucket is one file, or several where it is large: the rows are dealt by size.
        dealt = kept.withColumn(BUCKET, bucket(F.col(self.key), self.buckets)).hint("rebalance", BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")

    def _discard(self, folder: str | None) -> None:
        if folder:
            self._files.delete(self._place(f"data/{folder}"), True)

    def vacuum(self, keep: int = 2, grace: float = GRACE) -> None:
        """Deletes all but the last `keep` entries, and folders older than `grace` seconds that these don't name. Who reads an older version by then reads nothing."""
        numbers = self.versions()
        used = {f for n in numbers[-keep:] for f in self.version(n).folders.values()}
        for n in numbers[:-keep]:
            self._files.delete(self._place(f"log/{n:020d}"), False)
        before = (time.time() - grace) * 1000
        for folder in ("data", "drafts"):
            place = self._place(folder)
            for f in self._files.listStatus(place) if self._files.exists(place) else []:
                if f.getPath().getName() not in used and f.getModificationTime() <= before:
                    self._files.delete(f.getPath(), True)

    def clear(self) -> int:
        """Takes all documents out; gives their number. Clearing again gives 0. The streams' batches count as put."""
        n = self.rows().select(self.key).distinct().count()
        while n:
            seen = self.version()
            if self._commit(Version(seen.number + 1, {}, seen.streams)):
                break
        return n


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint; a checkpoint that begins anew has a new one."""
    lines = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").collect()
    return json.loads("".join(r.value for r in lines))["id"]


def put_stream(source: DataFrame, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Puts each micro-batch into the store; of a document that a batch brings twice, the store's `order` decides. once: ends when all that is there has been put."""
    name: list[str] = []

    def apply(batch: DataFrame, number: int) -> None:
        if not name:
            name.append(stream_name(store.spark, checkpoint))
        store.put(batch, name[0], number)

    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
