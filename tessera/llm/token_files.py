"""Token ids in binary files: bit-plane shuffled, compressed by plane, with a chunk index.

A chunk holds up to CHUNK_IDS ids, transposed into byte planes (or bit planes), each compressed with
zstandard; planes that are zero throughout are not stored. A file is

    chunk ... chunk | document index | chunk index | footer

where every record ends in one line feed: Spark's own writer puts the bytes down, with its commit
protocol, on any file system it knows, and its binary reader takes them up again. The document index
holds ids and lengths of the documents that start in the file; the chunk index holds for every chunk
its byte offset and first id. Files are in ascending order of document id (nulls first, equal ids by
a hash of their text, then the text, so that rows which share an id, null included, are dealt to as many
tasks as they need); a partition starts a new file after RECORDS_PER_FILE records, so no file grows without
bound. Reading holds one chunk's ids and one slice of documents at a time beside the file's bytes.

Null text counts as empty and gives the end id alone. An empty table writes no documents. Other
columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import codec
from .shared import byte_slices, in_arrow, named, partitions_for

CHUNK_IDS = 1 << 16
RECORDS_PER_FILE = 512
#: Ids, or 16 a document, that a batch of read documents holds.
SLICE_IDS = 1 << 20
_CHUNK, _FOOTER = struct.Struct("<4sBII"), struct.Struct("<4sQQQQQ")  # magic, kind, ids, mask | magic, two offsets, docs, ids, chunks
_MAGIC = b"TBP1"
_KINDS = {"byte": 8, "bit": 1}


def encode_chunk(ids: np.ndarray, planes: str = "byte", level: int = 3) -> bytes:
    width = _KINDS[planes]
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    table = raw.T if width == 8 else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    packed, mask, press = [], 0, zstandard.ZstdCompressor(level=level)
    for i, plane in enumerate(table):
        if plane.any():
            mask |= 1 << i
            data = press.compress(np.ascontiguousarray(plane).tobytes())
            packed.append(struct.pack("<I", len(data)) + data)
    return _CHUNK.pack(_MAGIC, width, len(ids), mask) + b"".join(packed)


def decode_chunk(data: bytes | memoryview) -> np.ndarray:
    magic, width, n, mask = _CHUNK.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a chunk of token ids")
    at, count, size = _CHUNK.size, 32 // width, n if width == 8 else (n + 7) // 8
    table = np.zeros((count, size), dtype=np.uint8)
    press = zstandard.ZstdDecompressor()
    for i in range(count):
        if mask >> i & 1:
            (length,) = struct.unpack_from("<I", data, at)
            table[i] = np.frombuffer(press.decompress(data[at + 4 : at + 4 + length], max_output_size=size), dtype=np.uint8)
            at += 4 + length
    if width == 8:
        return np.ascontiguousarray(table.T).view("<u4").ravel()
    bits = np.unpackbits(table, axis=1)[:, :n]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


class FileBuilder:
    """Records of one file after the other."""

    def __init__(self, planes: str, records: int):
        self.planes, self.records = planes, records
        self._start()

    def _start(self) -> None:
        self.at, self.ids, self.chunks, self.docs, self.pending, self.held = 0, 0, [], [], [], 0

    def _put(self, record: bytes) -> bytes:
        self.at += len(record) + 1
        return record

    def _chunk(self) -> bytes:
        """The pending ids, of which there are no more than a chunk holds."""
        now = np.concatenate(self.pending)
        self.pending, self.held = [], 0
        self.chunks.append((self.at, self.ids))
        self.ids += len(now)
        return self._put(encode_chunk(now, self.planes))

    def add(self, key: int | None, ids: np.ndarray) -> Iterator[bytes]:
        if len(self.chunks) >= self.records - 4:
            yield from self.close()
        self.docs.append((key is not None, key or 0, len(ids)))
        while len(ids):
            # A copy, so that what is pending doesn't hold its whole slice.
            self.pending.append(ids[: CHUNK_IDS - self.held].copy())
            ids = ids[CHUNK_IDS - self.held :]
            self.held += len(self.pending[-1])
            if self.held == CHUNK_IDS:
                yield self._chunk()

    def close(self) -> Iterator[bytes]:
        """The rest of the file. Empty records bring it to its full count, so that the writer starts the next file here."""
        if not self.docs:
            return
        if self.held:
            yield self._chunk()
        count = len(self.chunks)
        press = zstandard.ZstdCompressor()
        known, keys, lengths = (np.asarray(x) for x in zip(*self.docs, strict=True))
        docs_at = self.at
        yield self._put(press.compress(known.astype(np.uint8).tobytes() + np.diff(keys.astype("<i8"), prepend=0).astype("<i8").tobytes() + lengths.astype("<u8").tobytes()))
        chunks_at = self.at
        yield self._put(press.compress(np.asarray(self.chunks, dtype="<u8").reshape(-1, 2).tobytes()))
        footer = _FOOTER.pack(_MAGIC, docs_at, chunks_at, len(self.docs), self.ids, count)
        for _ in range(count + 3, self.records):
            yield b""
        yield footer
        self._start()


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, planes: str = "byte", id_col: str = "doc_id", text_col: str = "text", records: int = RECORDS_PER_FILE) -> None:
    """Writes the files under `path`. id_col is an integer column."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = codec(vocabulary, with_ids=True), FileBuilder(planes, records)

        def rows(found: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["record"])

        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                out: list[bytes] = []
                counts, ids = encoder.answers(batch.column(1)[a:b], end_id)
                for key, part in zip(batch.column(0)[a:b].to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    out += file.add(key, part)
                yield rows(out)
        yield rows(list(file.close()))

    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions_for(docs), "id", "mark").sortWithinPartitions("id", "mark", "text").select("id", "text")
    records_ = in_arrow(dealt, build, "record binary")
    records_.select(F.col("record").cast("string")).write.option("maxRecordsPerFile", records).option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 1").select("path", "content")


def _footer(content: bytes) -> tuple:
    found = _FOOTER.unpack_from(content, len(content) - 1 - _FOOTER.size)
    if found[0] != _MAGIC:
        raise ValueError("not a file of token ids")
    return found[1:]


def _order(path: str) -> int:
    """Place of a file: number of the writer's task, then of the file within it."""
    task, file = re.search(r"part-(\d+)-.*?(?:-c(\d+))?(?:\.\w+)*$", path).groups()
    return int(task) << 24 | int(file or 0)


def read_chunk(content: bytes, number: int) -> tuple[int, np.ndarray]:
    """(first id's place in the file, ids) of one chunk, found through the chunk index without reading the others."""
    _, chunks_at, _, _, count = _footer(content)
    if not 0 <= number < count:
        raise IndexError(number)
    at, first = (int(x) for x in _index(content, chunks_at, count)[number])
    return first, decode_chunk(memoryview(content)[at:])


def _index(content: bytes, chunks_at: int, count: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(content[chunks_at:])
    return np.frombuffer(raw, "<u8").reshape(count, 2)


def _documents(content: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, start in the file, ids) of every document."""
    docs_at, chunks_at, n, _, count = _footer(content)
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(content[docs_at:chunks_at])
    known = np.frombuffer(raw, np.uint8, n)
    keys, lengths = np.cumsum(np.frombuffer(raw, "<i8", n, n)), np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
    index = _index(content, chunks_at, count)
    buffer, first, chunk, at = np.empty(0, np.uint32), 0, 0, 0
    for ok, key, length in zip(known.tolist(), keys.tolist(), lengths.tolist(), strict=True):
        parts = []
        while first + len(buffer) < at + length:
            parts.append(buffer[max(0, at - first) :])
            first += len(buffer)
            buffer, chunk = decode_chunk(memoryview(content)[int(index[chunk][0]) :]), chunk + 1
        parts.append(buffer[max(0, at - first) : at + length - first])
        yield (key if ok else None), at, np.concatenate(parts)
        at += length


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with_ids the ids."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pydict({"path": [path_], "place": [_order(path_)], "ids": [_footer(content.as_py())[3]]})

    n = 6 if with_ids else 5
    names = ["path", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][:n]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][:n]

    def slices_of(path_: str, content: bytes) -> Iterator[list[tuple]]:
        rows, held = [], 0
        for key, start, ids in _documents(content):
            rows.append((path_, key, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), ids.tolist() if with_ids else None)[:n])
            held += 16 + (len(ids) if with_ids else 0)
            if held >= SLICE_IDS:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for rows in slices_of(path_, content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = _files(spark, path)
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_arrow(files, totals, "path string, place long, ids long").select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    rows = in_arrow(files, documents, "path string, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
    return rows.join(offsets, "path").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
