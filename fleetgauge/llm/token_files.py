"""Token ids in Arrow IPC files of fixed-size lists.

Every file holds sequences of one length: column `ids` is a fixed-size list of unsigned integers, column `mask` a
fixed-size list of booleans (false on the padding at the end of a file). Batches have one number of sequences, so that
a sequence is found by division, and a memory map gives its ids without copying. Documents follow each other in
ascending order of their keys, each with an end id; a manifest in Parquet says where each one starts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import run_dir
from .common import chunks, utf8
from .vocabulary import encoder

SEQUENCE = 2048
#: Sequences of a record batch.
BATCH = 256

MANIFEST = "file string, part int, nth long, doc_id long, start long, n_tokens long"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    """Writes ids, given piece by piece, as sequences of equal length."""

    def __init__(self, uri: str, width: int, length: int = SEQUENCE):
        system, path = _place(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        self.kind, self.length = (pa.uint16() if width == 2 else pa.uint32()), length
        self.schema = pa.schema({"ids": pa.list_(self.kind, length), "mask": pa.list_(pa.bool_(), length)})
        self.sink = system.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.dtype, self.held, self.size = np.dtype("<u2" if width == 2 else "<u4"), [], 0
        self.full = BATCH * length * self.dtype.itemsize

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.full:
            data = b"".join(self.held)
            for at in range(0, len(data) - self.full + 1, self.full):
                self._batch(np.frombuffer(data, self.dtype, BATCH * self.length, at), BATCH * self.length)
            self.held = [data[len(data) // self.full * self.full:]]
            self.size = len(self.held[0])

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [lists[0].cast(self.schema.field(0).type), lists[1]], schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        if len(ids):
            self._batch(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.out.close()
        self.sink.close()


class Reader:
    """Random access to a file: sequences, masks and ranges of ids; local files are mapped, not read."""

    def __init__(self, uri: str):
        system, path = _place(uri)
        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch_at, self.batch = -1, None

    def _load(self, k: int) -> pa.RecordBatch:
        if k != self.batch_at:
            self.batch_at, self.batch = k, self.file.get_batch(k)
        return self.batch

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the mapped file) and mask of sequence k."""
        batch, row = self._load(k // BATCH), k % BATCH
        ids, mask = (batch.column(i).slice(row, 1).flatten() for i in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from `start`: a view where they lie in one batch."""
        size, parts = BATCH * self.length, []
        while n > 0:
            k, at = divmod(start, size)
            take = min(n, size - at)
            parts.append(self._load(k).column(0).flatten().slice(at, take).to_numpy(zero_copy_only=True))
            start, n = start + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def close(self) -> None:
        self.batch = None
        self.source.close()


def write_token_files(documents: DataFrame, vocabulary: str, end_id: int, lower: bool, path: str | None = None,
                      length: int = SEQUENCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes whole texts, writes them in ascending order of the key, and returns the manifest as read back.

    Each task writes one file; its name holds the attempt, and only the manifest of attempts that Spark committed counts,
    so lost executors and repeated tasks do no harm. Manifest: file, part (order of files), nth, doc_id, start (ids
    before it in the file), n_tokens (with the end id).

    A null text is an empty one (just the end id). Null keys come first, repeated rows follow each other, an empty table
    gives an empty manifest. Rows of one key are spread by their texts' hashes. Other columns are not read.
    """
    spark = documents.sparkSession
    base = path or run_dir(spark, "token-files")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task, writer, start, nth = encoder(vocabulary, lower), TaskContext.get(), None, 0, 0
        end = np.asarray([end_id], codec.dtype).tobytes()
        name = f"{base}/ids/part-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        for batch in chunks(batches, "text"):
            writer = writer or Writer(name, codec.width, length)
            rows = []
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = codec.ids(body) + end
                writer.add(ids)
                n = len(ids) // codec.width
                rows.append((name, task.partitionId(), nth, doc_id, start, n))
                start, nth = start + n, nth + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (
                pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                names=["file", "part", "nth", "doc_id", "start", "n_tokens"])
        if writer:
            writer.close()

    rows = documents.select(F.col(key).alias("doc_id"), utf8(text).alias("text"))
    spread = rows.withColumn("_h", F.xxhash64("text"))
    ordered = spread.repartitionByRange(ranges, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{base}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all files), n_tokens and ids_crc32 of every document, computed from the files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            sums = []
            for file, start, n in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "n_tokens"))):
                if file != name:
                    if reader:
                        reader.close()
                    name, reader = file, Reader(file)
                sums.append(zlib.crc32(reader.ids(start, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("part", "doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())],
                names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])
        if reader:
            reader.close()

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per file
    files = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    found = manifest.select("file", "part", "doc_id", "start", "n_tokens").mapInArrow(
        read, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(files), F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("local_start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
