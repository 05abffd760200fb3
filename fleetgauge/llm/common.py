"""Helpers that the operators of this subpackage share: staged tables, folds, batches of texts."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Hashable, Iterator
from typing import Any
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_dir

#: Bytes of text that a Python worker handles at once.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch on its way to a Python worker, beyond which Spark begins another one.
BATCH_BYTES = 4 << 20

#: What separates words, as a regular expression of Spark; words are what lies between.
SPACE = r"[\x20\x09-\x0D]+"

_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What `make` gives, kept in this Python worker between tasks until another key is asked for.

    Workers outlive stages; so the caches of one operator do not lie beside those of the next one.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def small_batches(spark: SparkSession) -> None:
    """Has the session cut batches for Python at BATCH_BYTES, so long texts do not fill a worker by thousands of rows.

    A limit that the user chose stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's own
        spark.conf.set(name, str(BATCH_BYTES))


def known_to_workers(spark: SparkSession) -> None:
    """Gives Python workers of a local session this library's place, wherever they are started."""
    root, places = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = places.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        places["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder."""
    known_to_workers(spark)
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends here, lost executors cost nothing."""
    path = run_dir(frame.sparkSession, purpose)
    known_to_workers(frame.sparkSession)
    small_batches(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def forget(frame: DataFrame) -> None:
    """Deletes the files of a staged frame that nothing reads any more."""
    session = frame.sparkSession
    jvm, conf = session._jvm, session._jsparkSession.sessionState().newHadoopConf()
    for parent in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def let_go_of_shuffles(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that nothing refers to any more, which it does as the driver collects garbage.

    Behind a staged frame no lineage is left, so files of the shuffles before it would lie on the executors' disks until
    the driver's memory happens to fill.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()


def let_go_of_heaps(spark: SparkSession) -> None:
    """Has executors collect their garbage, upon which a JVM gives back to the system the heap that it does not need.

    A JVM lets its heap grow up to its limit rather than look through all of it. What one stage left there as garbage
    would count beside the Python workers of the next one. A task for each core; none of them runs Python.
    """
    slots = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, slots, 1, slots).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def _empty() -> None:
    """Clears what is kept; its memory goes back to the system, not only to the allocators of this process."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others may not
    if trim:
        trim(0)


def let_go_of_caches(spark: SparkSession) -> None:
    """Empties what the executors' Python workers keep (see `kept`), for stages after this one that run without them.

    A round of small tasks, several for each core; idle workers take tasks in turn.
    """
    def empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _empty()
        yield from batches

    known_to_workers(spark)
    slots = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, 4 * slots, 1, 4 * slots).mapInArrow(empty, "id long").write.format("noop").mode("overwrite").save()


def held_out(doc_id: Column) -> Column:
    """The fold that nothing may be learned from: a third of the ids, by their checksum (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def bit_table(hashes: DataFrame, bits: int) -> Column:
    """A filter for the 64-bit hashes in the only column of a frame, as a literal: a bit is set for the first `bits` bits of each.

    Its size is fixed, whatever the number of hashes; that it lets others pass costs time only.
    """
    name, = hashes.columns
    place = F.shiftrightunsigned(name, 64 - bits)
    rows = hashes.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(`{name}`, {64 - bits}) % 64 AS INT))")).alias("set")).toArrow()
    table = [0] * (1 << bits - 6)  # at most so many rows
    for word, found in zip(rows.column("word").to_pylist(), rows.column("set").to_pylist()):
        table[word] = found
    return F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<bigint>")


def in_table(table: Column, value: Column, bits: int) -> Column:
    place = F.shiftrightunsigned(value, 64 - bits)
    return F.getbit(F.get(table, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1


def utf8(text: str | Column) -> Column:
    """A text as bytes, null as none."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a part have about `limit` bytes, however long single texts are."""
    for batch in batches:
        start = size = 0
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            size += n or 0
            if size >= limit:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < len(lengths):
            yield batch.slice(start)


def words(text: bytes) -> list[bytes]:
    """Runs of anything but space and the control characters 9 to 13 (just what bytes.split cuts at)."""
    return text.split()
