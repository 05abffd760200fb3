"""Tables that streams change in place: rows cut into cells, of which a batch replaces only those it touches.

    {path}/rows/batch=N/cell=C/part-*.parquet     the rows of cell C as batch N left them
    {path}/cells/batch=N                          which batch wrote each cell last, as of batch N

A batch reads what the batch before it left and writes files of its own, so one that is run again after a failure replaces
its first try and nothing is counted twice. Files that neither this state nor the one before it needs are deleted.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

CELL = "cell"
SLICE = "_slice"
SLICES = 16
LISTED = T.StructType([T.StructField(CELL, T.StringType()), T.StructField("written", T.LongType())])


def cell_of(keys: Sequence[str], parts: int, *periods: Column) -> Column:
    """A cell's name: the part of a hash of the keys, and periods of time or ranges of ids that let cells grow cold."""
    return F.concat_ws("~", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string"), *periods)


def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows brought together by cell and slice of the keys, both of which the keys decide (with the cell's periods).

    Groups and windows within (CELL, SLICE, *keys) and the files of a cell then need no shuffle of their own, and a cell,
    however large, is worked on by SLICES tasks.
    """
    return rows.withColumn(SLICE, F.pmod(F.hash(*keys), F.lit(SLICES))).repartition(CELL, SLICE)


def names(rows: DataFrame) -> list[str]:
    """The cells of rows; there are no more than parts times periods of them."""
    return [row[CELL] for row in rows.select(CELL).distinct().collect()]


@dataclass(frozen=True)
class CellTable:
    path: str

    def _folder(self, spark: SparkSession, *below: str):
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path.rstrip("/"), *below)))
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path

    def _listed(self, spark: SparkSession, *below: str) -> list[str]:
        files, path = self._folder(spark, *below)
        return [s.getPath().getName().split("=", 1)[1] for s in files.listStatus(path) if "=" in s.getPath().getName()] if files.exists(path) else []

    def _state(self, spark: SparkSession, batch: int | None) -> dict[str, int]:
        if batch is None:
            return {}
        rows = spark.read.schema(LISTED).parquet(f"{self.path.rstrip('/')}/cells/batch={batch}")
        return {row[CELL]: row["written"] for row in rows.collect()}

    def _batches(self, spark: SparkSession, before: int | None = None) -> list[int]:
        """Finished batches, newest first; one that broke off while it listed its cells has no success mark."""
        done = []
        for batch in sorted(map(int, self._listed(spark, "cells")), reverse=True):
            files, mark = self._folder(spark, "cells", f"batch={batch}", "_SUCCESS")
            if (before is None or batch < before) and files.exists(mark):
                done.append(batch)
        return done

    def files(self, spark: SparkSession, cells: Iterable[str] | None = None, before: int | None = None) -> list[str]:
        """Folders of the given cells, or of all, as the newest batch (before `before`) left them."""
        state = self._state(spark, next(iter(self._batches(spark, before)), None))
        chosen = state if cells is None else [c for c in cells if c in state]
        return [f"{self.path.rstrip('/')}/rows/batch={state[c]}/{CELL}={c}" for c in sorted(chosen)]

    def read(self, spark: SparkSession, schema: T.StructType, cells: Iterable[str] | None = None, before: int | None = None) -> DataFrame:
        """Rows of the given cells, or of all, with their cell; no other files are opened."""
        found = self.files(spark, cells, before)
        whole = T.StructType([*schema.fields, T.StructField(CELL, T.StringType())])
        if not found:
            return spark.createDataFrame([], whole)
        return spark.read.schema(whole).option("basePath", f"{self.path.rstrip('/')}/rows").parquet(*found).select(*whole.names)

    def replace(self, batch: int, rows: DataFrame, touched: Iterable[str], in_place: bool = False) -> None:
        """Makes `rows` (with their cell) what the touched cells hold after this batch; a cell without rows is gone.

        Rows that are `in_place`, since they were `dealt`, are written where they are.
        """
        spark, root = rows.sparkSession, self.path.rstrip("/")
        touched = list(touched)
        (rows if in_place else rows.hint("rebalance", CELL)).write.mode("overwrite").partitionBy(CELL).parquet(f"{root}/rows/batch={batch}")
        earlier = self._batches(spark, batch)
        state = self._state(spark, next(iter(earlier), None))
        held = {c: b for c, b in state.items() if c not in set(touched)} | dict.fromkeys(self._listed(spark, "rows", f"batch={batch}"), batch)
        spark.createDataFrame(list(held.items()), LISTED).coalesce(1).write.mode("overwrite").parquet(f"{root}/cells/batch={batch}")
        for old in earlier[1:]:
            for cell, written in self._state(spark, old).items():
                if state.get(cell) != written and held.get(cell) != written:
                    self._delete(spark, "rows", f"batch={written}", f"{CELL}={cell}")
            self._delete(spark, "cells", f"batch={old}")

    def _delete(self, spark: SparkSession, *below: str) -> None:
        files, path = self._folder(spark, *below)
        files.delete(path, True)


def start(rows: DataFrame, apply, checkpoint: str, every: str, once: bool) -> StreamingQuery:
    """Starts a query that hands every batch to `apply`; `once` takes what is there and stops."""
    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
