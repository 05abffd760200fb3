"""New events only, none of them twice, however late a history is read again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from .cells import CELL, CellTable, cell_of, names, start


@dataclass(frozen=True)
class EventTail:
    """Below `path`, the events that were new when they came, and the highest event id of every history as a table.

    A server numbers the events of a thread upwards, so an event is new if its id is above the highest one of its
    (instance, thread) of the batches before; there is no time after which it is forgotten. Of equal events in one batch
    one stays (the greatest row). Events without an id are left out; a null instance or thread is a history of its own.
    New events of batch n go to `events/batch=n`.
    """

    path: str
    history: Sequence[str] = ("instance_id", "thread_id")
    order: str = "event_id"
    parts: int = 64

    @property
    def _marks(self) -> CellTable:
        return CellTable(f"{self.path.rstrip('/')}/marks")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, keys = batch.sparkSession, [*self.history]
        given = batch.filter(F.col(self.order).isNotNull()).withColumn(CELL, cell_of(keys, self.parts)).persist()
        schema = T.StructType([*(batch.schema[k] for k in keys), T.StructField("_mark", batch.schema[self.order].dataType)])
        touched = names(given)
        known = self._marks.read(spark, schema, touched, before=number).persist()
        marks = known.select(*(F.col(k).alias(f"_{k}") for k in keys), "_mark")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        # Many events of a history, one mark: combined before the join, so a hot history is a row per event at most.
        others = [c for c in batch.columns if c not in (*keys, self.order)]
        events = given.groupBy(*keys, self.order).agg(F.max(F.struct(F.lit(0).alias("_"), *others)).alias("_row"))
        fresh = events.join(marks, _all(same), "left").filter(F.col("_mark").isNull() | (F.col(self.order) > F.col("_mark")))
        fresh.select(*(c if c in (*keys, self.order) else F.col(f"_row.{c}") for c in batch.columns)).write.mode("overwrite").parquet(
            f"{self.path.rstrip('/')}/events/batch={number}")
        highest = given.select(*keys, CELL, F.col(self.order).alias("_mark")).unionByName(known).groupBy(*keys, CELL).agg(F.max("_mark").alias("_mark"))
        self._marks.replace(number, highest, touched)
        given.unpersist()
        known.unpersist()

    def events(self, spark: SparkSession, kinds: T.StructType) -> DataFrame:
        """The new events of all batches; `kinds` is the schema of the stream."""
        return spark.read.schema(kinds).parquet(f"{self.path.rstrip('/')}/events").select(*kinds.names)


def _all(conditions: list):
    whole = conditions[0]
    for condition in conditions[1:]:
        whole = whole & condition
    return whole


def stream_tail(events: DataFrame, tail: EventTail, checkpoint: str, every: str = "1 minute", once: bool = False) -> StreamingQuery:
    """Starts the query on a stream of events; `tail.events` reads its result."""
    return start(events, tail, checkpoint, every, once)
