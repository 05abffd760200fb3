"""A stream of typed rows into the lake."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..schemas import DATASETS
from ..sinks.lake import PARTITIONS, ROWS_PER_FILE, sized
from ..sources import bounds
from .cells import start


@dataclass(frozen=True)
class LakeStream:
    """Where and how often a stream is written; the defaults are the collector's.

    Every interval is a batch write of its own, below `{base}/{dataset}/batch=N`, cut like any other folder of the lake. The
    rows of a large instance are dealt over as many tasks as their size asks for. An interval that is run again replaces
    what its first try wrote, so no row is there twice. An interval without rows writes nothing.
    """

    base: str
    dataset: str
    checkpoint: str
    every: str = "5 minutes"
    once: bool = False       # write what is there and stop

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, schema, today = batch.sparkSession, DATASETS[self.dataset], dt.datetime.now(dt.timezone.utc).date()
        typed = batch.select(
            *(F.col(field.name).cast(field.dataType).alias(field.name) for field in schema.fields), F.lit(today).alias("date"))
        path = f"{self.base.rstrip('/')}/{self.dataset}/batch={number}"
        write = bounds.announce(spark, self.base, self.dataset, [today])
        sized(typed).write.mode("overwrite").partitionBy(*PARTITIONS).option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
        bounds.note(spark, self.base, self.dataset, write, spark.read.schema(typed.schema).parquet(path))


def stream_to_lake(rows: DataFrame, sink: LakeStream) -> StreamingQuery:
    """Starts the writer."""
    return start(rows, sink, sink.checkpoint, sink.every, sink.once)
