"""Counter growth between consecutive snapshots, as they arrive, in any order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.deltas import counter_increase
from .cells import CELL, SLICE, CellTable, cell_of, dealt, names, start


@dataclass(frozen=True)
class CounterSteps:
    """A table of snapshots with their steps, below `path`, that batches of snapshots bring up to date.

    Snapshots lie in cells by a hash of their key and by period, the first `period` characters of their timestamp (13: an
    hour). Beside them a small table has each key's first and last snapshot of every period. A batch rewrites the cells of
    its snapshots and of those that follow them, which may now step from another one; where snapshots arrive in order,
    these are cells of the current period. A snapshot that comes again replaces the one of its key and time. Snapshots
    without a timestamp have no place and are left out; null keys are keys of their own.
    """

    keys: tuple[str, ...]
    counters: tuple[str, ...]
    path: str
    parts: int = 64
    period: int = 13

    @property
    def _snapshots(self) -> CellTable:
        return CellTable(f"{self.path.rstrip('/')}/snapshots")

    @property
    def _edges(self) -> CellTable:
        return CellTable(f"{self.path.rstrip('/')}/edges")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, keys = batch.sparkSession, list(self.keys)
        fields = [batch.schema[name] for name in (*keys, "timestamp", *self.counters)]
        snapshot = T.StructType(fields)
        value = T.StructType(fields[len(keys):])
        edge = T.StructType([*fields[:len(keys)], T.StructField("_period", T.StringType()),
                             T.StructField("_first", value), T.StructField("_last", value)])
        place = F.translate(F.substring("timestamp", 1, self.period), " :", "T-")

        rows = batch.select(*snapshot.names).filter("timestamp IS NOT NULL").groupBy(*keys, "timestamp").agg(
            F.max(F.struct(*self.counters)).alias("_v")).select(*keys, "timestamp", "_v.*").persist()
        fresh = rows.withColumns({"_period": place, CELL: cell_of(keys, self.parts)})
        known = self._edges.read(spark, edge, parts := names(fresh), before=number)
        # Of two snapshots of the same time the one that came later counts: it is later as a last, earlier as a first.
        ends = known.select(CELL, *keys, "_period", F.inline(F.array_distinct(F.array("_first", "_last"))))
        both = dealt(fresh.withColumn("_new", F.lit(True)).unionByName(ends.withColumn("_new", F.lit(False))), keys)
        plain = lambda column: F.struct(f"{column}.timestamp", *(f"{column}.{c}" for c in self.counters)).alias(column)
        edges = both.groupBy(CELL, SLICE, *keys, "_period").agg(
            F.min(F.struct("timestamp", (~F.col("_new")).alias("_age"), *self.counters)).alias("_first"),
            F.max(F.struct("timestamp", F.col("_new").alias("_age"), *self.counters)).alias("_last"), F.max("_new").alias("_hit"))
        order = W.partitionBy(CELL, SLICE, *keys).orderBy("_period")  # a row per period of a key
        edges = edges.select(CELL, SLICE, *keys, "_period", plain("_first"), plain("_last"), "_hit").withColumns({
            "_before": F.lag("_last").over(order), "_redo": F.col("_hit") | F.coalesce(F.lag("_hit").over(order), F.lit(False))}).drop(SLICE).persist()
        self._edges.replace(number, edges.select(*edge.names, CELL), parts, in_place=True)

        periods = edges.withColumn(CELL, F.concat_ws("~", CELL, "_period"))
        cells = names(periods.filter("_redo"))
        here = rows.withColumn(CELL, cell_of(keys, self.parts, place))
        there = self._snapshots.read(spark, snapshot, cells, before=number)
        chosen = periods.join(F.broadcast(periods.filter("_redo").select(CELL).distinct()), CELL, "left_semi")
        before = chosen.filter("_before IS NOT NULL").select(CELL, *keys, "_before.*")
        aged = lambda table, age, own: table.withColumns({"_age": F.lit(age), "_own": F.lit(own)})
        merged = dealt(aged(here, 1, True).unionByName(aged(there, 0, True)).unionByName(aged(before, 0, False)), keys).groupBy(
            CELL, SLICE, *keys, "timestamp", "_own").agg(F.max(F.struct("_age", *self.counters)).alias("_v")).select(
            CELL, SLICE, *keys, "timestamp", "_own", *(f"_v.{c}" for c in self.counters))
        self._snapshots.replace(number, self._stepped(merged, SLICE).drop(SLICE), cells, in_place=True)
        rows.unpersist()
        edges.unpersist()

    def _stepped(self, rows: DataFrame, *within: str) -> DataFrame:
        """Steps within the cells; rows that are not the cell's own are where its first steps begin."""
        return counter_increase(rows, [CELL, *within, *self.keys], self.counters, carry=["_own", *self.counters]).filter("_own").drop("_own")

    def steps(self, spark: SparkSession, kinds: T.StructType) -> DataFrame:
        """(*keys, timestamp, {counter}_increase) of all snapshots that follow another one, as the batches left them.

        `kinds` is the schema of the stream.
        """
        own = [kinds[name] for name in (*self.keys, "timestamp", *self.counters)]
        none = spark.createDataFrame([], T.StructType([T.StructField(CELL, T.StringType()), *own, T.StructField("_own", T.BooleanType())]))
        schema = T.StructType([f for f in self._stepped(none).schema if f.name != CELL])
        steps = [f"{name}_increase" for name in self.counters]
        return self._snapshots.read(spark, schema).filter(F.col(steps[0]).isNotNull()).select(*self.keys, "timestamp", *steps)


def stream_counter_steps(
    rows: DataFrame, steps: CounterSteps, checkpoint: str, every: str = "1 minute", once: bool = False
) -> StreamingQuery:
    """Starts the query on a stream of counter snapshots; `steps.steps` reads its result."""
    return start(rows, steps, checkpoint, every, once)
