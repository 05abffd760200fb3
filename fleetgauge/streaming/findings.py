"""Configuration findings on incoming variable snapshots, right also where rows come late."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.advisor import check_variables
from ..rules import RULES, Rule
from .cells import CELL, SLICE, CellTable, cell_of, dealt, names, start

SNAPSHOT = ("instance_id", "event_time")


@dataclass(frozen=True)
class StreamedFindings:
    """Variables that have landed and their findings, below `path`, that batches of variable rows bring up to date.

    `event_time` says when a snapshot was taken. Its rows may arrive in several batches and at any later time: a batch
    checks the snapshots in the cells it touches again, with all their rows, and the result replaces what was said about
    them. Cells are a hash of the instance and the hour of the snapshot. A variable that comes again keeps the greater of its
    values, as in the batch operator. A snapshot without a time is one of its own.
    """

    path: str
    rules: Sequence[Rule] = RULES
    category: str | None = None
    parts: int = 64

    @property
    def _variables(self) -> CellTable:
        return CellTable(f"{self.path.rstrip('/')}/variables")

    @property
    def _findings(self) -> CellTable:
        return CellTable(f"{self.path.rstrip('/')}/findings")

    def __call__(self, batch: DataFrame, number: int) -> None:
        columns = [*SNAPSHOT, "variable_name", "variable_value"]
        schema = T.StructType([batch.schema[name] for name in columns])
        hour = F.coalesce(F.date_format("event_time", "yyyy-MM-dd-HH"), F.lit("none"))
        rows = batch.select(*columns).withColumn(CELL, cell_of(["instance_id"], self.parts, hour)).persist()
        touched = names(rows)
        known = self._variables.read(batch.sparkSession, schema, touched, before=number)
        merged = dealt(rows.unionByName(known), SNAPSHOT).groupBy(CELL, SLICE, *SNAPSHOT, "variable_name").agg(
            F.max("variable_value").alias("variable_value")).drop(SLICE)
        self._variables.replace(number, merged, touched, in_place=True)
        whole = dealt(self._variables.read(batch.sparkSession, schema, touched), SNAPSHOT)
        found = check_variables(whole, self.rules, self.category, keys=(CELL, SLICE, *SNAPSHOT)).drop(SLICE)
        self._findings.replace(number, found, touched, in_place=True)
        rows.unpersist()

    def findings(self, spark: SparkSession, kinds: T.StructType) -> DataFrame:
        """Findings per (instance_id, event_time) as the batches left them; `kinds` is the schema of the stream."""
        none = spark.createDataFrame([], T.StructType([kinds[n] for n in (*SNAPSHOT, "variable_name", "variable_value")]))
        schema = check_variables(none, self.rules, self.category, keys=SNAPSHOT).schema
        return self._findings.read(spark, schema).drop(CELL)


def stream_findings(
    variables: DataFrame, findings: StreamedFindings, checkpoint: str, every: str = "1 minute", once: bool = False
) -> StreamingQuery:
    """Starts the query on a stream of variable rows; `findings.findings` reads its result."""
    return start(variables, findings, checkpoint, every, once)
