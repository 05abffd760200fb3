"""Statement and wait history: what is new since the last read, and its time span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import or_empty
from ..operators.skew import spread_join

STATEMENT_TEXTS = ("digest", "sql_text", "current_schema")
STATEMENT_COUNTERS = (
    "timer_wait", "rows_examined", "rows_sent", "rows_affected",
    "created_tmp_tables", "created_tmp_disk_tables", "no_index_used",
)
WAIT_TEXTS = ("operation", "source")
WAIT_COUNTERS = ("nesting_event_id", "timer_wait", "timer_start")


def _filled(rows: DataFrame, texts: tuple[str, ...], counters: tuple[str, ...]) -> DataFrame:
    def fill(name: str) -> Column:
        if name in texts:
            return or_empty(F.col(name)).alias(name)
        if name in counters:
            return F.coalesce(name, F.lit(0).cast(rows.schema[name].dataType)).alias(name)
        return F.col(name)
    return rows.select(*(fill(name) for name in rows.columns))


def _newer(rows: DataFrame, marks: DataFrame | None) -> DataFrame:
    """Rows above the mark of their instance; an instance without a mark starts at 0.

    `marks` has one row per instance. The rows of a hot instance, and those
    without one, are spread over many tasks.
    """
    if marks is None:
        return rows.filter(F.col("event_id") > 0)
    known = marks.select("instance_id", F.col("high_water_mark").alias("_mark"))
    above = F.col("event_id") > F.coalesce("_mark", F.lit(0))
    joined = spread_join(rows, known, ["instance_id"], F.col("event_id"), unmatched=F.col("instance_id").isNull())
    return joined.filter(above).select(*rows.columns)


def statement_tail(raw: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """New statement events with NULL texts as '' and NULL counters as 0."""
    return _filled(_newer(raw, marks), STATEMENT_TEXTS, STATEMENT_COUNTERS)


def wait_tail(raw: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """New wait events; no parent is written as nesting_event_id 0."""
    return _filled(_newer(raw, marks), WAIT_TEXTS, WAIT_COUNTERS)


def high_water_marks(rows: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(instance_id, high_water_mark) after `rows` were read; instances with nothing new keep theirs."""
    seen = rows.select("instance_id", F.col("event_id").alias("high_water_mark"))
    if marks is not None:
        seen = seen.unionByName(marks.select("instance_id", "high_water_mark"))
    return seen.groupBy("instance_id").agg(F.max("high_water_mark").alias("high_water_mark"))


def buffer_bounds(raw: DataFrame) -> DataFrame:
    """Oldest and newest statement timer and the row count of every instance's history."""
    zero = F.lit(0).cast(raw.schema["timer_start"].dataType)
    return raw.groupBy("instance_id").agg(
        F.coalesce(F.min("timer_start"), zero).alias("oldest_timer"),
        F.coalesce(F.max("timer_start"), zero).alias("newest_timer"),
        F.count("*").alias("row_count"),
    )
