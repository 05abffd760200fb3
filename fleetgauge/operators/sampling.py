"""How far back a server's event history reaches, and how often to read it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import adjusted_interval, span_nanos


def buffer_lifespan(bounds: DataFrame) -> DataFrame:
    """Adds `lifespan_ns` to `buffer_bounds` rows."""
    return bounds.withColumn("lifespan_ns", span_nanos(F.col("oldest_timer"), F.col("newest_timer")))


def sampling_advice(bounds: DataFrame, intervals: DataFrame) -> DataFrame:
    """Next interval of every instance; `intervals` has (instance_id, interval_ns)."""
    spans = buffer_lifespan(bounds).select("instance_id", "lifespan_ns")
    return intervals.join(spans, "instance_id").select(
        "instance_id", "interval_ns", "lifespan_ns",
        adjusted_interval(F.col("interval_ns"), F.col("lifespan_ns")).alias("next_interval_ns"),
    )
