"""Least and greatest counters per day, kept as a table that is added to.

Snapshots are cumulative, so growth over a range needs the first and the last value of a key only. Per-day bounds merge by
least and greatest: a month of growth reads some thirty rows a key in place of every poll, and rows that come late or twice
are simply added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import picos_to_seconds

DIGEST = ("instance_id", "schema_name", "digest")
GROWING = ("exec_count", "sum_timer_wait")


def daily_bounds(rows: DataFrame, keys: Sequence[str] = DIGEST, counters: Sequence[str] = GROWING) -> DataFrame:
    """(*keys, month, date, {counter}_least, {counter}_greatest); rows without a timestamp are on no day and left out."""
    day = F.substring("timestamp", 1, 10)
    return rows.filter("timestamp IS NOT NULL").groupBy(*keys, F.substring("timestamp", 1, 7).alias("month"), day.alias("date")).agg(*(
        edge for c in counters for edge in (F.min(c).alias(f"{c}_least"), F.max(c).alias(f"{c}_greatest"))))


def add_daily_bounds(rows: DataFrame, path: str, keys: Sequence[str] = DIGEST, counters: Sequence[str] = GROWING) -> None:
    """Appends the bounds of new rows, in one folder per month."""
    daily_bounds(rows, keys, counters).hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def read_daily_bounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))


def counter_delta_daily(bounds: DataFrame, since: str, first_day: DataFrame | None = None, keys: Sequence[str] = DIGEST) -> DataFrame:
    """`counter_delta_fleet` from per-day bounds. A range that begins within a day needs the rows of that day, `first_day`."""
    day, whole = since[:10], since[10:] in ("", " 00:00:00")
    later = bounds.filter((F.col("month") >= day[:7]) & (F.col("date") >= day if whole else F.col("date") > day))
    if not whole:
        if first_day is None:
            raise ValueError(f"{since} is within a day, so the rows of {day} are needed")
        part = first_day.filter((F.col("timestamp") >= since) & (F.substring("timestamp", 1, 10) == day))
        later = later.unionByName(daily_bounds(part, keys))
    grown = lambda c: F.max(f"{c}_greatest") - F.min(f"{c}_least")
    return later.groupBy(*keys).agg(
        grown("exec_count").alias("new_execs"), picos_to_seconds(grown("sum_timer_wait")).alias("added_wait_sec")).filter("new_execs > 0")


def fold_daily_bounds(spark: SparkSession, path: str, into: str) -> None:
    """Writes the bounds with one row per key and day to another folder, which then takes the place of the first."""
    rows = read_daily_bounds(spark, path)
    bounds = [c for c in rows.columns if c.endswith(("_least", "_greatest"))]
    keys = [c for c in rows.columns if c not in (*bounds, "month", "date")]
    edge = lambda c: (F.min if c.endswith("_least") else F.max)(c).alias(c)
    rows.groupBy(*keys, "month", "date").agg(*map(edge, bounds)).hint("rebalance", "month").write.partitionBy("month").parquet(into)
