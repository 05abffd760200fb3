"""Picking snapshots: every lake row is a point-in-time copy of cumulative counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bounds
from ..sources.lake import read_lake


def latest_snapshot(rows: DataFrame) -> DataFrame:
    """Rows of the newest timestamp of the whole frame."""
    newest = rows.agg(F.max("timestamp").alias("timestamp"))  # one row
    return rows.join(F.broadcast(newest), "timestamp", "left_semi").select(*rows.columns)


def latest_per_instance(rows: DataFrame, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """Rows of the newest timestamp of each instance.

    Two narrow passes and a semi join on (keys, timestamp). A window over the
    instance would send a large instance to one task whole.
    """
    newest = rows.groupBy(*keys).agg(F.max("timestamp").alias("timestamp"))
    return rows.join(newest, [*keys, "timestamp"], "left_semi").select(*rows.columns)


def latest_in_lake(spark: SparkSession, base: str, dataset: str) -> DataFrame:
    """`latest_per_instance` of a dataset of the lake, from the folders that hold these rows alone.

    The bounds of the folders say which ones: those of an instance whose greatest timestamp is the instance's greatest. One
    row per instance comes to the driver, as the partition filter of the read. Folders of days to which a write is under
    way are read as well; a lake without bounds is read whole, and so are instances that have none.
    """
    rows, noted = read_lake(spark, base, dataset), bounds.known(spark, base, dataset)
    if noted is None:
        return latest_per_instance(rows)
    open_days = [row["date"] for row in bounds.unfinished(noted).select("date").distinct().collect()]
    folders = noted.filter("done AND date IS NOT NULL").groupBy("instance_id", "date").agg(F.max("last").alias("last"))
    newest = folders.groupBy("instance_id").agg(F.max("last").alias("last"))
    by_day: dict = {}
    for row in folders.join(newest, ["instance_id", "last"], "left_semi").select("instance_id", "date").collect():
        by_day.setdefault(row["date"], []).append(row["instance_id"])
    if None not in open_days:
        instances = sorted({name for names in by_day.values() for name in names})
        wanted = ~F.col("instance_id").isin(instances) | F.col("date").isin(open_days)
        for day, names in by_day.items():
            wanted = wanted | ((F.col("date") == F.lit(day)) & F.col("instance_id").isin(names))
        rows = rows.filter(wanted)
    return latest_per_instance(rows)


def snapshot_at(rows: DataFrame, timestamp: str) -> DataFrame:
    return rows.filter(F.col("timestamp") == timestamp)


def snapshot_times(rows: DataFrame) -> DataFrame:
    """The poll cycles that are present, oldest first."""
    return rows.select("timestamp").distinct().orderBy("timestamp")
