"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Every function of the library also works without these: schemas are passed
# explicitly, JSON options are set per call and timestamps are kept zone-free.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # 128 MB is the flush size of the collector; REBALANCE writes aim at it.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "fleetgauge", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; `extra` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir`, or without it a folder in the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/fleetgauge-work").rstrip("/")


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one, for one run of `purpose`."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
