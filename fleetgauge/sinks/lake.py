"""Writing the Hive-partitioned Parquet lake.

    {base}/{dataset}/instance_id={id}/date={YYYY-MM-DD}/part-*.parquet
    {base}/_bounds/{dataset}/part-*.parquet

Every write notes the times of what it wrote, see `sources.bounds`.

The same code writes to an object store: give an `s3a://` base and set
`object_store_settings` on the session (the connector jar is not part of Spark).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DATASETS
from ..session import run_dir
from ..sources import bounds
from ..sources.lake import read_lake

ROWS_PER_FILE = 1_000_000
PARTITIONS = ("instance_id", "date")
#: Files count as new if they changed no longer than this before a write began: clocks differ, and more rows do no harm.
CLOCKS = dt.timedelta(minutes=10)


def object_store_settings(region: str = "", endpoint: str = "") -> dict[str, str]:
    """Hadoop settings for S3-compatible storage; credentials come from the standard chain."""
    settings = {"spark.hadoop.fs.s3a.path.style.access": "true"} if endpoint else {}
    if region:
        settings["spark.hadoop.fs.s3a.endpoint.region"] = region
    if endpoint:
        settings["spark.hadoop.fs.s3a.endpoint"] = endpoint
    return settings


def sized(rows: DataFrame) -> DataFrame:
    """Rows brought together by lake folder, in pieces of the session's advisory size.

    REBALANCE splits the folder of a large instance over several tasks, where
    `repartition` on the same columns would give it to one.
    """
    return rows.hint("rebalance", *PARTITIONS)


def write_lake(
    rows: DataFrame, base: str, dataset: str, *, date: dt.date | Column | None = None,
    rows_per_file: int = ROWS_PER_FILE, gather: bool = True,
) -> None:
    """Appends typed rows of one dataset; without rows no file appears.

    `date` is the day of writing, today in UTC unless given. `gather=False` skips
    the shuffle that makes fewer, larger files.
    """
    day = date if isinstance(date, Column) else F.lit(date or dt.datetime.now(dt.timezone.utc).date())
    typed = rows.select(*(
        F.col(field.name).cast(field.dataType).alias(field.name) for field in DATASETS[dataset].fields
    ), day.alias("date"))
    spark, days = rows.sparkSession, None if isinstance(date, Column) else [date or dt.datetime.now(dt.timezone.utc).date()]
    write, began = bounds.announce(spark, base, dataset, days), dt.datetime.now(dt.timezone.utc)
    writer = (sized(typed) if gather else typed).write.mode("append").partitionBy(*PARTITIONS)
    writer.option("maxRecordsPerFile", rows_per_file).parquet(f"{base.rstrip('/')}/{dataset}")
    fresh = None
    if bounds.exists(spark, f"{base.rstrip('/')}/{dataset}"):
        # One narrow column of the new files; what was written is not computed again.
        fresh = read_lake(spark, base, dataset, metadata=True).filter(F.col("_metadata.file_modification_time") >= F.lit(began - CLOCKS))
        fresh = fresh if days is None else fresh.filter(F.col("date") == F.lit(days[0]))
    bounds.note(spark, base, dataset, write, fresh)


def compact_lake(
    spark: SparkSession, base: str, dataset: str, *, instance: str | None = None, since: dt.date | str | None = None,
    until: dt.date | str | None = None, rows_per_file: int = ROWS_PER_FILE, into: str | None = None,
) -> None:
    """Rewrites whole folders of closed days with fewer files: of one instance or all, of the folder days since to until.

    The folder of today (UTC) is left alone, since collectors append to it; naming it in `until` is an error. Rows are
    shuffled once into staged files, whose number of rows must be that of the lake. Folders are replaced only if they
    still hold the files that were read: after a late append nothing is changed and an error says so. Replacing them takes
    a moment; a write to these days that was announced or finished in it may have lost files, so it is named in an error
    and has to be repeated. The bounds of the folders stay the same and are put together.

    A lake that a stream writes has folders per batch; compact it `into` another base.
    """
    today = dt.datetime.now(dt.timezone.utc).date()
    first, last = (dt.date.fromisoformat(day) if isinstance(day, str) else day for day in (since, until))
    if last is not None and last >= today:
        raise ValueError(f"the folder of {last} is still written to")

    def chosen() -> DataFrame:
        rows = read_lake(spark, base, dataset, instance=instance).filter(F.col("date") <= F.lit(last or today - dt.timedelta(days=1)))
        return rows if first is None else rows.filter(F.col("date") >= F.lit(first))

    def writes() -> set[tuple[str, bool]]:
        """Announced and finished writes to these days since the bounds were last put together."""
        noted = bounds.known(spark, base, dataset)
        if noted is None:
            return set()
        near = noted.filter(F.col("date").isNull() | (F.col("date") <= F.lit(last or today)))
        near = near if first is None else near.filter(F.col("date").isNull() | (F.col("date") >= F.lit(first)))
        return {(row["write"], row["done"]) for row in near.select("write", "done").distinct().collect()}

    rows = chosen()
    files = sorted(rows.inputFiles())
    if not files:
        return
    staged = run_dir(spark, "compact")
    sized(rows).write.partitionBy(*PARTITIONS).option("maxRecordsPerFile", rows_per_file).parquet(staged)
    compacted, before = spark.read.schema(rows.schema).parquet(staged), writes()
    if compacted.count() != rows.count() or sorted(chosen().inputFiles()) != files:
        raise RuntimeError("the lake was written to while it was compacted; nothing was changed")
    target = into or base
    write = None if into is None else bounds.announce(spark, target, dataset, None)
    compacted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "maxRecordsPerFile", rows_per_file).partitionBy(*PARTITIONS).parquet(f"{target.rstrip('/')}/{dataset}")
    if write:
        bounds.note(spark, target, dataset, write, compacted)
    elif risked := sorted(writes() - before):
        raise RuntimeError(f"written to while folders were replaced, so repeat these writes: {', '.join(name for name, _ in risked)}")
    bounds.fold(spark, target, dataset)
    path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
