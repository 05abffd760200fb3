"""Reading the Hive-partitioned Parquet lake."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DATASETS
from . import bounds


def _day(value: dt.date | str) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def read_lake(
    spark: SparkSession,
    base: str,
    dataset: str,
    *,
    instance: str | None = None,
    since: dt.date | str | None = None,
    until: dt.date | str | None = None,
    written_until: dt.date | str | None = None,
    metadata: bool = False,
) -> DataFrame:
    """One dataset of the lake, with the partition column `date`.

    The schema is explicit, so ids such as `101` or `007` stay texts and no file
    is opened to infer anything. `since` and `until` are days of the samples.
    The `date` folder is the day of *writing*. No row is written before it was
    taken, so folders before `since` are left out; a row may be written at any
    time after. Which later folders hold nothing up to `until` is known from the
    bounds that each write notes (see `bounds`); these are left out as well, and
    folders without bounds are read. Who knows that nothing was filled in later
    can say so with `written_until`, a day of folders. `metadata` adds Spark's
    `_metadata` of the file that a row is in.
    """
    schema = T.StructType([*DATASETS[dataset].fields, T.StructField("date", T.DateType(), True)])
    # A lake that a stream writes has its folders below those of the batches.
    rows = spark.read.schema(schema).parquet(f"{base.rstrip('/')}/{dataset}").select(*schema.names, *["_metadata"] * metadata)
    if instance is not None:
        rows = rows.filter(F.col("instance_id") == instance)
    if since is not None:
        first = _day(since)
        rows = rows.filter((F.col("date") >= F.lit(first)) & (F.col("timestamp") >= first.isoformat()))
    if until is not None:
        last = _day(until)
        rows = rows.filter(F.col("timestamp") < (last + dt.timedelta(days=1)).isoformat())
    if written_until is not None:
        rows = rows.filter(F.col("date") <= F.lit(_day(written_until)))
    if (since is not None or until is not None) and (noted := bounds.known(spark, base, dataset)) is not None:
        ends = None if until is None else (_day(until) + dt.timedelta(days=1)).isoformat()
        outside = bounds.days_outside(noted, None if since is None else _day(since).isoformat(), ends, instance)
        if outside:
            rows = rows.filter(~F.col("date").isin(*outside))
    return rows


def register_views(spark: SparkSession, base: str) -> list[str]:
    """Temp views over all datasets (`query-digests` becomes `query_digests`), for SQL users."""
    names = []
    for dataset in DATASETS:
        name = dataset.replace("-", "_")
        read_lake(spark, base, dataset).createOrReplaceTempView(name)
        names.append(name)
    return names
