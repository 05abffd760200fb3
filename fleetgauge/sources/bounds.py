"""What times the folders of a lake hold, so that reads by time leave folders out.

    {base}/_bounds/{dataset}/part-*.parquet     a row per write, instance and day: least and greatest timestamp

The folder of a row is the day it was written, which may be any day after it was taken, so folder names alone bound a read
from below only. Each write announces the days it goes to before a file of it can be seen, and notes what it wrote once it
is done; a write that was announced and not noted (it runs, or it died) keeps its days from being left out. Days that no
write noted are always read. Rows of a folder that is rewritten stay the same, and so do its bounds. What else writes to a
lake with bounds must announce and note as well.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUNDS = T.StructType([
    T.StructField("write", T.StringType()), T.StructField("done", T.BooleanType()), T.StructField("instance_id", T.StringType()),
    T.StructField("date", T.DateType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])


def bounds_path(base: str, dataset: str) -> str:
    return f"{base.rstrip('/')}/_bounds/{dataset}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def known(spark: SparkSession, base: str, dataset: str) -> DataFrame | None:
    path = bounds_path(base, dataset)
    return spark.read.schema(BOUNDS).parquet(path) if exists(spark, path) else None


def _append(rows: DataFrame, base: str, dataset: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(bounds_path(base, dataset))


def announce(spark: SparkSession, base: str, dataset: str, days: Sequence[dt.date] | None, write: str | None = None) -> str:
    """Says that a write to the folders of these days (None: of any day) begins; gives its name."""
    write = write or uuid.uuid4().hex
    _append(spark.createDataFrame([(write, False, None, day, None, None) for day in days or [None]], BOUNDS), base, dataset)
    return write


def note(spark: SparkSession, base: str, dataset: str, write: str, rows: DataFrame | None) -> None:
    """Says what a write wrote: the times of `rows`, which it and maybe others wrote, per instance and day."""
    end = spark.createDataFrame([(write, True, None, None, None, None)], BOUNDS)
    if rows is not None:
        end = end.unionByName(rows.groupBy("instance_id", "date").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).select(
            F.lit(write).alias("write"), F.lit(True).alias("done"), "instance_id", "date", "first", "last"))
    _append(end, base, dataset)


def unfinished(bounds: DataFrame) -> DataFrame:
    """Announcements of writes that have not noted anything."""
    done = bounds.filter("done").select("write").distinct()
    return bounds.filter("NOT done").join(done, "write", "left_anti")


def fold(spark: SparkSession, base: str, dataset: str) -> None:
    """Puts the rows of all finished writes together, one per instance and day; then deletes the files they were in."""
    bounds = known(spark, base, dataset)
    if bounds is None:
        return
    files = bounds.inputFiles()
    together = bounds.filter("done AND date IS NOT NULL").groupBy("instance_id", "date").agg(F.min("first").alias("first"), F.max("last").alias("last")).select(
        F.lit("folded").alias("write"), F.lit(True).alias("done"), "instance_id", "date", "first", "last")
    _append(together.unionByName(unfinished(bounds).select(*BOUNDS.names)), base, dataset)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for file in files:
        place = spark._jvm.org.apache.hadoop.fs.Path(file)
        place.getFileSystem(conf).delete(place, False)


def days_outside(bounds: DataFrame, since: str | None, until: str | None, instance: str | None = None) -> list[dt.date]:
    """Days whose folders hold no row with since <= timestamp < until, as far as is known; at most one per day of the lake."""
    open_days = [row["date"] for row in unfinished(bounds).select("date").distinct().collect()]
    if None in open_days:
        return []
    noted = bounds.filter("done AND date IS NOT NULL")
    # Of one instance: folders of others do not matter, but its own must have been noted on that day.
    noted = noted if instance is None else noted.filter(F.col("instance_id") == instance)
    late = F.lit(False) if until is None else F.coalesce(F.min("first") >= until, F.lit(True))
    early = F.lit(False) if since is None else F.coalesce(F.max("last") < since, F.lit(True))
    outside = noted.groupBy("date").agg((late | early).alias("outside")).filter("outside")
    return sorted({row["date"] for row in outside.select("date").collect()} - set(open_days))
