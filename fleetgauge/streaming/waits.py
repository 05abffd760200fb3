"""Wait events per statement and five seconds of event time, continuously, whatever comes first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import five_second_bucket, or_empty, utc_text
from ..schemas import COUNTER
from .cells import CELL, SLICE, CellTable, cell_of, dealt, names, start

KEYS = ("instance_id", "cluster_id", "parent_digest", "event_name")
OWN = ("instance_id", "cluster_id", "nesting_event_id", "event_name", "timestamp")
STATEMENT = ("instance_id", "nesting_event_id")
SUMMED = T.StructType([
    *(T.StructField(n, COUNTER if n == "nesting_event_id" else T.StringType()) for n in OWN),
    T.StructField("count", COUNTER), T.StructField("total_wait", COUNTER)])
PARENTS = T.StructType([
    T.StructField("instance_id", T.StringType()), T.StructField("nesting_event_id", COUNTER),
    T.StructField("seen", T.TimestampType()), T.StructField("digest", T.StringType())])
MOVES = T.StructType([*(T.StructField(n, T.StringType()) for n in (*KEYS, "timestamp")),
                      T.StructField("count", COUNTER), T.StructField("total_wait", COUNTER)])


@dataclass(frozen=True)
class WaitSummaries:
    """Below `path`, sums of waits per statement, event and bucket; statements; and what each batch changed of the summary.

    Waits and statements may arrive in any order and at any distance. A wait whose statement is not known counts under the
    digest ''; when the statement comes, its sums move: the batch takes them from '' and adds them to the digest. The same
    happens where a statement comes again with a newer digest. So the summary is the sum of what all batches wrote.

    The waits of a statement are summed per event and bucket at once, so one with very many is a few rows. Both tables are
    cut into cells by a hash of instance and statement and by range of statement ids (`span` ids each), which grow, so
    that old cells rest. Waits outside any statement (id 0 or null) have no partner and are kept in no table.
    """

    path: str
    parts: int = 64
    span: int = 10_000_000

    def _table(self, name: str) -> CellTable:
        return CellTable(f"{self.path.rstrip('/')}/{name}")

    def _cell(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(CELL, cell_of(STATEMENT, self.parts, F.expr(f"cast(nesting_event_id div {self.span} AS string)")))

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Buckets are numbers until groups are made of them; texts are made once a group.
        seconds = F.unix_seconds(F.col("event_time").cast("timestamp"))
        bucket = F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(5))).alias("timestamp")
        waits = batch.filter("_wait").select(
            "instance_id", "cluster_id", F.coalesce("nesting_event_id", F.lit(0)).cast(COUNTER).alias("nesting_event_id"), "event_name", bucket, "timer_wait",
        ).groupBy(*OWN).agg(F.count("*").cast(COUNTER).alias("count"), F.sum("timer_wait").cast(COUNTER).alias("total_wait")).withColumn(
            "timestamp", five_second_bucket(utc_text(F.col("timestamp"))))
        newest = F.max(F.struct(F.col("event_time").alias("seen"), or_empty(F.col("digest")).alias("digest"))).alias("_p")
        said = batch.filter("NOT _wait AND event_id IS NOT NULL").groupBy(
            "instance_id", F.col("event_id").cast(COUNTER).alias("nesting_event_id")).agg(newest).select(*STATEMENT, "_p.*")
        both = lambda sums, parents: sums.withColumn("_wait", F.lit(True)).unionByName(
            parents.withColumn("_wait", F.lit(False)), allowMissingColumns=True)
        fresh = self._cell(both(waits, said)).persist()
        held = fresh.filter("NOT _wait OR nesting_event_id != 0")
        touched = names(held)
        known = both(self._table("waits").read(spark, SUMMED, touched, before=number),
                     self._table("statements").read(spark, PARENTS, touched, before=number))
        # Dealt out once: the sums of a statement find its digests, the one before the batch and the one after it, beside them.
        one = Window.partitionBy(CELL, SLICE, *STATEMENT)
        newest = lambda of: F.max(F.when(of, F.struct("seen", "digest"))).over(one)
        rows = dealt(held.withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False))), STATEMENT).withColumns({
            "_from": newest(~F.col("_wait") & ~F.col("_new")), "_to": newest(~F.col("_wait"))}).persist()

        # Sums that were there before move if the digest of their statement changed.
        before, after = or_empty(F.col("_from.digest")), F.col("_to.digest")
        side = lambda digest, sign: F.struct(digest.alias("parent_digest"), F.lit(sign).alias("sign"))
        sides = F.when(F.col("_new"), F.array(side(or_empty(after), 1))).when(after != before, F.array(side(before, -1), side(after, 1)))
        own = ("instance_id", "cluster_id", "event_name", "timestamp", "count", "total_wait")
        moved = rows.filter("_wait").select(*own, F.inline(sides)).unionByName(
            fresh.filter("_wait AND nesting_event_id = 0").select(*own, F.lit("").alias("parent_digest"), F.lit(1).alias("sign")))
        moves = moved.groupBy(*KEYS, "timestamp").agg(*(
            F.sum((F.col(n) * F.col("sign")).cast(COUNTER)).cast(COUNTER).alias(n) for n in ("count", "total_wait")))
        moves.filter("count != 0 OR total_wait != 0").select(*MOVES.names).write.mode("overwrite").parquet(
            f"{self.path.rstrip('/')}/moves/batch={number}")
        self._table("waits").replace(number, rows.filter("_wait").groupBy(CELL, SLICE, *OWN).agg(
            F.sum("count").cast(COUNTER).alias("count"), F.sum("total_wait").cast(COUNTER).alias("total_wait")).drop(SLICE), touched, in_place=True)
        self._table("statements").replace(
            number, rows.filter("NOT _wait").select(CELL, SLICE, *STATEMENT, "_to.*").distinct().drop(SLICE), touched, in_place=True)
        rows.unpersist()
        fresh.unpersist()

    def summary(self, spark: SparkSession) -> DataFrame:
        """Wait-event rows as all batches together say."""
        moves = spark.read.schema(MOVES).parquet(f"{self.path.rstrip('/')}/moves")
        return moves.groupBy(*KEYS, "timestamp").agg(
            F.sum("count").cast(COUNTER).alias("count"), F.sum("total_wait").cast(COUNTER).alias("total_wait"),
        ).filter("count != 0").select(*KEYS, "count", "total_wait", "timestamp")


def stream_wait_summary(
    waits: DataFrame, samples: DataFrame, summaries: WaitSummaries, checkpoint: str, every: str = "1 minute", once: bool = False
) -> StreamingQuery:
    """Starts one query on the streams of waits and of statements, both with `event_time`; `summaries.summary` reads its result."""
    own = ("instance_id", "cluster_id", "nesting_event_id", "event_name", "timer_wait", "event_time")
    rows = waits.select(*own, F.lit(True).alias("_wait")).unionByName(
        samples.select("instance_id", "event_id", "digest", "event_time", F.lit(False).alias("_wait")), allowMissingColumns=True)
    return start(rows, summaries, checkpoint, every, once)
