"""Telemetry frames derived from the given tables, whole tables each.

Orders are statements and their line items the waits inside them; customers are
servers; events are metric samples and poll cycles; parts are statement texts.
A quarter of all statements, waits, tables and indexes belongs to one of four
instances, so per-instance work is skewed on purpose.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import utc_text
from ..sources.catalogs import dealt_by_table
from .variables_fixture import VARIABLE_VALUES

CUSTOMERS_PER_TASK = 10_000
TABLE = ("instance_id", "table_schema", "table_name")


def instance(number: Column) -> Column:
    return F.concat(F.lit("inst-"), number.cast("string"))


def cluster(number: Column) -> Column:
    return F.concat(F.lit("cl-"), number.cast("string"))


def digest_of(number: Column) -> Column:
    return F.md5(F.concat(F.lit("q"), number.cast("string")))


def _cents(price: Column) -> Column:
    return F.round(price * 100).cast("bigint")


class Telemetry:
    """Builds each frame from the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def metrics(self) -> DataFrame:
        names = {"view": "Queries", "signup": "Innodb_rows_read", "click": "Threads_running",
                 "purchase": "Threads_connected"}
        name = F.lit("Aborted_connects")
        for event, status in names.items():
            name = F.when(F.col("event_type") == event, F.lit(status)).otherwise(name)
        return self.table("events").select(
            instance(F.col("user_id") % 4).alias("instance_id"), cluster(F.col("user_id") % 2).alias("cluster_id"),
            F.concat(F.lit("global_status."), name).alias("metric_name"), "value",
            F.concat(F.substring(F.col("ts").cast("string"), 1, 16), F.lit(":00")).alias("timestamp"))

    def query_digests(self) -> DataFrame:
        """Cumulative counters per instance and part, a snapshot for every month with activity."""
        server, part = F.col("l_suppkey") % 4, F.col("l_partkey")
        # Dealt out once for the sums and the window over them.
        monthly = self.table("lineitem").repartition(server, part).groupBy(
            server.alias("i"), part.alias("d"), F.substring(F.col("l_shipdate").cast("string"), 1, 7).alias("month"),
        ).agg(
            F.count("*").alias("runs"), F.sum(F.col("l_quantity").cast("bigint")).alias("examined"),
            F.sum(_cents(F.col("l_extendedprice"))).alias("cents"),
            F.count_if(F.col("l_returnflag") == "R").alias("on_disk"),
            F.count_if(F.col("l_linestatus") == "O").alias("unindexed"))
        so_far = W.partitionBy("i", "d").orderBy("month").rowsBetween(W.unboundedPreceding, 0)

        def total(name: str) -> Column:
            return F.sum(name).over(so_far)
        number = F.col("d").cast("string")
        return monthly.select(
            instance(F.col("i")).alias("instance_id"), cluster(F.col("i") % 2).alias("cluster_id"),
            digest_of(F.col("d")).alias("digest"),
            F.concat(F.lit("SELECT * FROM t"), number, F.lit(" WHERE k = ?")).alias("digest_text"),
            F.concat(F.lit("db"), (F.col("d") % 5).cast("string")).alias("schema_name"),
            total("runs").alias("exec_count"), (total("cents") * 1000000).alias("sum_timer_wait"),
            total("examined").alias("sum_rows_examined"), total("on_disk").alias("sum_created_tmp_disk_tables"),
            total("unindexed").alias("sum_no_index_used"),
            F.concat("month", F.lit("-01 00:00:00")).alias("timestamp"))

    def raw_digests(self) -> DataFrame:
        """Rows as the server's digest table has them, one snapshot per month; every 50th part has no digest."""
        part = F.col("l_partkey")
        return self.table("lineitem").groupBy(
            instance(F.col("l_suppkey") % 4).alias("instance_id"), cluster(F.col("l_suppkey") % 2).alias("cluster_id"),
            F.concat(F.substring(F.col("l_shipdate").cast("string"), 1, 7), F.lit("-01 00:00:00")).alias("timestamp"),
            part.alias("part"),
        ).agg(
            F.count("*").alias("count_star"), (F.sum(_cents(F.col("l_extendedprice"))) * 1000000).alias("sum_timer_wait"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("sum_rows_examined"),
            F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"),
            F.count_if(F.col("l_returnflag") == "R").alias("sum_created_tmp_disk_tables"),
        ).select(
            "instance_id", "cluster_id", "timestamp",
            F.when(F.col("part") % 50 != 0, digest_of(F.col("part"))).alias("digest"),
            F.concat(F.lit("SELECT "), F.col("part").cast("string")).alias("digest_text"),
            F.when(F.col("part") % 7 != 0, F.concat(F.lit("db"), (F.col("part") % 5).cast("string"))).alias("schema_name"),
            "count_star", "sum_timer_wait", "sum_rows_examined",
            F.lit(0).alias("sum_rows_sent"), F.lit(0).alias("sum_rows_affected"),
            F.lit(0).alias("sum_created_tmp_tables"), "sum_created_tmp_disk_tables", F.lit(0).alias("sum_no_index_used"),
            F.concat(F.col("first_seen").cast("string"), F.lit("Z")).cast("timestamp").alias("first_seen"),
            F.concat(F.col("last_seen").cast("string"), F.lit("Z")).cast("timestamp").alias("last_seen"))

    def index_usage(self) -> DataFrame:
        reads = F.when((F.col("l_partkey") + F.col("l_linenumber")) % 3 == 0, F.lit(0)).otherwise(
            F.col("l_quantity").cast("bigint"))
        return self.table("lineitem").groupBy(
            instance(F.col("l_suppkey") % 4).alias("instance_id"), cluster(F.col("l_suppkey") % 2).alias("cluster_id"),
            F.concat(F.lit("db"), (F.col("l_partkey") % 5).cast("string")).alias("schema_name"),
            F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("table_name"),
            self._index_name().alias("index_name"),
        ).agg(
            F.sum(reads).alias("count_read"), F.sum(F.round("l_extendedprice").cast("bigint")).alias("count_write"),
        ).withColumn("timestamp", F.lit("2024-01-01 00:00:00"))

    def raw_index_io(self) -> DataFrame:
        """The server's own index table, with system schemas and rows without an index."""
        schema = F.when(F.col("schema_name") == "db0", F.lit("mysql")).otherwise(F.col("schema_name"))
        return self.index_usage().select(
            "instance_id", "cluster_id", "timestamp", schema.alias("object_schema"),
            F.col("table_name").alias("object_name"),
            F.when(F.col("index_name") != "idx_7", F.col("index_name")).alias("index_name"), "count_read", "count_write")

    @staticmethod
    def _index_name() -> Column:
        number = F.col("l_linenumber")
        return F.when(number == 1, F.lit("PRIMARY")).otherwise(F.concat(F.lit("idx_"), number.cast("string")))

    @staticmethod
    def _clock(seconds: Column) -> Column:
        """A UTC text, `seconds` after the start of 2024."""
        return utc_text(F.timestamp_seconds(F.lit(1704067200) + seconds))

    def samples(self) -> DataFrame:
        """A fifth of the statements, the urgent ones, share one digest."""
        hot = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1)).otherwise(F.col("o_custkey"))
        return self.table("orders").select(
            instance(F.col("o_custkey") % 4).alias("instance_id"), cluster(F.col("o_custkey") % 2).alias("cluster_id"),
            (F.col("o_orderkey") + 1).alias("event_id"), (F.col("o_custkey") % 64).alias("thread_id"),
            digest_of(hot).alias("digest"), F.concat(F.lit("SELECT "), F.col("o_custkey").cast("string")).alias("sql_text"),
            _cents(F.col("o_totalprice")).alias("timer_wait"),
            ((F.col("o_orderkey") % 1000000) * 1000000000000).alias("timer_start"),
            self._clock(F.col("o_orderkey") % 1000000).alias("timestamp"))

    def raw_waits(self) -> DataFrame:
        """One wait per line item; every 7th statement's waits have no parent, every 11th's an unknown one."""
        key = F.col("l_orderkey")
        parent = F.when(key % 7 == 0, F.lit(0).cast("bigint")).when(key % 11 == 0, key + 1000000000000).otherwise(key + 1)
        return self.table("lineitem").join(self.table("orders"), key == F.col("o_orderkey")).select(
            instance(F.col("o_custkey") % 4).alias("instance_id"), cluster(F.col("o_custkey") % 2).alias("cluster_id"),
            (key * 10 + F.col("l_linenumber")).alias("event_id"), F.col("l_suppkey").alias("thread_id"),
            parent.alias("nesting_event_id"), F.concat(F.lit("wait/io/"), F.col("l_returnflag")).alias("event_name"),
            _cents(F.col("l_extendedprice")).alias("timer_wait"),
            ((key % 1000000) * 1000000000000).alias("timer_start"), self._clock(key % 1000000).alias("timestamp"))

    def index_rows(self) -> DataFrame:
        """Index parts: one to three per index, column names that differ in case between indexes."""
        lines = self._lines("l_partkey").groupBy("l_orderkey", "l_linenumber", *TABLE).agg(F.min("l_partkey").alias("l_partkey"))
        letter = F.when(F.col("l_linenumber") % 2 == 0, F.lit("C")).otherwise(F.lit("c"))
        unique = (F.col("l_linenumber") == 1) | (F.col("l_partkey") % 5 == 0)
        parts = F.explode(F.sequence(F.lit(1), (1 + F.col("l_partkey") % 3).cast("int")))
        return lines.withColumn("n", parts).select(
            *TABLE, self._index_name().alias("index_name"), F.col("n").alias("seq_in_index"),
            F.concat(letter, ((F.col("l_partkey") + F.col("n")) % 2).cast("string")).alias("column_name"),
            F.when(unique, F.lit(0)).otherwise(F.lit(1)).alias("non_unique"), F.lit("BTREE").alias("index_type"))

    @staticmethod
    def _place(key: str) -> list[Column]:
        number = F.col(key)
        return [instance(number % 4).alias("instance_id"),
                F.concat(F.lit("db"), (number % 3).cast("string")).alias("table_schema"),
                F.concat(F.lit("t"), number.cast("string")).alias("table_name")]

    def _lines(self, *names: str) -> DataFrame:
        """Line items with the order's table, dealt out by it: one shuffle for what is taken per line and then per table."""
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", *names, *self._place("l_orderkey"))
        return dealt_by_table(lines, ("instance_id",))

    def table_rows(self) -> DataFrame:
        """Orders as tables; the finished ones are views without a data size, some schemas are the server's."""
        schema = F.when(F.col("o_orderkey") % 13 == 0, F.lit("sys")).otherwise(F.col("table_schema"))
        view = F.col("o_orderstatus") == "F"
        return self.table("orders").select("*", *self._place("o_orderkey")).select(
            "instance_id", schema.alias("table_schema"), "table_name",
            F.when(view, F.lit("VIEW")).otherwise(F.lit("BASE TABLE")).alias("table_type"),
            F.when(~view, F.col("o_custkey")).alias("table_rows"),
            F.when(~view, F.col("o_totalprice").cast("bigint")).alias("data_length"),
            (F.col("o_custkey") * 10).alias("index_length"),
            F.when(~view, F.lit("InnoDB")).alias("engine"))

    def column_rows(self) -> DataFrame:
        """Line items as columns of the order's table."""
        lines = self._lines("l_partkey", "l_returnflag", "l_linestatus").groupBy("l_orderkey", "l_linenumber", *TABLE).agg(
            F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
        text = F.col("flag") == "A"
        return lines.select(
            *TABLE, F.concat(F.lit("c"), (F.col("part") % 2).cast("string"), F.lit("_"),
                                                 F.col("l_linenumber").cast("string")).alias("column_name"),
            F.col("l_linenumber").alias("ordinal_position"),
            F.when(text, F.lit("varchar")).otherwise(F.lit("bigint")).alias("data_type"),
            F.when(text, F.lit("varchar(64)")).otherwise(F.lit("bigint unsigned")).alias("column_type"),
            F.when(F.col("status") == "O", F.lit("YES")).otherwise(F.lit("NO")).alias("is_nullable"),
            F.when(F.col("l_linenumber") == 1, F.lit("PRI")).alias("column_key"), F.lit(None).cast("string").alias("extra"),
            F.when(F.col("part") % 3 == 0, F.lit("0")).alias("column_default"),
            F.when(text, F.lit("utf8mb4")).alias("character_set_name"),
            F.when(text, F.lit("utf8mb4_bin")).alias("collation_name"),
            F.lit("").alias("column_comment"), F.lit(None).cast("string").alias("generation_expression"))

    def _per_customer(self, rows: list[tuple], names: list[str]) -> DataFrame:
        """Every customer with each of `rows`, a fixed list."""
        kind = ",".join(f"{name}:string" for name in names)
        text = json.dumps([dict(zip(names, row)) for row in rows])
        items = F.explode(F.from_json(F.lit(text), f"array<struct<{kind}>>"))
        return self._customers().select("c_custkey", items.alias("item")).select("c_custkey", "item.*")

    def _customers(self) -> DataFrame:
        """Customers spread before each of them becomes many rows: over the cores, or where there are more, so that a task has few."""
        customers = self.table("customer")
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-customers.count() // CUSTOMERS_PER_TASK))
        return customers.repartition(tasks, "c_custkey")

    def global_variables(self) -> DataFrame:
        """Three configurations in turn; a variable a configuration does not have is absent."""
        rows = self._per_customer(VARIABLE_VALUES, ["variable_name", "a", "b", "c"])
        kind = F.col("c_custkey") % 3
        value = F.when(kind == 0, F.col("a")).when(kind == 1, F.col("b")).otherwise(F.col("c"))
        return rows.select(instance(F.col("c_custkey")).alias("instance_id"), "variable_name",
                           value.alias("variable_value")).filter("variable_value IS NOT NULL")

    def global_status(self) -> DataFrame:
        """Counters of every server, malformed and huge ones among them."""
        key = F.col("c_custkey")
        values = {
            "Uptime": (key % 5).cast("string"), "Questions": (key * 7).cast("string"),
            "Queries": F.concat((key * 9).cast("string"), F.when(key % 10 == 0, F.lit("x")).otherwise(F.lit(""))),
            "Threads_running": (key % 11).cast("string"), "Threads_connected": (key * 3).cast("string"),
            "Innodb_buffer_pool_read_requests": (key * 7).cast("string"),
            "Innodb_buffer_pool_reads": (key % 11).cast("string"), "Innodb_rows_read": (key * 3).cast("string"),
            "Connections": F.when(key % 6 == 0, F.lit("99999999999999999999")).otherwise((key * 2).cast("string")),
            "uptime_since_flush": key.cast("string"), "Innodb_deadlocks": F.concat(F.lit(" "), key.cast("string")),
        }
        entries = F.array(*(F.struct(F.lit(name).alias("variable_name"), value.alias("variable_value"))
                            for name, value in values.items()))
        return self._customers().select(
            instance(key).alias("instance_id"), cluster(key % 2).alias("cluster_id"),
            F.lit("2024-01-01 00:00:00").alias("timestamp"), F.explode(entries).alias("e"),
        ).select("instance_id", "cluster_id", "timestamp", "e.*")

    def processlist(self) -> DataFrame:
        return self.table("events").select(
            instance(F.col("user_id") % 4).alias("instance_id"), cluster(F.col("user_id") % 2).alias("cluster_id"),
            F.concat(F.substring(F.col("ts").cast("string"), 1, 13), F.lit(":00:00")).alias("timestamp"),
            F.col("event_id").alias("id"),
            F.when(F.col("event_type") == "view", F.lit("Sleep")).otherwise(F.lit("Query")).alias("command"))

    def innodb_counters(self) -> DataFrame:
        """Suppliers as counters of the server's metrics table."""
        return self.table("supplier").select(
            instance(F.col("s_suppkey") % 4).alias("instance_id"), cluster(F.col("s_suppkey") % 2).alias("cluster_id"),
            F.lit("2024-01-01 00:00:00").alias("timestamp"), F.col("s_name").alias("name"),
            F.floor("s_acctbal").cast("bigint").alias("count"),
            F.when(F.col("s_acctbal") > 2000, F.lit("enabled")).otherwise(F.lit("disabled")).alias("status"))

    def engine_rows(self) -> DataFrame:
        rows = self._per_customer(
            [("InnoDB", "DEFAULT", "YES"), ("MyISAM", "YES", "NO"), ("CSV", "NO", None), ("MEMORY", "YES", None),
             ("FEDERATED", None, None)], ["engine", "support", "transactions"])
        return rows.select(instance(F.col("c_custkey")).alias("instance_id"), "engine", "support", "transactions")

    def servers(self) -> DataFrame:
        version = F.when(F.col("c_custkey") % 3 == 0, F.lit("8.0.35")).otherwise(F.lit("5.7.44-log"))
        return self.table("customer").select(
            instance(F.col("c_custkey")).alias("instance_id"), cluster(F.col("c_nationkey")).alias("cluster_id"),
            version.alias("version"), F.col("c_name").alias("hostname"))

    def replica_rows(self) -> DataFrame:
        """Status maps of the servers that are replicas, two channels on some; lag texts good, bad and absent."""
        key = F.col("c_custkey")
        lag = F.when(key % 5 == 0, F.lit(None).cast("string")).when(key % 7 == 0, F.lit("n/a")).otherwise(key.cast("string"))
        channels = F.when(key % 6 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("")))
        rows = self.table("customer").filter(F.col("c_mktsegment") != "BUILDING").select(
            key, lag.alias("lag"), F.explode(channels).alias("channel"))
        status = F.create_map(
            F.lit("Channel_Name"), F.col("channel"), F.lit("Slave_IO_Running"),
            F.concat(F.lit("Yes"), F.col("channel")), F.lit("Slave_SQL_Running"), F.lit("No"),
            F.lit("Seconds_Behind_Master"), F.col("lag"))
        return rows.select(instance(key).alias("instance_id"), status.alias("status"))

    def clusters(self) -> DataFrame:
        """One per nation, in three forms of address, and one without members per region."""
        nation = F.col("n_nationkey")
        host = F.when(nation % 3 == 0, F.concat(F.lit("main-"), nation.cast("string"), F.lit(".db.example.net"))).when(
            nation % 3 == 1, F.concat(F.lit("main-"), nation.cast("string"))).otherwise(
            F.concat(F.lit("main-"), nation.cast("string"), F.lit(".")))
        named = self.table("nation").select(cluster(nation).alias("cluster_id"), host.alias("endpoint"))
        empty = self.table("region").select(
            F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("cluster_id"),
            F.concat("r_name", F.lit(".db.example.net")).alias("endpoint"))
        return named.unionByName(empty)

    def replica_hosts(self) -> DataFrame:
        first = self.table("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"))
        return self.table("supplier").join(first, "s_nationkey").select(
            cluster(F.col("s_nationkey")).alias("cluster_id"), F.col("s_name").alias("server_id"),
            F.when(F.col("s_suppkey") == F.col("first"), F.lit("MASTER_SESSION_ID")).alias("session_id"))

    def known_members(self) -> DataFrame:
        """Members before a discovery: suppliers below a balance of 8000."""
        return self.table("supplier").filter("s_acctbal < 8000").select(
            cluster(F.col("s_nationkey")).alias("cluster_id"), F.col("s_name").alias("server_id"),
            F.concat("s_name", F.lit(":3306")).alias("endpoint"))

    def discovered_members(self) -> DataFrame:
        """Members found: balances of 1000 and more; nation 3 is found with unreachable ones only."""
        listed = (F.col("s_acctbal") >= 1000) & ((F.col("s_nationkey") != 3) | (F.col("s_acctbal") >= 8000))
        return self.table("supplier").filter(listed).select(
            cluster(F.col("s_nationkey")).alias("cluster_id"), F.col("s_name").alias("server_id"),
            F.concat("s_name", F.lit(":3306")).alias("endpoint"),
            ((F.col("s_acctbal") < 9500) & (F.col("s_nationkey") != 3)).alias("reachable"))

    def poll_log(self) -> DataFrame:
        hour = F.concat(F.substring(F.col("ts").cast("string"), 1, 13), F.lit(":00:00"))
        errors = F.count_if(F.col("event_type") == "error")
        return self.table("events").groupBy(
            instance(F.col("user_id") % 4).alias("instance_id"), cluster(F.col("user_id") % 2).alias("cluster_id"),
            hour.alias("ts"),
        ).agg((errors * 3 >= F.count("*")).alias("failed"))
