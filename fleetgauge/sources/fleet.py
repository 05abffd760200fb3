"""Catalog rows of a whole fleet in one read: servers are the partitions of a data source.

What a catalog needs of a server is one statement with its columns, filter, order and limit, so a server sorts and cuts its
own rows. Statements can also be given to Spark's JDBC reader, one server a read (`landed.jdbc_options`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SYSTEM_SCHEMAS
from .counters import CURATED_STATUS


def _listed(values: Sequence[str]) -> str:
    return ", ".join("'" + v + "'" for v in values)


@dataclass(frozen=True)
class Catalog:
    """A server table and what of it is read. `mark` is a column of growing ids, read above a high-water mark."""

    table: str
    columns: tuple[str, ...]
    where: str = ""
    order: str = ""
    limit: int | None = None
    mark: str = ""
    statement: str = field(default="")  # instead of a query, where the server has no table for it

    def sql(self, above: int | None = None) -> str:
        if self.statement:
            return self.statement
        conditions = [c for c in (self.where, f"{self.mark} > {int(above)}" if self.mark and above is not None else "") if c]
        return " ".join((f"SELECT {', '.join(self.columns)} FROM {self.table}", *([f"WHERE {' AND '.join(conditions)}"] if conditions else []),
                         *([f"ORDER BY {self.order}"] if self.order else []), *([f"LIMIT {self.limit}"] if self.limit else [])))


_USER = f"NOT IN ({_listed(SYSTEM_SCHEMAS)})"
_COUNTED = ("count_star", "sum_timer_wait", "sum_rows_examined", "sum_rows_sent", "sum_rows_affected", "sum_created_tmp_tables",
            "sum_created_tmp_disk_tables", "sum_no_index_used")

# Tables and columns of the server's catalogs, as the transforms of `sources` read them.
CATALOGS: dict[str, Catalog] = {
    "global_variables": Catalog("performance_schema.global_variables", ("variable_name", "variable_value")),
    "global_status": Catalog("performance_schema.global_status", ("variable_name", "variable_value")),
    "curated_status": Catalog("performance_schema.global_status", ("variable_name", "variable_value"),
                              f"variable_name IN ({_listed(CURATED_STATUS)})"),
    "identity": Catalog("performance_schema.global_variables", ("variable_name", "variable_value"),
                        "variable_name IN ('aurora_server_id', 'hostname')"),
    "statement_digests": Catalog(
        "performance_schema.events_statements_summary_by_digest", ("digest", "digest_text", "schema_name", *_COUNTED, "first_seen", "last_seen"),
        "digest IS NOT NULL AND count_star > 0", "sum_timer_wait DESC, schema_name, digest", 100),
    "index_io": Catalog(
        "performance_schema.table_io_waits_summary_by_index_usage", ("object_schema", "object_name", "index_name", "count_read", "count_write"),
        f"index_name IS NOT NULL AND object_schema {_USER}"),
    "statement_events": Catalog(
        "performance_schema.events_statements_history_long",
        ("event_id", "thread_id", "digest", "sql_text", "timer_start", "timer_wait", "rows_examined", "rows_sent", "rows_affected",
         "created_tmp_tables", "created_tmp_disk_tables", "no_index_used", "current_schema"), mark="event_id"),
    "wait_events": Catalog(
        "performance_schema.events_waits_history_long",
        ("event_id", "thread_id", "nesting_event_id", "event_name", "timer_start", "timer_wait", "operation", "source"), mark="event_id"),
    "processlist": Catalog("information_schema.processlist", ("id", "command")),
    "innodb_metrics": Catalog("information_schema.innodb_metrics", ("name", "count", "status"), "status = 'enabled'"),
    "tables": Catalog(
        "information_schema.tables", ("table_schema", "table_name", "table_type", "table_rows", "data_length", "index_length", "engine"),
        f"table_schema {_USER}"),
    "columns": Catalog(
        "information_schema.columns",
        ("table_schema", "table_name", "column_name", "ordinal_position", "data_type", "column_type", "is_nullable", "column_key", "extra",
         "column_default", "character_set_name", "collation_name", "column_comment", "generation_expression"), f"table_schema {_USER}"),
    "statistics": Catalog(
        "information_schema.statistics",
        ("table_schema", "table_name", "index_name", "seq_in_index", "column_name", "non_unique", "index_type"), f"table_schema {_USER}"),
    "engines": Catalog("information_schema.engines", ("engine", "support"), "support <> 'NO'"),
    "replica_hosts": Catalog("information_schema.replica_host_status", ("server_id", "session_id")),
    # Its columns differ between versions, so a row is a map.
    "replica_status": Catalog("", (), statement="SHOW SLAVE STATUS"),
}


@dataclass(frozen=True)
class Server:
    instance_id: str
    cluster_id: str
    host: str
    port: int = 3306


def read_fleet(
    spark: SparkSession, servers: Sequence[Server], catalog: str, connect: Callable[[str, int], Any], timestamp: str, *,
    marks: dict[str, int] | None = None, servers_per_task: int = 1,
) -> DataFrame:
    """(instance_id, cluster_id, timestamp, error, *columns as text) of one catalog of all servers, in one read.

    `connect(host, port)` opens a connection of a Python database driver (DB-API 2.0) in the executor; it knows the
    credentials, so none are in a plan. A server that cannot be reached or refuses the statement gives one row with the
    `error` and null columns, and does not stop the others: keep `answered(rows)`, and report `failed(rows)`. `marks` are the
    high-water marks of the instances, for event catalogs. The catalog `replica_status` has a `status` map.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    wanted, above = CATALOGS[catalog], marks or {}
    as_map = bool(wanted.statement)
    head = [T.StructField(n, T.StringType()) for n in ("instance_id", "cluster_id", "timestamp", "error")]
    body = [T.StructField("status", T.MapType(T.StringType(), T.StringType()))] if as_map else [
        T.StructField(name, T.StringType()) for name in wanted.columns]
    schema, width = T.StructType(head + body), len(body)
    slices = [tuple((s.instance_id, s.cluster_id, s.host, s.port, wanted.sql(above.get(s.instance_id, 0 if wanted.mark else None)))
                    for s in servers[i:i + servers_per_task]) for i in range(0, len(servers), servers_per_task)]

    def text(value: Any) -> str | None:
        if value is None or isinstance(value, str):
            return value
        return bytes(value).decode("utf-8", "replace") if isinstance(value, (bytes, bytearray)) else str(value)

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(part) for part in slices]

        def read(self, partition):
            for instance, cluster, host, port, statement in partition.value:
                who = (instance, cluster, timestamp)
                try:
                    connection = connect(host, port)
                    try:
                        cursor = connection.cursor()
                        cursor.execute(statement)
                        names = [d[0] for d in cursor.description]
                        while rows := cursor.fetchmany(1000):
                            for row in rows:
                                values = [text(v) for v in row]
                                yield (*who, None, dict(zip(names, values))) if as_map else (*who, None, *values)
                    finally:
                        connection.close()
                except Exception as error:  # noqa: BLE001
                    yield (*who, f"{type(error).__name__}: {error}", *[None] * width)

    class Fleet(DataSource):
        @classmethod
        def name(cls):
            return f"fleet_{catalog}"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Fleet)
    return spark.read.format(Fleet.name()).load()


def answered(rows: DataFrame) -> DataFrame:
    """Rows of servers that answered to the end; of one that broke off half way nothing is kept."""
    broken = rows.filter("error IS NOT NULL").select("instance_id").distinct()
    return rows.join(broken, "instance_id", "left_anti").drop("error")


def failed(rows: DataFrame) -> DataFrame:
    return rows.filter("error IS NOT NULL").select("instance_id", "cluster_id", "timestamp", "error")
