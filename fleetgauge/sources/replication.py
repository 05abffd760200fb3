"""Replication state from SHOW REPLICA/SLAVE STATUS rows landed as maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import or_empty, strict_int


def replica_status(instances: DataFrame, raw: DataFrame) -> DataFrame:
    """(instance_id, is_replica, slave_io_running, slave_sql_running, seconds_behind_master).

    `raw` has (instance_id, status map): its keys differ between server versions,
    and an instance that refused the statement has no row. Where a server has
    several channels the first one in channel order is reported.
    """
    def field(name: str):
        return F.element_at("status", F.lit(name))
    rows = raw.select(
        "instance_id",
        F.struct(
            or_empty(field("Channel_Name")).alias("channel"),
            or_empty(field("Slave_IO_Running")).alias("slave_io_running"),
            or_empty(field("Slave_SQL_Running")).alias("slave_sql_running"),
            strict_int("element_at(status, 'Seconds_Behind_Master')").alias("seconds_behind_master"),
        ).alias("channel_state"),
    )
    first = rows.groupBy("instance_id").agg(F.min("channel_state").alias("state"))
    return instances.select("instance_id").distinct().join(first, "instance_id", "left").select(
        "instance_id",
        F.col("state").isNotNull().alias("is_replica"),
        or_empty(F.col("state.slave_io_running")).alias("slave_io_running"),
        or_empty(F.col("state.slave_sql_running")).alias("slave_sql_running"),
        F.col("state.seconds_behind_master").alias("seconds_behind_master"),
    )
