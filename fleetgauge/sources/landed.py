"""Getting raw catalog rows: from landed Parquet, or over JDBC.

The JDBC driver is not part of Spark; `read_jdbc` needs it on the class path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fleet import CATALOGS

# The server tables behind the raw frames.
CATALOG_TABLES = {name: catalog.table for name, catalog in CATALOGS.items() if catalog.table}


def jdbc_options(host: str, port: int, user: str, password: str, catalog: str, above: int | None = None) -> dict[str, str]:
    """Options to read one catalog of one server: 5 s to connect, 30 s to read.

    The server filters, sorts and cuts: the statement has the catalog's columns, its top 100 or its ids `above` a mark.
    """
    if CATALOGS[catalog].statement:
        raise ValueError(f"{catalog} is no query; read it with read_fleet")
    return {
        "url": f"jdbc:mysql://{host}:{port}/?connectTimeout=5000&socketTimeout=30000",
        "user": user,
        "password": password,
        "query": CATALOGS[catalog].sql(above),
        "driver": "com.mysql.cj.jdbc.Driver",
    }


def tagged(rows: DataFrame, instance_id: str, cluster_id: str, timestamp: str) -> DataFrame:
    """Lower-case column names plus who was polled and when the cycle began."""
    lowered = rows.select(*(F.col(f"`{name}`").alias(name.lower()) for name in rows.columns))
    return lowered.select(
        F.lit(instance_id).alias("instance_id"), F.lit(cluster_id).alias("cluster_id"),
        F.lit(timestamp).alias("timestamp"), "*",
    )


def read_jdbc(
    spark: SparkSession, options: dict[str, str], instance_id: str, cluster_id: str, timestamp: str
) -> DataFrame:
    return tagged(spark.read.format("jdbc").options(**options).load(), instance_id, cluster_id, timestamp)


def union_instances(frames: list[DataFrame]) -> DataFrame:
    """All instances of one cycle as one frame; a column one server lacks is NULL there.

    Frames are united in pairs, so that the plan of thousands of servers is as deep as the logarithm of their number.
    """
    while len(frames) > 1:
        pairs = [frames[i:i + 2] for i in range(0, len(frames), 2)]
        frames = [p[0].unionByName(p[1], allowMissingColumns=True) if len(p) == 2 else p[0] for p in pairs]
    return frames[0]


def read_landed(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Raw catalog rows of all instances that were landed as Parquet."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)
