"""Cluster members and instance names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dns_suffix, first_non_empty, or_empty

WRITER_SESSION = "MASTER_SESSION_ID"  # fixed value


def topology(clusters: DataFrame, replica_hosts: DataFrame) -> DataFrame:
    """(cluster_id, server_id, endpoint, is_writer) for every cluster.

    `clusters` has (cluster_id, endpoint); `replica_hosts` has (cluster_id,
    server_id, session_id). A cluster without member rows is one writer that is
    reached at the cluster endpoint itself.
    """
    addressed = clusters.select("cluster_id", F.col("endpoint").alias("_endpoint"))
    suffix = dns_suffix(F.col("_endpoint"))
    members = replica_hosts.join(addressed, "cluster_id").select(
        "cluster_id", "server_id",
        F.when(suffix != "", F.concat("server_id", F.lit("."), suffix)).otherwise(F.col("server_id")).alias("endpoint"),
        (or_empty(F.col("session_id")) == WRITER_SESSION).alias("is_writer"))
    alone = addressed.join(replica_hosts.select("cluster_id").distinct(), "cluster_id", "left_anti").select(
        "cluster_id", F.col("_endpoint").alias("server_id"), F.col("_endpoint").alias("endpoint"),
        F.lit(True).alias("is_writer"))
    return members.unionByName(alone)


def host_identity(override: Column, aurora_server_id: Column, hostname: Column, target: Column) -> Column:
    """The first name that is not empty: set by hand, Aurora's, the host's, the connection target."""
    return first_non_empty(override, aurora_server_id, hostname, target)
