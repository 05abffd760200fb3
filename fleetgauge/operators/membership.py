"""Cluster membership between two discoveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import with_group


def topology_diff(current: DataFrame, discovered: DataFrame) -> DataFrame:
    """(cluster_id, server_id, endpoint, status): kept, added or removed.

    `current` has (cluster_id, server_id, endpoint), `discovered` also
    `reachable`. A known server that is still listed stays without a test, a new
    one must be reachable. Where that leaves a cluster with nobody, discovery is
    not believed and its current members all stay.
    """
    old = current.select("cluster_id", "server_id", F.col("endpoint").alias("_old"), F.lit(True).alias("_known"))
    new = discovered.select("cluster_id", "server_id", F.col("endpoint").alias("_new"), F.lit(True).alias("_listed"),
                            F.coalesce("reachable", F.lit(False)).alias("_reachable"))
    known, listed = F.coalesce("_known", F.lit(False)), F.coalesce("_listed", F.lit(False))
    members = old.join(new, ["cluster_id", "server_id"], "full_outer").select(
        "cluster_id", "server_id", known.alias("_known"),
        (listed & (known | F.coalesce("_reachable", F.lit(False)))).alias("_usable"),
        F.coalesce("_old", "_new").alias("endpoint"),
    ).filter("_known OR _usable")
    members = with_group(members, ["cluster_id"], F.col("server_id"), _believed=F.bool_or("_usable"))
    status = (F.when(F.col("_known") & (F.col("_usable") | ~F.col("_believed")), F.lit("kept"))
              .when(F.col("_known"), F.lit("removed")).otherwise(F.lit("added")))
    return members.select("cluster_id", "server_id", "endpoint", status.alias("status"))
