"""Readers and the transforms that turn raw catalog frames into typed telemetry."""

from .catalogs import column_catalog, engines, index_catalog, server_info, table_catalog
from .counters import (
    CURATED_STATUS, digest_top, global_status_metrics, index_usage, innodb_metrics, poll_metrics, processlist_metrics,
)
from .events import buffer_bounds, high_water_marks, statement_tail, wait_tail
from .fleet import CATALOGS, Catalog, Server, answered, failed, read_fleet
from .lake import read_lake, register_views
from .landed import CATALOG_TABLES, jdbc_options, read_jdbc, read_landed, union_instances
from .replication import replica_status
from .topology import host_identity, topology
from .variables import global_variables, show_to_map, variable_columns

__all__ = [
    "CATALOGS", "CATALOG_TABLES", "CURATED_STATUS", "Catalog", "Server", "answered", "buffer_bounds", "column_catalog", "digest_top", "engines", "failed",
    "global_status_metrics", "global_variables", "high_water_marks", "host_identity", "index_catalog", "index_usage",
    "innodb_metrics", "jdbc_options", "poll_metrics", "processlist_metrics", "read_fleet", "read_jdbc", "read_lake",
    "read_landed", "register_views", "replica_status", "server_info", "show_to_map", "statement_tail",
    "table_catalog", "topology", "union_instances", "variable_columns", "wait_tail",
]
