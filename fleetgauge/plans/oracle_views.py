"""The derived telemetry in SQL, over the same tables."""

from __future__ import annotations

import re

from .variables_fixture import VARIABLE_VALUES


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_VARIABLES = ", ".join(f"({', '.join(_text(value) for value in row)})" for row in VARIABLE_VALUES)

VIEWS = {
    "metrics": """
        SELECT 'inst-' || (user_id % 4) AS instance_id, 'cl-' || (user_id % 2) AS cluster_id,
               'global_status.' || CASE event_type WHEN 'view' THEN 'Queries' WHEN 'signup' THEN 'Innodb_rows_read'
                   WHEN 'click' THEN 'Threads_running' WHEN 'purchase' THEN 'Threads_connected'
                   ELSE 'Aborted_connects' END AS metric_name,
               value, strftime(ts, '%Y-%m-%d %H:%M:00') AS timestamp
        FROM events""",
    "query_digests": """
        SELECT 'inst-' || i AS instance_id, 'cl-' || (i % 2) AS cluster_id, md5('q' || d) AS digest,
               'SELECT * FROM t' || d || ' WHERE k = ?' AS digest_text, 'db' || (d % 5) AS schema_name,
               CAST(sum(runs) OVER w AS BIGINT) AS exec_count, CAST(sum(cents) OVER w AS BIGINT) * 1000000 AS sum_timer_wait,
               CAST(sum(examined) OVER w AS BIGINT) AS sum_rows_examined,
               CAST(sum(on_disk) OVER w AS BIGINT) AS sum_created_tmp_disk_tables,
               CAST(sum(unindexed) OVER w AS BIGINT) AS sum_no_index_used, mon || '-01 00:00:00' AS timestamp
        FROM (SELECT l_suppkey % 4 AS i, l_partkey AS d, strftime(l_shipdate, '%Y-%m') AS mon, count(*) AS runs,
                     sum(CAST(l_quantity AS BIGINT)) AS examined, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents,
                     count(*) FILTER (l_returnflag = 'R') AS on_disk, count(*) FILTER (l_linestatus = 'O') AS unindexed
              FROM lineitem GROUP BY ALL)
        WINDOW w AS (PARTITION BY i, d ORDER BY mon ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "index_usage": """
        SELECT 'inst-' || (l_suppkey % 4) AS instance_id, 'cl-' || (l_suppkey % 2) AS cluster_id,
               'db' || (l_partkey % 5) AS schema_name, 't' || l_partkey AS table_name,
               CASE WHEN l_linenumber = 1 THEN 'PRIMARY' ELSE 'idx_' || l_linenumber END AS index_name,
               CAST(sum(CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN 0 ELSE l_quantity END) AS BIGINT) AS count_read,
               CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS count_write,
               '2024-01-01 00:00:00' AS timestamp
        FROM lineitem GROUP BY ALL""",
    "samples": """
        SELECT 'inst-' || (o_custkey % 4) AS instance_id, 'cl-' || (o_custkey % 2) AS cluster_id,
               o_orderkey + 1 AS event_id, o_custkey % 64 AS thread_id,
               md5('q' || CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE o_custkey END) AS digest,
               'SELECT ' || o_custkey AS sql_text, CAST(round(o_totalprice * 100) AS BIGINT) AS timer_wait,
               (o_orderkey % 1000000) * 1000000000000 AS timer_start,
               strftime(TIMESTAMP '2024-01-01' + to_seconds(o_orderkey % 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp
        FROM orders""",
    "raw_waits": """
        SELECT 'inst-' || (o_custkey % 4) AS instance_id, 'cl-' || (o_custkey % 2) AS cluster_id,
               l_orderkey * 10 + l_linenumber AS event_id, l_suppkey AS thread_id,
               CASE WHEN l_orderkey % 7 = 0 THEN 0 WHEN l_orderkey % 11 = 0 THEN l_orderkey + 1000000000000
                    ELSE l_orderkey + 1 END AS nesting_event_id,
               'wait/io/' || l_returnflag AS event_name, CAST(round(l_extendedprice * 100) AS BIGINT) AS timer_wait,
               strftime(TIMESTAMP '2024-01-01' + to_seconds(l_orderkey % 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "correlated": """
        SELECT w.*, coalesce(s.digest, '') AS parent_digest
        FROM raw_waits w LEFT JOIN samples s ON s.instance_id = w.instance_id AND s.event_id = w.nesting_event_id""",
    "wait_events": """
        SELECT instance_id, cluster_id, parent_digest, event_name, count(*) AS count,
               CAST(sum(timer_wait) AS BIGINT) AS total_wait,
               strftime(time_bucket(INTERVAL 5 SECONDS, CAST(timestamp AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS timestamp
        FROM correlated GROUP BY ALL""",
    "index_rows": """
        SELECT 'inst-' || (l_orderkey % 4) AS instance_id, 'db' || (l_orderkey % 3) AS table_schema,
               't' || l_orderkey AS table_name,
               CASE WHEN l_linenumber = 1 THEN 'PRIMARY' ELSE 'idx_' || l_linenumber END AS index_name, n AS seq_in_index,
               CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'c' END || ((l_partkey + n) % 2) AS column_name,
               CASE WHEN l_linenumber = 1 OR l_partkey % 5 = 0 THEN 0 ELSE 1 END AS non_unique
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL),
             (VALUES (1), (2), (3)) s(n)
        WHERE n <= 1 + l_partkey % 3""",
    "indexes": """
        SELECT instance_id, table_schema, table_name, index_name, list(column_name ORDER BY seq_in_index) AS columns,
               list(lower(column_name) ORDER BY seq_in_index) AS folded, min(non_unique) = 0 AS is_unique
        FROM index_rows GROUP BY ALL""",
    "duplicates": """
        SELECT instance_id, table_schema AS database, table_name AS "table", a.index_name AS duplicate_index,
               b.index_name AS overlaps_with, array_to_string(a.columns, ',') AS columns,
               format('ALTER TABLE `{}`.`{}` DROP INDEX `{}`;', table_schema, table_name, a.index_name) AS drop_statement,
               a.is_unique AS is_unique
        FROM indexes a JOIN indexes b USING (instance_id, table_schema, table_name)
        WHERE a.index_name <> b.index_name AND upper(a.index_name) <> 'PRIMARY' AND len(a.columns) <= len(b.columns)
          AND b.folded[1:len(a.columns)] = a.folded
          AND NOT (len(a.columns) = len(b.columns) AND a.is_unique AND NOT b.is_unique)
        QUALIFY row_number() OVER (PARTITION BY instance_id, table_schema, table_name, a.index_name
                                   ORDER BY len(b.columns), b.index_name) = 1""",
    "table_rows": """
        SELECT 'inst-' || (o_orderkey % 4) AS instance_id,
               CASE WHEN o_orderkey % 13 = 0 THEN 'sys' ELSE 'db' || (o_orderkey % 3) END AS table_schema,
               't' || o_orderkey AS table_name, CASE WHEN o_orderstatus = 'F' THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
               CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS table_rows,
               CASE WHEN o_orderstatus <> 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END AS data_length,
               o_custkey * 10 AS index_length, CASE WHEN o_orderstatus <> 'F' THEN 'InnoDB' END AS engine
        FROM orders""",
    "column_rows": """
        SELECT 'inst-' || (l_orderkey % 4) AS instance_id, 'db' || (l_orderkey % 3) AS table_schema,
               't' || l_orderkey AS table_name, 'c' || (part % 2) || '_' || l_linenumber AS column_name,
               l_linenumber AS position, flag = 'A' AS is_text, status = 'O' AS is_nullable, part % 3 = 0 AS has_default
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_returnflag) AS flag, min(l_linestatus) AS status
              FROM lineitem GROUP BY ALL)""",
    "global_variables": f"""
        SELECT 'inst-' || c_custkey AS instance_id, name AS variable_name,
               CASE c_custkey % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS variable_value
        FROM customer, (VALUES {_VARIABLES}) v(name, a, b, c)
        WHERE CASE c_custkey % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END IS NOT NULL""",
    "global_status": """
        SELECT 'inst-' || k AS instance_id, 'cl-' || (k % 2) AS cluster_id, '2024-01-01 00:00:00' AS timestamp,
               unnest(['Uptime', 'Questions', 'Queries', 'Threads_running', 'Threads_connected',
                       'Innodb_buffer_pool_read_requests', 'Innodb_buffer_pool_reads', 'Innodb_rows_read', 'Connections',
                       'uptime_since_flush', 'Innodb_deadlocks']) AS variable_name,
               unnest([CAST(k % 5 AS VARCHAR), CAST(k * 7 AS VARCHAR), (k * 9) || CASE WHEN k % 10 = 0 THEN 'x' ELSE '' END,
                       CAST(k % 11 AS VARCHAR), CAST(k * 3 AS VARCHAR), CAST(k * 7 AS VARCHAR), CAST(k % 11 AS VARCHAR),
                       CAST(k * 3 AS VARCHAR), CASE WHEN k % 6 = 0 THEN '99999999999999999999' ELSE CAST(k * 2 AS VARCHAR) END,
                       CAST(k AS VARCHAR), ' ' || k]) AS variable_value
        FROM (SELECT c_custkey AS k FROM customer)""",
    "stats": """
        SELECT 'inst-' || k AS instance_id, k % 5 AS uptime, k * 7 AS questions, k % 11 AS running, k * 3 AS connected,
               CASE WHEN k % 6 = 0 THEN 9223372036854775807 ELSE k * 2 END AS connections,
               CASE k % 3 WHEN 0 THEN 500 WHEN 1 THEN 6000 ELSE 2000 END AS max_connections,
               CASE k % 3 WHEN 0 THEN 134217728 WHEN 1 THEN 8589934592 ELSE 1073741824 END AS pool_size
        FROM (SELECT c_custkey AS k FROM customer)""",
    "processlist": """
        SELECT 'inst-' || (user_id % 4) AS instance_id, 'cl-' || (user_id % 2) AS cluster_id,
               strftime(ts, '%Y-%m-%d %H:00:00') AS timestamp,
               CASE WHEN event_type = 'view' THEN 'Sleep' ELSE 'Query' END AS command
        FROM events""",
    "status_metrics": """
        SELECT instance_id, cluster_id, 'global_status.' || variable_name AS metric_name,
               try_cast(variable_value AS DOUBLE) AS value, timestamp
        FROM global_status
        WHERE variable_name IN ('Queries', 'Threads_connected', 'Threads_running', 'Innodb_buffer_pool_reads',
              'Innodb_buffer_pool_read_requests', 'Innodb_rows_read', 'Connections', 'Uptime')
          AND try_cast(variable_value AS DOUBLE) IS NOT NULL""",
    "processlist_metrics": """
        SELECT instance_id, cluster_id, timestamp, unnest(['processlist.total', 'processlist.active', 'processlist.sleeping'])
               AS metric_name, unnest([total, total - sleeping, sleeping]) AS value
        FROM (SELECT instance_id, cluster_id, timestamp, CAST(count(*) AS DOUBLE) AS total,
                     CAST(count(*) FILTER (command = 'Sleep') AS DOUBLE) AS sleeping FROM processlist GROUP BY ALL)""",
    "innodb_metrics": """
        SELECT 'inst-' || (s_suppkey % 4) AS instance_id, 'cl-' || (s_suppkey % 2) AS cluster_id,
               '2024-01-01 00:00:00' AS timestamp, 'innodb_metrics.' || s_name AS metric_name,
               CAST(floor(s_acctbal) AS DOUBLE) AS value
        FROM supplier WHERE s_acctbal > 2000""",
    "engines": """
        SELECT 'inst-' || c_custkey AS instance_id, engine, support, transactions
        FROM customer, (VALUES ('InnoDB', 'DEFAULT', 'YES'), ('MyISAM', 'YES', 'NO'), ('MEMORY', 'YES', ''))
             e(engine, support, transactions)""",
    "servers": """
        SELECT 'inst-' || c_custkey AS instance_id, 'cl-' || c_nationkey AS cluster_id,
               CASE WHEN c_custkey % 3 = 0 THEN '8.0.35' ELSE '5.7.44-log' END AS version, c_custkey AS k,
               c_mktsegment <> 'BUILDING' AS replica
        FROM customer""",
    "replicas": """
        SELECT instance_id, replica AS is_replica,
               CASE WHEN NOT replica THEN '' WHEN k % 6 = 2 THEN 'Yesa' ELSE 'Yes' END AS slave_io_running,
               CASE WHEN replica THEN 'No' ELSE '' END AS slave_sql_running,
               CASE WHEN replica AND k % 5 <> 0 AND k % 7 <> 0 THEN k END AS seconds_behind_master
        FROM servers""",
    "schema_sizes": """
        SELECT instance_id, table_schema AS schema, count(*) AS tables,
               CAST(coalesce(sum(data_length + index_length), 0) AS BIGINT) AS size_bytes
        FROM table_rows WHERE table_schema NOT IN ('mysql', 'information_schema', 'performance_schema', 'sys')
        GROUP BY ALL""",
    "clusters": """
        SELECT 'cl-' || n_nationkey AS cluster_id, 'main-' || n_nationkey ||
               CASE n_nationkey % 3 WHEN 0 THEN '.db.example.net' WHEN 1 THEN '' ELSE '.' END AS endpoint FROM nation
        UNION ALL SELECT 'region-' || r_regionkey, r_name || '.db.example.net' FROM region""",
    "members_before": """
        SELECT 'cl-' || s_nationkey AS cluster_id, s_name AS server_id FROM supplier WHERE s_acctbal < 8000""",
    "members_found": """
        SELECT 'cl-' || s_nationkey AS cluster_id, s_name AS server_id,
               s_acctbal < 9500 AND s_nationkey <> 3 AS reachable
        FROM supplier WHERE s_acctbal >= 1000 AND (s_nationkey <> 3 OR s_acctbal >= 8000)""",
    "poll_log": """
        SELECT 'inst-' || (user_id % 4) AS instance_id, 'cl-' || (user_id % 2) AS cluster_id,
               strftime(ts, '%Y-%m-%d %H:00:00') AS ts, count(*) FILTER (event_type = 'error') * 3 >= count(*) AS failed
        FROM events GROUP BY ALL""",
}


def over_views(select: str, **more: str) -> str:
    """`select` with every view it names, directly or through another, in front of it."""
    views = {**VIEWS, **more}
    order: list[str] = []

    def need(text: str, within: tuple[str, ...] = ()) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)):
            if word in views and word not in order and word not in within:
                need(views[word], (*within, word))
                order.append(word)
    need(select)
    return "WITH " + ", ".join(f"{name} AS ({views[name]})" for name in order) + select if order else select
