"""The SQL twin of every query."""

from __future__ import annotations

from .oracle_rules import FINDINGS, SKIPPED, WIDE
from .oracle_views import over_views

RULE_COLUMNS = "instance_id, rule_id, category, severity, variable, current_value"
DIGEST_COLUMNS = ("instance_id, cluster_id, digest, digest_text, schema_name, exec_count, sum_timer_wait, "
                  "sum_rows_examined, timestamp")
SNAPSHOT = "2000-06-01 00:00:00"
KIND = "CAST(substr(instance_id, 6) AS BIGINT) % 3"

# Statement history with gaps; high-water marks half way, none for one instance.
STATEMENTS = """SELECT instance_id, event_id, thread_id, CASE WHEN timer_wait % 10 <> 0 THEN digest END AS digest, sql_text,
    CASE WHEN timer_wait % 3 <> 0 THEN timer_wait END AS timer_wait, timer_start FROM samples"""
BOUNDS = """SELECT instance_id, min(timer_start) AS oldest_timer, max(timer_start) AS newest_timer, count(*) AS row_count
    FROM samples GROUP BY ALL"""


def _marks(events: str) -> str:
    return (f"SELECT instance_id, max(event_id) // 2 AS high_water_mark FROM {events} "
            "WHERE instance_id <> 'inst-2' GROUP BY ALL")


_STREAKS = """SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY ts) AS island
    FROM {log}"""

_RAW_DIGESTS = """SELECT 'inst-' || (l_suppkey % 4) AS instance_id, 'cl-' || (l_suppkey % 2) AS cluster_id,
    strftime(l_shipdate, '%Y-%m-01 00:00:00') AS timestamp, l_partkey AS part, count(*) AS exec_count,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) * 1000000 AS sum_timer_wait,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_rows_examined,
    count(*) FILTER (l_returnflag = 'R') AS sum_created_tmp_disk_tables,
    strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS last_seen
    FROM lineitem GROUP BY ALL"""

# Index findings take an envelope per table.
_PAYLOADS = """
    SELECT instance_id, 'pt-variable-advisor' AS tool, 1 AS n, count(f.rule_id) AS found
    FROM servers LEFT JOIN findings f USING (instance_id) GROUP BY ALL
    UNION ALL
    SELECT instance_id, 'pt-duplicate-key-checker', greatest(1, count(DISTINCT (database, "table")) FILTER (duplicate_index IS NOT NULL)),
           count(duplicate_index)
    FROM servers LEFT JOIN duplicates USING (instance_id) GROUP BY ALL
    UNION ALL SELECT instance_id, 'pt-mysql-summary', 1, 0 FROM servers
    UNION ALL SELECT instance_id, 'table-schema', count(*), 0 FROM base_tables SEMI JOIN servers USING (instance_id) GROUP BY ALL"""
# In `envelopes` those of an instance take one, as the tool sends them.
_WHOLE_PAYLOADS = _PAYLOADS.replace(
    """greatest(1, count(DISTINCT (database, "table")) FILTER (duplicate_index IS NOT NULL))""", "1")
_BASE_TABLES = """SELECT instance_id, table_schema AS schema_name, table_name, coalesce(table_rows, 0) AS table_rows,
    coalesce(data_length, 0) AS data_length, index_length, coalesce(engine, '') AS engine
    FROM table_rows WHERE table_type = 'BASE TABLE' AND table_schema <> 'sys'"""

_KEY_VARIABLES = ("'innodb_buffer_pool_size', 'max_connections', 'innodb_log_file_size', 'innodb_flush_method', "
                  "'innodb_file_per_table', 'slow_query_log', 'long_query_time'")
_HIT_RATIO = "CASE WHEN questions > 0 THEN (1 - CAST(running AS DOUBLE) / questions) * 100 ELSE 0.0::DOUBLE END"
_ENGINES = ('[{"engine":"InnoDB","support":"DEFAULT","transactions":"YES"},'
            '{"engine":"MEMORY","support":"YES","transactions":""},{"engine":"MyISAM","support":"YES","transactions":"NO"}]')
_SIZES = """SELECT instance_id, string_agg(schema || ':' || tables || ':' || size_bytes, ';' ORDER BY size_bytes DESC, schema)
    AS schema_stats FROM schema_sizes GROUP BY ALL"""


def _findings(select: str, **more: str) -> str:
    return over_views(select, wide=WIDE, findings=FINDINGS, **more)


def _digests_by(counter: str) -> str:
    return over_views(f"""
        SELECT substr(digest_text, 1, 80) AS query, exec_count, {counter} FROM query_digests WHERE {counter} > 0
        ORDER BY {counter} DESC, instance_id, schema_name, digest, timestamp LIMIT 10""")


def _top_queries(source: str, **more: str) -> str:
    return over_views(f"""
        SELECT substr(digest_text, 1, 80) AS query, exec_count, sum_timer_wait / 1e12 AS total_wait_sec,
               (sum_timer_wait / exec_count) / 1e9 AS avg_ms, sum_rows_examined
        FROM {source} ORDER BY sum_timer_wait DESC, instance_id, schema_name, digest, timestamp LIMIT 10""", **more)


_DELTA = """max(exec_count) - min(exec_count) AS new_execs,
    (max(sum_timer_wait) - min(sum_timer_wait)) / 1e12 AS added_wait_sec"""

ORACLE: dict[str, str] = {
    "read_raw": """
        SELECT 'inst-customer' AS instance_id, 'cl-0' AS cluster_id, '2024-01-01 00:00:00' AS timestamp, c_custkey,
               CAST(NULL AS BIGINT) AS s_suppkey FROM customer
        UNION ALL SELECT 'inst-supplier', 'cl-0', '2024-01-01 00:00:00', NULL, s_suppkey FROM supplier""",
    "global_variables": over_views(
        "SELECT instance_id, lower(variable_name) AS name, variable_value AS value FROM global_variables"),
    "show_to_map": over_views(
        "SELECT instance_id, lower(variable_name) AS name, variable_value AS value FROM global_status"),
    "global_status_metrics": over_views("SELECT * FROM status_metrics"),
    "digest_top100": over_views("""
        SELECT instance_id, cluster_id, timestamp, md5('q' || part) AS digest, 'SELECT ' || part AS digest_text,
               CASE WHEN part % 7 <> 0 THEN 'db' || (part % 5) ELSE '' END AS schema_name, exec_count, sum_timer_wait,
               sum_rows_examined, 0::BIGINT AS sum_rows_sent, 0::BIGINT AS sum_rows_affected,
               0::BIGINT AS sum_created_tmp_tables, sum_created_tmp_disk_tables, 0::BIGINT AS sum_no_index_used,
               first_seen, last_seen
        FROM raw_digests WHERE part % 50 <> 0
        QUALIFY row_number() OVER (PARTITION BY instance_id, cluster_id, timestamp
                                   ORDER BY sum_timer_wait DESC, schema_name, digest) <= 100""", raw_digests=_RAW_DIGESTS),
    "index_usage": over_views("""
        SELECT * FROM index_usage WHERE schema_name <> 'db0' AND index_name <> 'idx_7'"""),
    "processlist_metrics": over_views("SELECT * FROM processlist_metrics"),
    "innodb_metrics": over_views("SELECT * FROM innodb_metrics"),
    "statement_tail": over_views("""
        SELECT s.instance_id, event_id, thread_id, coalesce(digest, '') AS digest, sql_text,
               coalesce(timer_wait, 0) AS timer_wait, timer_start
        FROM statements s LEFT JOIN marks m USING (instance_id)
        WHERE event_id > coalesce(high_water_mark, 0)""", statements=STATEMENTS, marks=_marks("statements")),
    "wait_tail": over_views("""
        SELECT w.instance_id, event_id, nesting_event_id, event_name, timer_wait, '' AS operation
        FROM raw_waits w LEFT JOIN marks m USING (instance_id)
        WHERE event_id > coalesce(high_water_mark, 0)""", marks=_marks("raw_waits")),
    "high_water_marks": over_views("SELECT instance_id, max(event_id) AS high_water_mark FROM raw_waits GROUP BY ALL"),
    "buffer_bounds": over_views("SELECT * FROM bounds", bounds=BOUNDS),
    "topology": over_views("""
        SELECT c.cluster_id, coalesce(s_name, endpoint) AS server_id,
               CASE WHEN s_name IS NULL THEN endpoint
                    WHEN endpoint LIKE '%.db.example.net' THEN s_name || '.db.example.net' ELSE s_name END AS endpoint,
               s_name IS NULL OR row_number() OVER (PARTITION BY c.cluster_id ORDER BY s_suppkey) = 1 AS is_writer
        FROM clusters c LEFT JOIN supplier ON c.cluster_id = 'cl-' || s_nationkey"""),
    "host_identity": """
        SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name WHEN c_custkey % 5 = 0 THEN 'aurora-' || c_custkey
                               WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE '127.0.0.1' END AS identity
        FROM customer""",
    "index_catalog": over_views("""
        SELECT instance_id, table_schema, table_name, index_name, array_to_string(columns, ',') AS columns,
               NOT is_unique AS non_unique, 'BTREE' AS index_type FROM indexes"""),
    "table_catalog": over_views("SELECT * FROM base_tables", base_tables=_BASE_TABLES),
    "column_catalog": over_views("""
        SELECT instance_id, table_schema AS schema_name, table_name, CAST(count(*) AS INTEGER) AS n_columns,
               string_agg(concat_ws(':', position, column_name, CASE WHEN is_text THEN 'varchar(64)' ELSE 'bigint unsigned' END,
                   CASE WHEN is_nullable THEN 'true' ELSE 'false' END, CASE WHEN position = 1 THEN 'PRI' ELSE '' END,
                   CASE WHEN has_default THEN '0' ELSE 'none' END, CASE WHEN is_text THEN 'utf8mb4' ELSE '' END,
                   CASE WHEN is_text THEN 'utf8mb4_bin' ELSE '' END), ';' ORDER BY position) AS columns
        FROM column_rows GROUP BY ALL"""),
    "engines": over_views("SELECT * FROM engines"),
    "replica_status": over_views("SELECT * FROM replicas"),
    "server_info": over_views("SELECT instance_id, version FROM servers"),
    "read_lake": over_views("""
        SELECT instance_id, timestamp, digest AS name, exec_count AS value FROM query_digests
        UNION ALL
        SELECT instance_id, timestamp, schema_name || '.' || table_name || '.' || index_name, count_write FROM index_usage"""),
    "read_lake_date_range": over_views(f"""
        SELECT {DIGEST_COLUMNS} FROM query_digests WHERE timestamp >= '1998-01-01' AND timestamp < '1999-01-01'"""),
    "write_lake": over_views(f"""
        SELECT {DIGEST_COLUMNS}, CAST(substr(timestamp, 1, 4) AS INTEGER) + 1 || '-01-01' AS date FROM query_digests"""),
    "write_lake_sized": over_views("""
        SELECT instance_id, count(*) AS n_rows, true AS within_limit FROM samples GROUP BY ALL"""),
    "compact_lake": over_views("""
        SELECT instance_id, count(*) AS n_rows, CAST(sum(timer_wait) AS BIGINT) AS timer_wait, true AS compacted
        FROM samples GROUP BY ALL"""),
    "envelopes": _findings("""
        SELECT p.instance_id, s.cluster_id, tool, 'fleetgauge-1.0' AS tool_version, '2024-01-01 00:00:00' AS collected_at,
               n, found AS n_findings, true AS one_run, true AS v4
        FROM payloads p JOIN servers s USING (instance_id)""", base_tables=_BASE_TABLES, payloads=_WHOLE_PAYLOADS),
    "envelope_payloads": over_views("""
        SELECT instance_id, 'pt-duplicate-key-checker' AS tool, '{"findings":' || coalesce(CAST(to_json(list({
                   'database': database, 'table': "table", 'duplicate_index': duplicate_index, 'overlaps_with': overlaps_with,
                   'columns': string_split(columns, ','), 'drop_statement': drop_statement}
                   ORDER BY len(string_split(columns, ',')), duplicate_index) FILTER (duplicate_index IS NOT NULL)) AS VARCHAR), 'null') || '}' AS json_payload
        FROM servers LEFT JOIN duplicates USING (instance_id) GROUP BY instance_id, database, "table"
        """),
    "run_all": _findings("""
        SELECT p.instance_id, tool, n, CAST(NULL AS VARCHAR) AS error FROM payloads p JOIN servers s USING (instance_id)
        WHERE tool <> 'pt-mysql-summary'
        UNION ALL SELECT NULL, 'summaries', 0, 'the server has gone away'""", base_tables=_BASE_TABLES, payloads=_PAYLOADS),
    "topic_routing": """
        SELECT CAST(event_id AS VARCHAR) AS run_id, coalesce(tool, event_type) AS tool, coalesce(topic, '') AS topic
        FROM events LEFT JOIN (VALUES ('view', 'pt-variable-advisor', 'scout.pt-variable-advisor'),
             ('click', 'pt-duplicate-key-checker', 'scout.pt-schema-checks'),
             ('error', 'pt-mysql-summary', 'scout.pt-mysql-summary'),
             ('signup', 'table-schema', 'scout.table-schemas')) t(event, tool, topic) ON event = event_type""",
    "json_report": over_views("""
        SELECT instance_id, seconds_behind_master IS NULL AS lag_is_null, seconds_behind_master AS lag FROM replicas"""),
    "exclude_system_schemas": over_views(
        "SELECT instance_id, table_schema, table_name FROM table_rows WHERE table_schema <> 'sys'"),
    "rule_check": _findings(f"SELECT {RULE_COLUMNS}, ordinal FROM findings"),
    "category_filter": _findings(f"SELECT {RULE_COLUMNS} FROM findings WHERE category = 'replication'"),
    "aurora_skip": over_views(f"""
        SELECT instance_id, {KIND} = 0 AS is_aurora, CASE WHEN {KIND} = 0 THEN {SKIPPED['innodb']} ELSE 0 END AS rules_skipped
        FROM servers"""),
    "aurora_downgrade": _findings("""
        SELECT instance_id, rule_id, severity FROM findings
        WHERE rule_id IN ('innodb_flush_log_at_trx_commit', 'log_bin', 'gtid_mode', 'log_replica_updates')"""),
    "detect_aurora": over_views(f"SELECT instance_id, {KIND} = 0 AS is_aurora FROM servers"),
    "parse_version": over_views(f"""
        SELECT instance_id, CASE {KIND} WHEN 2 THEN 5 ELSE 8 END::BIGINT AS major,
               CASE {KIND} WHEN 2 THEN 7 ELSE 0 END::BIGINT AS minor,
               CASE {KIND} WHEN 0 THEN 35 WHEN 1 THEN 28 ELSE 44 END::BIGINT AS patch,
               CASE {KIND} WHEN 0 THEN '8.0.35' WHEN 1 THEN '8.0.28' ELSE '5.7.44-log' END AS raw,
               {KIND} = 0 AS at_least_8_0_30
        FROM servers"""),
    "parse_int_var": over_views("""
        SELECT instance_id, variable_name, CASE WHEN regexp_full_match(variable_value, '[+-]?[0-9]+')
               THEN try_cast(ltrim(variable_value, '+') AS BIGINT) END AS value FROM global_variables"""),
    "status_numbers": over_views("""
        SELECT instance_id, variable_name,
               CASE WHEN regexp_full_match(variable_value, '[0-9]+')
                    THEN coalesce(try_cast(variable_value AS BIGINT), 9223372036854775807) ELSE 0 END AS as_int,
               CASE WHEN regexp_full_match(variable_value, '[0-9]+') THEN CAST(variable_value AS DOUBLE) ELSE 0 END AS as_float
        FROM global_status"""),
    "unused_indexes": over_views("""
        SELECT schema_name, table_name, index_name, count_read, count_write FROM index_usage
        WHERE count_read = 0 AND index_name <> 'PRIMARY' ORDER BY count_write DESC"""),
    "tmp_disk_queries": _digests_by("sum_created_tmp_disk_tables"),
    "no_index_queries": _digests_by("sum_no_index_used"),
    "metric_series": over_views("""
        SELECT timestamp, value FROM metrics WHERE metric_name = 'global_status.Threads_running' ORDER BY timestamp"""),
    "metric_like": over_views("""
        SELECT metric_name, value FROM metrics WHERE metric_name LIKE 'global_status.Innodb_rows_%' ORDER BY value DESC"""),
    "write_heavy_indexes": over_views("""
        SELECT schema_name, table_name, index_name, count_write, count_read,
               CASE WHEN count_read = 0 THEN 'UNUSED'
                    ELSE CAST(round(CAST(count_write AS DOUBLE) / count_read, 2) AS VARCHAR) END AS write_read_ratio
        FROM index_usage WHERE count_write > 100000
        ORDER BY count_write DESC, instance_id, schema_name, table_name, index_name LIMIT 20"""),
    "snapshot_at": over_views(f"SELECT {DIGEST_COLUMNS} FROM query_digests WHERE timestamp = '{SNAPSHOT}'"),
    "all_metrics_latest_first": over_views(
        "SELECT metric_name, value, timestamp FROM metrics ORDER BY timestamp DESC, metric_name"),
    "correlate_waits": over_views(
        "SELECT instance_id, event_id, thread_id, event_name, timer_wait, parent_digest FROM correlated"),
    "duplicate_keys": over_views("SELECT * FROM duplicates"),
    "assemble_schemas": over_views("""
        SELECT t.*, c.columns, i.indexes
        FROM base_tables t
        LEFT JOIN (SELECT instance_id, table_schema, table_name,
                          string_agg(position || ':' || column_name, ';' ORDER BY position) AS columns
                   FROM column_rows GROUP BY ALL) c
          ON c.instance_id = t.instance_id AND c.table_schema = schema_name AND c.table_name = t.table_name
        LEFT JOIN (SELECT instance_id, table_schema, table_name,
                          string_agg(index_name || '(' || array_to_string(columns, ',') || ')', ';' ORDER BY index_name) AS indexes
                   FROM indexes GROUP BY ALL) i
          ON i.instance_id = t.instance_id AND i.table_schema = schema_name AND i.table_name = t.table_name""",
        base_tables=_BASE_TABLES),
    "latest_snapshot": over_views(f"""
        SELECT {DIGEST_COLUMNS} FROM query_digests WHERE timestamp = (SELECT max(timestamp) FROM query_digests)"""),
    "latest_per_instance": over_views("""
        SELECT * FROM metrics QUALIFY timestamp = max(timestamp) OVER (PARTITION BY instance_id)"""),
    "latest_in_lake": over_views(f"""
        SELECT {DIGEST_COLUMNS} FROM query_digests QUALIFY timestamp = max(timestamp) OVER (PARTITION BY instance_id)"""),
    "topology_diff": over_views("""
        SELECT cluster_id, server_id, server_id || ':3306' AS endpoint,
               CASE WHEN old IS NULL THEN 'added'
                    WHEN new IS NOT NULL OR NOT bool_or(new IS NOT NULL) OVER (PARTITION BY cluster_id) THEN 'kept'
                    ELSE 'removed' END AS status
        FROM (SELECT cluster_id, server_id, 1 AS old FROM members_before)
        FULL JOIN (SELECT cluster_id, server_id, 1 AS new FROM members_found f
                   WHERE reachable OR EXISTS (SELECT 1 FROM members_before b
                                              WHERE b.cluster_id = f.cluster_id AND b.server_id = f.server_id))
        USING (cluster_id, server_id)"""),
    "sample_digest_join": over_views("""
        SELECT s.instance_id, event_id, s.digest, d.digest_text, d.exec_count, d.sum_timer_wait
        FROM samples s LEFT JOIN (
            SELECT instance_id, digest, max(digest_text) AS digest_text, CAST(sum(exec_count) AS BIGINT) AS exec_count,
                   CAST(sum(sum_timer_wait) AS BIGINT) AS sum_timer_wait
            FROM (SELECT * FROM query_digests QUALIFY timestamp = max(timestamp) OVER (PARTITION BY instance_id))
            GROUP BY ALL) d ON d.instance_id = s.instance_id AND d.digest = s.digest"""),
    "rule_context_join": over_views("""
        SELECT instance_id, is_aurora, version, raw_innodb_flush_method AS text_innodb_flush_method,
               raw_gtid_mode AS text_gtid_mode, i_max_connections AS int_max_connections,
               i_bulk_insert_buffer_size AS int_bulk_insert_buffer_size FROM wide""", wide=WIDE),
    "summary_assembly": over_views(f"""
        SELECT s.instance_id, version, uptime AS uptime_seconds,
               CASE WHEN uptime > 0 THEN CAST(questions AS DOUBLE) / uptime ELSE 0 END AS qps, max_connections,
               connected - running AS current_sleeping, {_HIT_RATIO} AS hit_ratio_pct, connected AS rows_read, is_replica,
               seconds_behind_master, 'InnoDB,MEMORY,MyISAM' AS engines, schema_stats,
               CASE s.k % 3 WHEN 2 THEN 6 ELSE 7 END AS n_key_variables
        FROM servers s JOIN stats USING (instance_id) JOIN replicas USING (instance_id)
        LEFT JOIN sizes USING (instance_id)""", sizes=_SIZES),
    "aggregate_waits": over_views("SELECT * FROM wait_events"),
    "wait_summary": over_views("SELECT * FROM wait_events"),
    "schema_sizes": over_views("SELECT * FROM schema_sizes"),
    "findings_by_category": _findings("""
        SELECT instance_id, category, count(*) AS n_findings, string_agg(rule_id, ',' ORDER BY ordinal) AS rules
        FROM findings GROUP BY ALL"""),
    "rule_run": over_views(f"""
        SELECT instance_id, CASE {KIND} WHEN 0 THEN '8.0.35' WHEN 1 THEN '8.0.28' ELSE '5.7.44-log' END AS version,
               {KIND} = 0 AS is_aurora, 72 AS total_rules,
               CASE WHEN {KIND} = 0 THEN {sum(SKIPPED.values())} ELSE 0 END AS rules_skipped FROM servers"""),
    "counter_delta": over_views(f"""
        SELECT substr(digest_text, 1, 70) AS query, new_execs, added_wait_sec
        FROM (SELECT digest_text, {_DELTA} FROM query_digests WHERE timestamp >= '{SNAPSHOT}' GROUP BY digest_text)
        WHERE new_execs > 0 ORDER BY added_wait_sec DESC, digest_text LIMIT 20"""),
    "counter_delta_fleet": over_views(f"""
        SELECT instance_id, schema_name, digest, {_DELTA} FROM query_digests WHERE timestamp >= '{SNAPSHOT}'
        GROUP BY ALL HAVING new_execs > 0"""),
    "counter_delta_daily": over_views(f"""
        SELECT instance_id, schema_name, digest, {_DELTA} FROM query_digests WHERE timestamp >= '{SNAPSHOT}'
        GROUP BY ALL HAVING new_execs > 0"""),
    "counter_increase": over_views(f"""
        SELECT instance_id, schema_name, digest, timestamp,
               CASE WHEN n >= before THEN n - before WHEN before IS NOT NULL THEN n END AS exec_count_increase
        FROM (SELECT *, lag(n) OVER (PARTITION BY instance_id, schema_name, digest ORDER BY timestamp) AS before
              FROM (SELECT *, CASE WHEN timestamp >= '{SNAPSHOT}' THEN exec_count % 5 ELSE exec_count END AS n
                    FROM query_digests))"""),
    "wait_totals": over_views("""
        SELECT event_name, CAST(sum(count) AS BIGINT) AS total_count, CAST(sum(total_wait) AS BIGINT) / 1e12 AS total_wait_sec
        FROM wait_events GROUP BY event_name ORDER BY total_wait_sec DESC, event_name LIMIT 20"""),
    "wait_for_digest": over_views("""
        SELECT event_name, CAST(sum(count) AS BIGINT) AS count, CAST(sum(total_wait) AS BIGINT) / 1e12 AS wait_sec
        FROM wait_events WHERE parent_digest = md5('q1') GROUP BY event_name"""),
    "snapshot_times": over_views("SELECT DISTINCT timestamp FROM metrics ORDER BY timestamp"),
    "qps": over_views("""
        SELECT instance_id, uptime AS uptime_seconds,
               CASE WHEN uptime > 0 THEN CAST(questions AS DOUBLE) / uptime ELSE 0 END AS qps FROM stats"""),
    "connection_stats": over_views("""
        SELECT instance_id, max_connections::BIGINT AS max_connections, running AS current_active,
               connected - running AS current_sleeping, connections AS total_connections, 0::BIGINT AS aborted_connects
        FROM stats"""),
    "buffer_pool_stats": over_views(f"""
        SELECT instance_id, pool_size AS size_bytes, 0::BIGINT AS total_pages, 0::BIGINT AS free_pages,
               0::BIGINT AS dirty_pages, questions AS read_requests, running AS reads, {_HIT_RATIO} AS hit_ratio_pct
        FROM stats"""),
    "innodb_stats": over_views("""
        SELECT instance_id, connected AS rows_read, 0::BIGINT AS rows_inserted, 0::BIGINT AS rows_updated,
               0::BIGINT AS rows_deleted, 0::BIGINT AS row_lock_waits, 0::BIGINT AS row_lock_time_ms, 0::BIGINT AS deadlocks
        FROM stats"""),
    "key_variables": over_views(f"""
        SELECT instance_id, lower(variable_name) AS name, variable_value AS value FROM global_variables
        WHERE lower(variable_name) IN ({_KEY_VARIABLES})"""),
    "fleet_summary": over_views(f"""
        SELECT s.instance_id, max_connections::BIGINT AS max_connections, running AS current_active,
               connected - running AS current_sleeping, connections AS total_connections, 0::BIGINT AS aborted_connects,
               pool_size AS size_bytes, questions AS read_requests, 0::BIGINT AS deadlocks, slave_io_running,
               slave_sql_running, '{_ENGINES}' AS engines, schema_stats,
               CASE s.k % 3 WHEN 0 THEN 'fsync' WHEN 1 THEN 'o_direct' END AS flush_method
        FROM servers s JOIN stats USING (instance_id) JOIN replicas USING (instance_id)
        LEFT JOIN (SELECT instance_id, '[' || string_agg('{{"schema":"' || schema || '","tables":' || tables ||
                          ',"size_bytes":' || size_bytes || '}}', ',' ORDER BY size_bytes DESC, schema) || ']' AS schema_stats
                   FROM schema_sizes GROUP BY ALL) USING (instance_id)"""),
    "buffer_lifespan": over_views("""
        SELECT *, CASE WHEN oldest_timer <> 0 AND newest_timer > oldest_timer THEN (newest_timer - oldest_timer) // 1000
                       ELSE 0 END AS lifespan_ns FROM bounds""", bounds=BOUNDS),
    "health_streaks": over_views("""
        SELECT instance_id, ts, failed, n AS consecutive_fails, n >= 3 AS needs_reconnect
        FROM (SELECT *, CASE WHEN failed THEN count(*) FILTER (failed) OVER (PARTITION BY instance_id, island ORDER BY ts)
                             ELSE 0 END AS n FROM streaks)""",
        streaks=_STREAKS.format(key="instance_id", log="poll_log")),
    "all_failing_spans": over_views("""
        SELECT cluster_id, min(ts) AS down_since, max(ts) AS last_seen_down, count(*) AS polls,
               date_diff('second', CAST(min(ts) AS TIMESTAMP), CAST(max(ts) AS TIMESTAMP)) AS seconds,
               date_diff('second', CAST(min(ts) AS TIMESTAMP), CAST(max(ts) AS TIMESTAMP)) >= 3600 AS gives_up
        FROM streaks WHERE failed GROUP BY cluster_id, island""",
        cycles="SELECT cluster_id, ts, bool_and(failed) AS failed FROM poll_log GROUP BY ALL",
        streaks=_STREAKS.format(key="cluster_id", log="cycles")),
    "poll_outcome": over_views("""
        SELECT *, metrics_rows + digests_rows + index_usage_rows = 0 AS failed
        FROM (SELECT instance_id, timestamp,
                     (SELECT count(*) FROM metrics m WHERE m.instance_id = d.instance_id AND m.timestamp = d.timestamp) AS metrics_rows,
                     (SELECT count(*) FROM query_digests q WHERE q.instance_id = d.instance_id AND q.timestamp = d.timestamp) AS digests_rows,
                     (SELECT count(*) FROM index_usage i WHERE i.instance_id = d.instance_id AND i.timestamp = d.timestamp) AS index_usage_rows
              FROM (SELECT DISTINCT instance_id, timestamp FROM query_digests
                    UNION ALL SELECT instance_id, ts FROM poll_log) d)"""),
    "severity_sort": _findings("""
        SELECT instance_id, CASE severity WHEN 'critical' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS rank, ordinal, rule_id
        FROM findings ORDER BY instance_id, rank, ordinal"""),
    "top_queries": _top_queries("query_digests"),
    "top_queries_latest": _top_queries(
        "latest", latest="SELECT * FROM query_digests QUALIFY timestamp = max(timestamp) OVER (PARTITION BY instance_id)"),
    "most_read_indexes": over_views("""
        SELECT schema_name, table_name, index_name, count_read, count_write FROM index_usage
        ORDER BY count_read DESC, instance_id, schema_name, table_name, index_name LIMIT 20"""),
    "instance_queries": over_views("""
        SELECT instance_id, value AS queries FROM metrics WHERE metric_name = 'global_status.Queries' ORDER BY instance_id"""),
    "instance_connections": over_views("""
        SELECT instance_id, value AS threads_connected FROM metrics
        WHERE metric_name = 'global_status.Threads_connected' ORDER BY value DESC"""),
    "nlargest": over_views("""
        SELECT digest_text, exec_count, sum_timer_wait FROM query_digests
        ORDER BY sum_timer_wait DESC, instance_id, schema_name, digest, timestamp LIMIT 10"""),
    "union_metrics": over_views("""
        SELECT instance_id, cluster_id, timestamp, metric_name, value FROM status_metrics
        UNION ALL SELECT instance_id, cluster_id, timestamp, metric_name, value FROM processlist_metrics
        UNION ALL SELECT instance_id, cluster_id, timestamp, metric_name, value FROM innodb_metrics"""),
    "union_envelopes": _findings("""
        SELECT tool, CAST(sum(n) AS BIGINT) AS n, count(*) AS instances FROM payloads GROUP BY tool""",
        base_tables=_BASE_TABLES, payloads=_PAYLOADS),
    "union_instances": over_views("SELECT * FROM index_usage"),
    "case_fold": over_views("""
        SELECT instance_id, variable_name, lower(variable_value) = 'on' AS is_on,
               contains(lower(variable_value), 'autoextend') AS extends FROM global_variables"""),
    "list_membership": over_views("""
        SELECT instance_id, variable_name, trim(string_split(variable_value, ',')[1]) AS first_item,
               regexp_matches(variable_value, '(^|,) *TLSv1\\.2 *(,|$)') AS has_tls12 FROM global_variables"""),
    "first_non_empty": over_views("""
        SELECT instance_id, coalesce(nullif(raw_replica_parallel_workers, ''), raw_slave_parallel_workers) AS workers
        FROM wide""", wide=WIDE),
    "five_second_bucket": over_views("""
        SELECT event_id, thread_id, strftime(time_bucket(INTERVAL 5 SECONDS, CAST(timestamp AS TIMESTAMP)),
               '%Y-%m-%d %H:%M:%S') AS bucket FROM raw_waits"""),
    "utc_text": """
        SELECT o_orderkey, strftime(TIMESTAMP '2024-01-01' + to_seconds(o_orderkey), '%Y-%m-%d %H:%M:%S') AS text
        FROM orders""",
    "text_prefix": "SELECT doc_id, substr(text, 1, 80) AS prefix FROM documents",
    "picosecond_units": over_views("""
        SELECT instance_id, digest, timestamp, sum_timer_wait / 1e12 AS seconds, sum_timer_wait / 1e9 AS ms
        FROM query_digests"""),
    "quoted_ddl": over_views("""
        SELECT instance_id, 'ALTER TABLE `' || schema_name || '`.`' || table_name || '` DROP INDEX `' || index_name || '`;' AS ddl
        FROM index_usage"""),
    "sampling_advice": """
        SELECT instance_id, i AS interval_ns, l AS lifespan_ns,
               CASE WHEN l::DOUBLE / i < 1.5 THEN greatest(i // 2, 1000000000)
                    WHEN l::DOUBLE / i > 4 THEN least(i * 3 // 2, 60000000000) ELSE i END AS next_interval_ns
        FROM (SELECT 'inst-' || c_custkey AS instance_id, (1 + c_custkey % 60) * 1000000000 AS i, n * 1000000000 AS l
              FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey)""",
    "dns_suffix": over_views("""
        SELECT cluster_id, endpoint, CASE WHEN endpoint LIKE '%.db.example.net' THEN 'db.example.net' ELSE '' END AS suffix
        FROM clusters"""),
    "cluster_of_host": over_views(
        "SELECT cluster_id, endpoint, string_split(endpoint, '.')[1] AS host_cluster FROM clusters"),
    "json_encode": """
        SELECT CAST(event_id AS VARCHAR) AS run_id, '{"run_id":"' || event_id || '","tool":' ||
               CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || event_type || '"' END || '}' AS json FROM events""",
    "stream_waits_5s": over_views("SELECT * FROM wait_events"),
    "stream_tail": over_views("SELECT DISTINCT instance_id, thread_id, event_id FROM raw_waits"),
    "stream_to_lake": over_views("SELECT * FROM metrics"),
    "stream_findings": _findings(f"SELECT {RULE_COLUMNS} FROM findings"),
    "counter_rate_stream": over_views("""
        SELECT instance_id, schema_name, digest, timestamp, exec_count - before AS exec_count_increase
        FROM (SELECT *, lag(exec_count) OVER (PARTITION BY instance_id, schema_name, digest ORDER BY timestamp) AS before
              FROM query_digests) WHERE before IS NOT NULL"""),
    "schema_drift": over_views("""
        SELECT instance_id, schema_name, table_name, 'column' AS kind, column_name AS name, 'removed' AS change
        FROM base_tables JOIN column_rows USING (instance_id, table_name)
        WHERE table_schema = schema_name AND is_nullable
        UNION ALL
        SELECT instance_id, schema_name, table_name, 'index', index_name, 'changed'
        FROM base_tables JOIN indexes USING (instance_id, table_name)
        WHERE table_schema = schema_name AND is_unique""", base_tables=_BASE_TABLES),
}
