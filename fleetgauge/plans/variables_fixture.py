"""Server variables of the derived telemetry: name, and its value in each of three configurations.

Fixed values. None means that the configuration lacks the variable. The first
configuration is an Aurora server, the second follows few recommendations, the
third is an old server.
"""

VARIABLE_VALUES = [
    ("version", "8.0.35", "8.0.28", "5.7.44-log"),
    ("aurora_version", "", None, None),
    ("Innodb_buffer_pool_size", "134217728", "8589934592", "1073741824"),
    ("innodb_buffer_pool_instances", "1", "1", "8"),
    ("innodb_log_file_size", "50331648", "50331648", "268435456"),
    ("innodb_data_file_path", "ibdata1:12M:autoextend", "ibdata1:12M:AutoExtend", "ibdata1:10G"),
    ("innodb_flush_method", "fsync", "o_direct", None),
    ("innodb_file_per_table", "OFF", "off", "ON"),
    ("innodb_flush_log_at_trx_commit", "2", "0", "1"),
    ("innodb_doublewrite", "OFF", "OFF", "ON"),
    ("innodb_flush_neighbors", "1", "1", "0"),
    ("innodb_io_capacity", "200", "200", "2000"),
    ("innodb_io_capacity_max", "2000", "2000", "9000"),
    ("innodb_log_buffer_size", "16777217", "16777216", "x"),
    ("innodb_force_recovery", "1", "0", " 1"),
    ("innodb_fast_shutdown", "0", "1", ""),
    ("innodb_lock_wait_timeout", "121", "120", "50"),
    ("innodb_dedicated_server", "on", "OFF", None),
    ("innodb_print_all_deadlocks", "OFF", "ON", "Off"),
    ("innodb_stats_persistent", "OFF", "ON", "0"),
    ("innodb_checksum_algorithm", "none", "innodb", "CRC32"),
    ("innodb_redo_log_capacity", "104857600", "104857600", None),
    ("expire_logs_days", "0", "0", "0"),
    ("log_bin", "ON", "OFF", "on"),
    ("binlog_format", "ROW", "MIXED", "row"),
    ("sync_binlog", "0", "0", "0"),
    ("gtid_mode", "OFF", "ON", "ON"),
    ("enforce_gtid_consistency", "OFF", "WARN", None),
    ("binlog_row_image", "FULL", "full", "minimal"),
    ("replica_parallel_workers", "0", "4", None),
    ("slave_parallel_workers", None, "1", "1"),
    ("replica_preserve_commit_order", "OFF", "", None),
    ("slave_preserve_commit_order", "ON", "off", "0"),
    ("binlog_transaction_dependency_tracking", "COMMIT_ORDER", "writeset", ""),
    ("binlog_expire_logs_seconds", "0", "0", "2592000"),
    ("log_replica_updates", "OFF", "", None),
    ("log_slave_updates", "ON", "OFF", "ON"),
    ("innodb_autoinc_lock_mode", "1", "1", "2"),
    ("replica_skip_errors", None, "1062", "OFF"),
    ("slave_skip_errors", "1032", None, "all"),
    ("binlog_cache_size", "32768", "1048576", "+32768"),
    ("max_connections", "500", "6000", "2000"),
    ("thread_cache_size", "0", "16", None),
    ("wait_timeout", "28800", "30", "86400"),
    ("interactive_timeout", "28800", "28800", None),
    ("max_connect_errors", "100", "1000000", "99999"),
    ("connect_timeout", "10", "31", "30"),
    ("max_allowed_packet", "67108863", "67108864", "-1"),
    ("sort_buffer_size", "262144", "4194304", "524288"),
    ("key_buffer_size", "8388608", "8388608", "16777216"),
    ("join_buffer_size", "262144", "4194305", "4194304"),
    ("read_buffer_size", "131072", "8388609", "8388608"),
    ("read_rnd_buffer_size", "262144", "4194305", ""),
    ("tmp_table_size", "16777216", "536870912", "33554432"),
    ("max_heap_table_size", "16777216", "16777216", "67108864"),
    ("bulk_insert_buffer_size", "8388608", "67108865", "99999999999999999999"),
    ("local_infile", "ON", "OFF", "on"),
    ("skip_name_resolve", "OFF", "ON", None),
    ("require_secure_transport", "OFF", "ON", None),
    ("sql_mode", "strict_trans_tables,NO_ENGINE_SUBSTITUTION", "", "ANSI"),
    ("authentication_policy", "*,,", " mysql_native_password,,", ""),
    ("default_authentication_plugin", None, None, "mysql_native_password"),
    ("tls_version", "TLSv1.2,TLSv1.3", "TLSv1.1, TLSv1.2", "tlsv1"),
    ("performance_schema", "ON", "OFF", "0"),
    ("delay_key_write", "ON", "ON", "ALL"),
    ("myisam_recover_options", "OFF", "OFF", "BACKUP"),
    ("table_open_cache", "400", "4000", "2000"),
    ("table_definition_cache", "2000", "1400", "1999"),
    ("open_files_limit", "65535", "5000", "1024"),
    ("log_output", "FILE", "TABLE", "table"),
    ("character_set_server", "utf8mb4", "latin1", "UTF8MB4"),
    ("default_storage_engine", "InnoDB", "MyISAM", "INNODB"),
    ("slow_query_log", "OFF", "ON", "off"),
    ("long_query_time", "10.000000", "20", "20.000000"),
    ("Port", "3306", "3307", "3308"),
]
