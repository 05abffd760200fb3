"""InnoDB rules. Numbers are fixed values: server defaults and published limits."""

from __future__ import annotations

from ..functions.parse import version_at_least_sql
from .model import AURORA_DOWNGRADE, AURORA_SKIP, Case, Rule, rule

C = "innodb"

INNODB_RULES = (
    rule("innodb_buffer_pool_size", C, "warn", "{int.innodb_buffer_pool_size} = 134217728",
         "The buffer pool still has its 128 MB default size."),
    rule("innodb_log_file_size", C, "warn", "{int.innodb_log_file_size} = 50331648",
         "Redo log files still have the 48 MB default size, too small for production.", tags=[AURORA_SKIP]),
    rule("innodb_data_file_path", C, "note",
         "contains({fold.innodb_data_file_path}, 'autoextend')",
         "Data files that extend themselves take disk space that is hard to get back.", tags=[AURORA_SKIP]),
    rule("innodb_flush_method", C, "note", "{fold.innodb_flush_method} <> 'o_direct'",
         "With a flush method other than O_DIRECT pages are buffered twice, by server and system.",
         tags=[AURORA_SKIP]),
    rule("innodb_file_per_table", C, "warn", "{fold.innodb_file_per_table} = 'off'",
         "Tables share one tablespace; file-per-table makes space and recovery manageable.", tags=[AURORA_SKIP]),
    Rule("innodb_flush_log_at_trx_commit", C, "warn", (
        Case("{text.innodb_flush_log_at_trx_commit} = '0'", "innodb_flush_log_at_trx_commit",
             "The log is not flushed at commit, a crash can lose transactions; 0 risks more than 2 and gains nothing."),
        Case("{fold.innodb_flush_log_at_trx_commit} NOT IN ('', '1')", "innodb_flush_log_at_trx_commit",
             "The log is not flushed at every commit, a crash can lose transactions."),
    ), frozenset([AURORA_DOWNGRADE])),
    rule("innodb_doublewrite", C, "warn", "{fold.innodb_doublewrite} = 'off'",
         "Without the doublewrite buffer a page that was written in part cannot be repaired.", tags=[AURORA_SKIP]),
    rule("innodb_flush_neighbors", C, "note", "{fold.innodb_flush_neighbors} NOT IN ('', '0')",
         "Flushing neighbouring pages only pays on rotating disks; solid-state storage wants 0.", tags=[AURORA_SKIP]),
    rule("innodb_io_capacity", C, "note", "{int.innodb_io_capacity} = 200",
         "I/O capacity is at its cautious default of 200; set it to what the storage can do.", tags=[AURORA_SKIP]),
    rule("innodb_io_capacity_max", C, "note", "{int.innodb_io_capacity_max} = 2000",
         "Peak I/O capacity is at its default of 2000; set it to what the storage can do in a burst.",
         tags=[AURORA_SKIP]),
    rule("innodb_log_buffer_size", C, "warn", "{int.innodb_log_buffer_size} > 16777216",
         "A log buffer of more than 16 MB is seldom of use."),
    rule("innodb_force_recovery", C, "warn", "{int.innodb_force_recovery} > 0",
         "The server runs in forced recovery, which is meant for rescuing damaged data only."),
    rule("innodb_fast_shutdown", C, "warn", "{fold.innodb_fast_shutdown} NOT IN ('', '1')",
         "A shutdown mode other than 1 is slow, or leaves crash recovery to the next start."),
    rule("innodb_lock_wait_timeout", C, "warn", "{int.innodb_lock_wait_timeout} > 120",
         "Waiting more than two minutes for a lock lets blocked sessions pile up."),
    rule("innodb_dedicated_server", C, "note", "{fold.innodb_dedicated_server} = 'on'",
         "The server sizes buffer pool, logs and flush method by itself from the memory it finds."),
    rule("innodb_print_all_deadlocks", C, "note", "{fold.innodb_print_all_deadlocks} = 'off'",
         "Deadlocks are not written to the error log, so their number goes unseen."),
    rule("innodb_stats_persistent", C, "warn", "{fold.innodb_stats_persistent} = 'off'",
         "Statistics are lost at restart, and query plans may change with them."),
    rule("innodb_checksum_algorithm", C, "note", "{fold.innodb_checksum_algorithm} NOT IN ('', 'crc32')",
         "A page checksum other than crc32 is slower and no safer.", tags=[AURORA_SKIP]),
    rule("innodb_redo_log_capacity", C, "warn",
         f"{version_at_least_sql('{version}', 8, 0, 30)} AND {{int.innodb_redo_log_capacity}} = 104857600",
         "Redo capacity, which took over from the log file size in 8.0.30, is at its 100 MB default.",
         tags=[AURORA_SKIP]),
    rule("innodb_buffer_pool_instances", C, "note",
         "{int.innodb_buffer_pool_size} > 1073741824 AND {text.innodb_buffer_pool_instances} = '1'",
         "A buffer pool above 1 GB is not divided; use about one instance per GB, 64 at most."),
)
