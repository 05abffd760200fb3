"""Replication and binary log rules. Numbers are fixed values."""

from __future__ import annotations

from .model import AURORA_DOWNGRADE, AURORA_SKIP, renamed, rule

C = "replication"
WORKERS = "coalesce({int.replica_parallel_workers}, {int.slave_parallel_workers})"

REPLICATION_RULES = (
    rule("expire_logs_days", C, "warn", "{text.expire_logs_days} = '0' AND {fold.log_bin} = 'on'",
         "Binary logs are written and never purged."),
    rule("log_bin", C, "warn", "{fold.log_bin} = 'off'",
         "There is no binary log, hence no replica and no recovery to a point in time.", tags=[AURORA_DOWNGRADE]),
    rule("binlog_format", C, "warn", "{fold.binlog_format} NOT IN ('', 'row')",
         "Only row-based logging replays reliably on a replica."),
    rule("sync_binlog", C, "warn", "{text.sync_binlog} NOT IN ('', '1') AND {fold.log_bin} = 'on'",
         "The binary log is not flushed with every transaction, a crash can lose some.", tags=[AURORA_SKIP]),
    rule("gtid_mode", C, "warn", "{fold.gtid_mode} NOT IN ('', 'on')",
         "Replication without global transaction ids is hard to operate.", tags=[AURORA_DOWNGRADE]),
    rule("enforce_gtid_consistency", C, "warn",
         "{fold.enforce_gtid_consistency} <> 'on' AND {fold.gtid_mode} = 'on'",
         "Global transaction ids are on, but statements that break them are let through."),
    rule("binlog_row_image", C, "note",
         "{fold.binlog_row_image} NOT IN ('', 'minimal') AND {fold.binlog_format} = 'row'",
         "Full row images cost replication bandwidth; MINIMAL logs what changed."),
    renamed("replica_parallel_workers", C, "note", "replica_parallel_workers", "slave_parallel_workers",
            "{text.it} IN ('0', '1')",
            "Changes are applied by one worker; four to eight keep the lag down."),
    renamed("replica_preserve_commit_order", C, "warn", "replica_preserve_commit_order", "slave_preserve_commit_order",
            f"{WORKERS} > 1 AND {{fold.it}} IN ('off', '0')",
            "Parallel workers commit in any order, so a replica can show states its source never had."),
    rule("binlog_transaction_dependency_tracking", C, "note",
         "{fold.binlog_transaction_dependency_tracking} NOT IN ('', 'writeset')",
         "Tracking by WRITESET lets replicas apply more in parallel."),
    rule("binlog_expire_logs_seconds", C, "warn",
         "{text.binlog_expire_logs_seconds} = '0' AND {fold.log_bin} = 'on'",
         "Binary logs are written and never purged; from 8.0 on this variable sets their age."),
    renamed("log_replica_updates", C, "warn", "log_replica_updates", "log_slave_updates",
            "{fold.it} = 'off'",
            "A replica that does not log what it applies cannot be a source or a group member.",
            tags=[AURORA_DOWNGRADE]),
    rule("innodb_autoinc_lock_mode", C, "note",
         "{text.innodb_autoinc_lock_mode} NOT IN ('', '2') AND {fold.binlog_format} = 'row'",
         "With row-based logging the interleaved mode 2 is safe and scales best."),
    renamed("replica_skip_errors", C, "critical", "replica_skip_errors", "slave_skip_errors",
            "{fold.it} NOT IN ('', '0', 'off')",
            "Replication errors are skipped, so replicas drift from their source unnoticed."),
    rule("binlog_cache_size", C, "note", "{int.binlog_cache_size} = 32768",
         "The binary log cache is at its 32 KB default; row-based logging wants 512 KB or more."),
)
