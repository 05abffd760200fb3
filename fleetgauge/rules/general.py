"""General rules. Numbers are fixed values."""

from __future__ import annotations

from .model import AURORA_SKIP, MYISAM_ONLY, rule

C = "general"

GENERAL_RULES = (
    rule("delay_key_write", C, "warn", "{fold.delay_key_write} = 'on'",
         "MyISAM keeps changed index blocks in memory until the table is closed.", tags=[MYISAM_ONLY, AURORA_SKIP]),
    rule("myisam_recover_options", C, "warn", "{fold.myisam_recover_options} = 'off'",
         "Damaged MyISAM tables are not noticed; BACKUP,FORCE is a usual setting.", tags=[MYISAM_ONLY, AURORA_SKIP]),
    rule("table_open_cache", C, "note", "{int.table_open_cache} < 4000",
         "Fewer than 4000 open tables are kept, so busy servers open them again and again."),
    rule("table_definition_cache", C, "note", "{int.table_definition_cache} < 2000",
         "Fewer than 2000 table definitions are kept, too few for schemas with many tables."),
    rule("open_files_limit", C, "note", "{int.open_files_limit} < 65535",
         "Fewer than 65535 files may be open; production servers run out of that."),
    rule("log_output", C, "warn", "{fold.log_output} = 'table'",
         "Logs are written to tables, which costs far more than files."),
    rule("character_set_server", C, "note", "{fold.character_set_server} NOT IN ('', 'utf8mb4')",
         "Only utf8mb4 holds all of Unicode."),
    rule("default_storage_engine", C, "note", "{fold.default_storage_engine} NOT IN ('', 'innodb')",
         "New tables get an engine other than InnoDB."),
    rule("slow_query_log", C, "note", "{fold.slow_query_log} = 'off'",
         "Slow queries are not logged."),
    # A strict integer: servers print 20.000000, which stays silent, as documented in the README.
    rule("long_query_time", C, "note", "{int.long_query_time} > 10",
         "Queries count as slow only after more than ten seconds; one or two tell more."),
)
