"""Memory rules. Numbers are fixed values."""

from __future__ import annotations

from .model import AURORA_SKIP, MYISAM_ONLY, rule

C = "memory"

MEMORY_RULES = (
    rule("sort_buffer_size", C, "note", "{int.sort_buffer_size} <> 262144",
         "The sort buffer was changed from 256 KB; measure before leaving the default."),
    rule("sort_buffer_size_large", C, "warn", "{int.sort_buffer_size} > 2097152",
         "Sort buffers above 2 MB cost more in allocation than they save.", variable="sort_buffer_size"),
    rule("key_buffer_size", C, "warn", "{int.key_buffer_size} = 8388608",
         "The MyISAM key buffer still has its 8 MB default size.", tags=[MYISAM_ONLY, AURORA_SKIP]),
    rule("join_buffer_size", C, "warn", "{int.join_buffer_size} > 4194304",
         "More than 4 MB are taken for each join of each session."),
    rule("read_buffer_size", C, "warn", "{int.read_buffer_size} > 8388608",
         "More than 8 MB are taken per session for sequential reads; the host may start to swap."),
    rule("read_rnd_buffer_size", C, "warn", "{int.read_rnd_buffer_size} > 4194304",
         "More than 4 MB are taken per session for reads in key order."),
    rule("tmp_table_size_mismatch", C, "note", "{int.tmp_table_size} > {int.max_heap_table_size}",
         "The smaller of tmp_table_size and max_heap_table_size counts; the excess has no effect.",
         variable="tmp_table_size"),
    rule("tmp_table_size_large", C, "warn", "{int.tmp_table_size} > 268435456",
         "Temporary tables may take more than 256 MB of memory each; better to change the queries.",
         variable="tmp_table_size"),
    rule("max_heap_table_size", C, "note", "{int.max_heap_table_size} < {int.tmp_table_size}",
         "Temporary tables are held below tmp_table_size by this smaller limit."),
    rule("bulk_insert_buffer_size", C, "note", "{int.bulk_insert_buffer_size} > 67108864",
         "More than 64 MB are taken for each session that loads data."),
)
