"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemas owned by the server itself.
SYSTEM_SCHEMAS = ("mysql", "information_schema", "performance_schema", "sys")


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_user_schema(schema: Column) -> Column:
    """Case-sensitive; a NULL schema is not a user schema."""
    return ~schema.isin(*SYSTEM_SCHEMAS)


def equals_fold(left: Column, right: Column | str) -> Column:
    if isinstance(right, str):
        return F.lower(left) == F.lit(right.lower())
    return F.lower(left) == F.lower(right)


def contains_fold(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def list_items_sql(text: str) -> str:
    return rf"transform(split({text}, ','), item -> regexp_replace(item, r'^\s+|\s+\z', ''))"


def list_items(text: str) -> Column:
    """Items of a comma-separated list given as SQL text, blanks trimmed."""
    return F.expr(list_items_sql(text))


def first_non_empty(*texts: Column) -> Column:
    """The first text that is neither NULL nor ''; the last one is taken as it is."""
    return F.coalesce(*(F.nullif(text, F.lit("")) for text in texts[:-1]), texts[-1])


def prefix(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def dns_suffix(endpoint: Column) -> Column:
    """What follows the first dot; '' without a dot."""
    return F.when(F.instr(endpoint, ".") > 0, F.substr(endpoint, F.instr(endpoint, ".") + 1)).otherwise(F.lit(""))


def cluster_of_host(host: Column) -> Column:
    """The host up to its first dot; a host that starts with a dot stays whole."""
    return F.when(host.startswith("."), host).otherwise(F.substring_index(host, ".", 1))


def drop_index_ddl(schema: Column, table: Column, index: Column) -> Column:
    return F.format_string("ALTER TABLE `%s`.`%s` DROP INDEX `%s`;", schema, table, index)
