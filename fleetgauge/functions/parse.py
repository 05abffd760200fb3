"""Strict parsing of server texts.

Spark's own casts are more tolerant than a server variable may be (blanks
around digits, a trailing `d` or `f`), so each cast stands behind a pattern.
`\\z` and not `$`: the latter also matches before a final line break.

Every function takes SQL text of a string expression, mostly a column name, and
the `_sql` forms give SQL text back: dozens of variables are parsed at a time,
and one text is far cheaper to hand to Spark than a tree of Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"r'^[+-]?[0-9]+\z'"
DECIMAL = r"r'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z'"
SPECIAL = r"r'^(?i)([+-]?(inf|infinity)|nan)\z'"
VERSION = r"r'^([0-9]+)\.([0-9]+)\.([0-9]+)'"

INT64_MAX = "9223372036854775807L"
INT64_MIN = "(-9223372036854775807L - 1L)"


def strict_int_sql(text: str) -> str:
    return f"CASE WHEN {text} RLIKE {INTEGER} THEN try_cast({text} AS BIGINT) END"


def clamped_int_sql(text: str) -> str:
    edge = f"CASE WHEN startswith({text}, '-') THEN {INT64_MIN} ELSE {INT64_MAX} END"
    return f"CASE WHEN {text} RLIKE {INTEGER} THEN coalesce(try_cast({text} AS BIGINT), {edge}) ELSE 0L END"


def _float_sql(text: str) -> str:
    return f"CASE WHEN {text} RLIKE {DECIMAL} OR {text} RLIKE {SPECIAL} THEN try_cast({text} AS DOUBLE) END"


def float_or_zero_sql(text: str) -> str:
    return f"coalesce({_float_sql(text)}, 0D)"


def strict_int(text: str) -> Column:
    """Base-10 signed 64-bit integer, NULL for anything else, overflow included."""
    return F.expr(strict_int_sql(text))


def clamped_int(text: str) -> Column:
    """Integer counter: missing or malformed is 0, overflow stops at the 64-bit edge."""
    return F.expr(clamped_int_sql(text))


def float_or_null(text: str) -> Column:
    """Double, NULL when malformed or out of range (a written infinity is a value)."""
    overflow = f"{text} RLIKE {DECIMAL} AND abs(try_cast({text} AS DOUBLE)) = double('infinity')"
    return F.expr(f"CASE WHEN {overflow} THEN NULL ELSE {_float_sql(text)} END")


def float_or_zero(text: str) -> Column:
    """Double, 0 when missing or malformed; out of range gives the infinity."""
    return F.expr(float_or_zero_sql(text))


def version_of(text: str) -> Column:
    """struct<major, minor, patch, raw> of a leading d.d.d, zeros when there is none."""
    raw = f"coalesce({text}, '')"
    parts = ", ".join(
        f"'{name}', {clamped_int_sql(f'regexp_extract({raw}, {VERSION}, {group})')}"
        for group, name in ((1, "major"), (2, "minor"), (3, "patch")))
    return F.expr(f"named_struct({parts}, 'raw', {raw})")


def version_at_least_sql(version: str, major: int, minor: int, patch: int) -> str:
    """Compares a `version_of` struct part by part, the first difference decides."""
    have = f"struct({version}.major, {version}.minor, {version}.patch)"
    return f"{have} >= struct({major}L, {minor}L, {patch}L)"


def version_at_least(version: str, major: int, minor: int, patch: int) -> Column:
    return F.expr(version_at_least_sql(version, major, minor, patch))
