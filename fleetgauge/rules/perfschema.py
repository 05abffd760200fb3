"""Performance schema rules."""

from __future__ import annotations

from .model import rule

PERFSCHEMA_RULES = (
    rule("performance_schema", "performance_schema", "warn", "{fold.performance_schema} = 'off'",
         "The performance schema is off, and with it nearly all that could be measured here."),
)
