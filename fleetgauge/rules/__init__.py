"""The catalog of configuration rules, in report order."""

from __future__ import annotations

from .connections import CONNECTION_RULES
from .general import GENERAL_RULES
from .innodb import INNODB_RULES
from .memory import MEMORY_RULES
from .model import AURORA_DOWNGRADE, AURORA_SKIP, MYISAM_ONLY, Case, Rule, Vars, rule
from .perfschema import PERFSCHEMA_RULES
from .replication import REPLICATION_RULES
from .security import SECURITY_RULES

RULES: tuple[Rule, ...] = (
    *INNODB_RULES, *REPLICATION_RULES, *CONNECTION_RULES, *MEMORY_RULES,
    *SECURITY_RULES, *PERFSCHEMA_RULES, *GENERAL_RULES,
)

CATEGORIES = ("innodb", "replication", "connections", "memory", "security", "performance_schema", "general")

__all__ = ["AURORA_DOWNGRADE", "AURORA_SKIP", "CATEGORIES", "Case", "MYISAM_ONLY", "RULES", "Rule", "Vars", "rule"]
