"""What a rule is, and how it names the variables of a server.

A rule states in SQL when it fires. Placeholders stand for variables:

    {text.log_bin}      the value, '' when the server lacks the variable
    {fold.log_bin}      the same in lower case
    {int.wait_timeout}  a strict integer, NULL when missing or anything else
    {has.wait_timeout}  whether the server has the variable
    {version}           struct<major, minor, patch, raw>

NULL counts as not fired. Users extend the catalog with rules of the same form.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

AURORA_SKIP = "aurora-skip"            # not checked on Aurora
AURORA_DOWNGRADE = "aurora-downgrade"  # a warning is a note on Aurora
MYISAM_ONLY = "myisam-only"            # information only

TEXT_PREFIX, INT_PREFIX = "text_", "int_"


@dataclass
class Vars:
    """Fills placeholders with columns and remembers which variables were named."""

    texts: set[str] = field(default_factory=set)
    ints: set[str] = field(default_factory=set)

    def text(self, name: str) -> str:
        self.texts.add(name)
        return f"coalesce(`{TEXT_PREFIX}{name}`, '')"

    def fold(self, name: str) -> str:
        return f"lower({self.text(name)})"

    def has(self, name: str) -> str:
        self.texts.add(name)
        return f"(`{TEXT_PREFIX}{name}` IS NOT NULL)"

    def int(self, name: str) -> str:
        self.texts.add(name)
        self.ints.add(name)
        return f"`{INT_PREFIX}{name}`"

    def fill(self, condition: str) -> str:
        forms = {form: _Named(getattr(self, form)) for form in ("text", "fold", "has", "int")}
        return condition.format(version="version", **forms)


class _Named:
    """Lets a format string write {form.variable}."""

    def __init__(self, form):
        self._form = form

    def __getattr__(self, name: str) -> str:
        return self._form(name)


@dataclass(frozen=True)
class Case:
    """One way for a rule to fire, and what is then reported."""

    when: str
    variable: str
    description: str


@dataclass(frozen=True)
class Rule:
    """A rule reports its first case that holds, so at most one finding per server."""

    id: str
    category: str
    severity: str
    cases: tuple[Case, ...]
    tags: frozenset[str] = frozenset()

    def aurora_severity(self) -> str:
        return "note" if AURORA_DOWNGRADE in self.tags and self.severity == "warn" else self.severity


def rule(
    id: str, category: str, severity: str, when: str, description: str,
    *, variable: str | None = None, tags: Iterable[str] = (),
) -> Rule:
    """A rule with one case, named after its variable unless `variable` says otherwise."""
    return Rule(id, category, severity, (Case(when, variable or id, description),), frozenset(tags))


def renamed(
    id: str, category: str, severity: str, new: str, old: str, when: str, description: str, tags: Iterable[str] = (),
) -> Rule:
    """A rule on a variable that was renamed: the old name counts where the new one is empty.

    `when` writes {text.it} and {fold.it} for whichever of the two it is.
    """
    def on(name: str) -> str:
        return when.replace(".it}", f".{name}}}")
    return Rule(id, category, severity, (
        Case(f"{{text.{new}}} <> '' AND ({on(new)})", new, description),
        Case(f"{{text.{new}}} = '' AND ({on(old)})", old, description),
    ), frozenset(tags))
