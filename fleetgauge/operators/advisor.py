"""Configuration findings for every server snapshot.

One pass: variables become typed columns (small, combined shuffles), every rule is a condition
over them, and texts come from a literal array, so there is neither a join with
the catalog nor a loop over rules or servers at run time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import version_of
from ..functions.parse import strict_int_sql
from ..rules import AURORA_SKIP, CATEGORIES, RULES, Rule, Vars
from ..rules.model import INT_PREFIX, TEXT_PREFIX
from ..sources.variables import variable_columns

INSTANCE = ("instance_id",)
SEVERITIES = ("critical", "warn", "note")


def _chosen(rules: Sequence[Rule], category: str | None) -> dict[int, Rule]:
    """Rules of a category by their place in the catalog."""
    return {place: rule for place, rule in enumerate(rules) if not category or rule.category == category}


def _needed(rules: Sequence[Rule]) -> Vars:
    asked = Vars()
    for rule in rules:
        for case in rule.cases:
            asked.fill(case.when)
            asked.text(case.variable)
    asked.text("version")
    asked.text("aurora_version")
    return asked


def rule_context(
    variables: DataFrame, rules: Sequence[Rule] = RULES, keys: Sequence[str] = INSTANCE, seq: str | None = None
) -> DataFrame:
    """(*keys, is_aurora, version, text and integer columns the rules ask for).

    `variables` holds variable_name/variable_value rows, or a `vars` map per snapshot.
    """
    asked = _needed(rules)
    texts = sorted(asked.texts)
    if "vars" in variables.columns:
        wide = variables.select(*keys, *(F.element_at("vars", F.lit(n)).alias(TEXT_PREFIX + n) for n in texts))
    else:
        wide = variable_columns(variables, texts, keys, seq, prefix=TEXT_PREFIX)
    return wide.select(
        *keys,
        F.col(TEXT_PREFIX + "aurora_version").isNotNull().alias("is_aurora"),
        version_of(TEXT_PREFIX + "version").alias("version"),
        *(TEXT_PREFIX + name for name in texts),
        *(F.expr(f"{strict_int_sql(TEXT_PREFIX + name)} AS {INT_PREFIX}{name}") for name in sorted(asked.ints)),
    )


def _texts(rules: dict[int, Rule]) -> Column:
    """What can be reported, as one literal array; a finding refers to it by position."""
    entries = [
        {"ordinal": place, "rule_id": rule.id, "category": rule.category, "severity": rule.severity,
         "aurora_severity": rule.aurora_severity(), "variable": case.variable, "description": case.description}
        for place, rule in rules.items() for case in rule.cases
    ]
    kind = ("array<struct<ordinal:int,rule_id:string,category:string,severity:string,aurora_severity:string,"
            "variable:string,description:string>>")
    return F.from_json(F.lit(json.dumps(entries)), kind)


def _hits(rules: Iterable[Rule]) -> Column:
    """Per rule the position of the case that holds with the value reported, or NULL."""
    asked, position, hits = Vars(), 0, []
    for rule in rules:
        branches = []
        for case in rule.cases:
            holds = f"({asked.fill(case.when)})"
            if AURORA_SKIP in rule.tags:
                holds = f"NOT is_aurora AND {holds}"
            value = asked.text(case.variable)
            branches.append(f"WHEN {holds} THEN named_struct('position', {position}, 'current_value', {value})")
            position += 1
        hits.append(f"CASE {' '.join(branches)} END")
    return F.expr(f"array({', '.join(hits)})")


def check_variables(
    variables: DataFrame, rules: Sequence[Rule] = RULES, category: str | None = None,
    keys: Sequence[str] = INSTANCE, seq: str | None = None,
) -> DataFrame:
    """(*keys, ordinal, rule_id, category, severity, variable, current_value, description).

    `ordinal` is the place of the rule in the catalog. An unknown category has no findings.
    """
    chosen = _chosen(rules, category)
    context = rule_context(variables, list(chosen.values()), keys, seq)
    if not chosen:
        texts = ("rule_id", "category", "severity", "variable", "current_value", "description")
        return context.filter(F.lit(False)).select(
            *keys, F.lit(0).alias("ordinal"), *(F.lit("").alias(name) for name in texts))
    hits = context.select(*keys, "is_aurora", F.explode(_hits(chosen.values())).alias("_hit"))
    named = hits.filter("_hit IS NOT NULL").select(
        *keys, "is_aurora", _texts(chosen)[F.col("_hit.position")].alias("_text"),
        F.col("_hit.current_value").alias("current_value"))
    return named.select(
        *keys, "_text.ordinal", "_text.rule_id", "_text.category",
        F.expr("CASE WHEN is_aurora THEN _text.aurora_severity ELSE _text.severity END AS severity"),
        "_text.variable", "current_value", "_text.description",
    )


def rule_runs(
    variables: DataFrame, rules: Sequence[Rule] = RULES, category: str | None = None,
    keys: Sequence[str] = INSTANCE, seq: str | None = None,
) -> DataFrame:
    """(*keys, version, is_aurora, total_rules, rules_skipped): all rules are counted as total,
    skipped are those of the chosen category that Aurora does without."""
    skipped = sum(AURORA_SKIP in rule.tags for rule in _chosen(rules, category).values())
    return rule_context(variables, (), keys, seq).select(
        *keys, F.col("version.raw").alias("version"), "is_aurora", F.lit(len(rules)).alias("total_rules"),
        F.when(F.col("is_aurora"), F.lit(skipped)).otherwise(F.lit(0)).alias("rules_skipped"),
    )


def severity_rank(severity: Column) -> Column:
    """0 for critical, then warn, note and anything else."""
    known = F.array(*(F.lit(name) for name in SEVERITIES))
    return F.coalesce(F.nullif(F.array_position(known, severity), F.lit(0)) - 1, F.lit(len(SEVERITIES))).cast("int")


def by_severity(findings: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """Per server the critical findings first, in catalog order within a severity."""
    return findings.orderBy(*keys, severity_rank(F.col("severity")), "ordinal")


def findings_by_category(findings: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """(*keys, category, n_findings, findings array in catalog order); at most one entry per rule."""
    entry = F.struct("ordinal", "rule_id", "severity", "variable", "current_value", "description")
    return findings.groupBy(*keys, "category").agg(
        F.count("*").alias("n_findings"), F.sort_array(F.collect_list(entry)).alias("findings"))


__all__ = ["CATEGORIES", "by_severity", "check_variables", "findings_by_category", "rule_context", "rule_runs",
           "severity_rank"]
