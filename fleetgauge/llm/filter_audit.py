"""Audit of how quality filters interact: who removes what in which order, and each filter's fair share.

Documents are counted by the set of filters that they fail; from these counts the removals of all coalitions of filters are
tabulated. A filter's Shapley value is the solution of a least squares problem over the coalitions, weighted by a kernel and
constrained to share out all removals; its normal equations are solved in rationals, so the values are exact. What a step of
an order removes is the difference of two coalitions.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from functools import cache
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, forget, staged


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions that depend on a text alone: few words, few different words, many capitals, markup characters."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


@cache
def shapley_weights(n: int) -> tuple[tuple[int, ...], ...]:
    """Per filter of n, the integers that a coalition's removals are multiplied with to sum to n! times its value.

    The least squares problem: the values of a coalition's members should sum to its removals, an error weighing
    (n - 1) / (C(n, s) s (n - s)) for s members, and the values of all must sum to the removals of all. Its normal
    equations with one multiplier for the constraint are inverted by elimination in rationals.
    """
    coalitions = range(1, 2**n - 1)
    weight = {c: Fraction(n - 1, comb(n, c.bit_count()) * c.bit_count() * (n - c.bit_count())) for c in coalitions}
    member = lambda c, i: c >> i & 1
    size = n + 1
    rows = [[sum((weight[c] for c in coalitions if member(c, i) and member(c, j)), Fraction()) for j in range(n)] + [Fraction(1)]
            for i in range(n)] + [[Fraction(1)] * n + [Fraction()]]
    rows = [row + [Fraction(int(i == j)) for j in range(size)] for i, row in enumerate(rows)]
    for k in range(size):
        pivot = next(i for i in range(k, size) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(size):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    inverse = [row[size:] for row in rows]
    solved = [[Fraction()] + [sum((inverse[i][j] * weight[c] for j in range(n) if member(c, j)), Fraction()) for c in coalitions]
              + [inverse[i][n]] for i in range(n)]
    scaled = [[x * factorial(n) for x in row] for row in solved]
    assert lcm(*(x.denominator for row in scaled for x in row)) == 1
    return tuple(tuple(int(x) for x in row) for row in scaled)


def counted(documents: DataFrame, labels: DataFrame, tests: Mapping[str, Column] | None = None, repeated: str = "E",
            key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail (bit i: the i-th name), all in one pass of texts.

    `repeated` names the filter that a text fails if a smaller key has the same text anywhere in the table, removed or not.
    A group of equal texts is its checksum (SHA-256) from the first shuffle on, and combined before it; only its smallest
    key goes back to the rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    tests = conditions(whole) if tests is None else tests
    mask = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests.values())), F.lit(0))
    rows = staged(documents.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("sum")), "filter-audit")
    first = rows.groupBy(F.col("sum").alias("_sum")).agg(F.min("doc_id").alias("_first")).filter("_first IS NOT NULL")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    each = rows.groupBy("sum", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    later = F.when(F.col("_first").isNull() & F.col("doc_id").isNotNull(), 1 << len(tests)).otherwise(0)
    counts = each.join(first, (F.col("sum") == F.col("_sum")) & (F.col("doc_id") == F.col("_first")), "left").join(
        known, F.col("doc_id") == F.col("_id"), "left").groupBy("part", (F.col("mask") + later).alias("mask")).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("_good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("_toxic"), F.col("n"))), F.lit(0)).alias("toxic"))
    done = staged(counts, "filter-counts")
    forget(rows)
    return done


def coalitions(counts: DataFrame, n: int) -> DataFrame:
    """part, total, v: per part the removals of all 2^n coalitions (documents, good and toxic ones), by their bits."""
    hit = lambda c: F.sum(F.when(F.col("mask").bitwiseAND(F.col("coalition")) != 0, F.col(c)).otherwise(0)).alias(c)
    each = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(2**n - 1)))).groupBy("part", "coalition").agg(
        F.sum("n").alias("total"), hit("n"), hit("good"), hit("toxic"))
    return each.groupBy("part").agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic"))).alias("v"))


def audit(documents: DataFrame, labels: DataFrame, tests: Mapping[str, Column] | None = None, repeated: str = "E",
          key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step.

    kept, removed, redundant (fail the step's filter, removed before), unique_fails (fail that filter only), good_lost,
    toxic_lost, and shapley: the filter's removals summed over all orders, which is n! times its Shapley value.

    A null text is the empty text, a null part the empty string. A null key has no smaller key and no label; rows of the
    same key and text are no repeats of each other. A document that has several labels counts as good (toxic) if one of
    them says so. An empty table gives no rows; other columns are not read.
    """
    counts = counted(documents, labels, tests, repeated, key, text, part)
    letters = [*(conditions(F.lit("")) if tests is None else tests), repeated]
    n = len(letters)
    weights = shapley_weights(n)
    v = lambda mask, of="n": F.get("v", mask)[of]
    place = lambda k: F.array_position(F.array(*map(F.lit, letters)), F.get("order", k)).cast("int") - 1
    bit = lambda k: F.get(F.array(*(F.lit(1 << i) for i in range(n))), place(k))
    steps = coalitions(counts, n).withColumns({
        "values": F.array(*(sum((F.lit(w) * v(F.lit(c)) for c, w in enumerate(row) if w), F.lit(0).cast("long")) for row in weights)),
        "order": F.explode(F.array(*(F.array(*map(F.lit, order)) for order in permutations(letters)))),
    }).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumns({
        "_before": sum((F.when(F.col("step") > k + 1, bit(F.lit(k))).otherwise(0) for k in range(n)), F.lit(0)),
        "_own": bit(F.col("step") - 1),
    }).withColumn("_after", F.col("_before") + F.col("_own"))
    step = lambda of: v(F.col("_after"), of) - v(F.col("_before"), of)
    return steps.select(
        "part", F.array_join("order", "").alias("filter_order"), "step", (F.col("total") - v(F.col("_after"))).alias("kept"),
        step("n").alias("removed"), (v(F.col("_own")) - step("n")).alias("redundant"),
        (v(F.lit(2**n - 1)) - v(F.lit(2**n - 1) - F.col("_own"))).alias("unique_fails"),
        step("good").alias("good_lost"), step("toxic").alias("toxic_lost"),
        F.get("values", place(F.col("step") - 1)).alias("shapley"))
