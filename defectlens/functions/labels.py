"""Bug labels from rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from defectlens.functions.paths import col


def _holds(*conditions: Column) -> Column:
    """All conditions, with unknown counted as false."""
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def _at_most(c: Column, bound: int) -> Column:
    return c.isNull() | (c <= bound)


def rule_label(
    ccn: Column | str, grade: Column | str, nloc: Column | str, params: Column | str, length: Column | str
) -> Column:
    """1, 0 or null (no rule applies). Inputs are ints; the first matching rule decides."""
    ccn, nloc, params, length = (col(c) for c in (ccn, nloc, params, length))
    grade = F.upper(F.trim(col(grade)))
    risky = (
        _holds(grade.isin("C", "D", "E", "F"))
        | _holds(ccn >= 8)
        | _holds(ccn >= 6, nloc >= 10)
        | _holds(ccn >= 5, params >= 4)
        | _holds(ccn >= 5, length >= 30)
    )
    small = lambda letter, max_ccn, max_nloc: _holds(
        grade == letter, ccn <= max_ccn, _at_most(nloc, max_nloc), _at_most(params, 2)
    )
    return F.when(risky, 1).when(small("A", 2, 8) | small("B", 3, 6), 0)


def threshold_label(ccn: Column | str, nloc: Column | str, params: Column | str, length: Column | str) -> Column:
    """1 if any metric reaches its threshold, else 0. 6, 20, 4 and 30."""
    reached = [_holds(col(c) >= bound) for c, bound in ((ccn, 6), (nloc, 20), (params, 4), (length, 30))]
    return reduce(lambda a, b: a | b, reached).cast("int")


def history_label(bug_fix_commits: Column | str) -> Column:
    return (col(bug_fix_commits) > 0).cast("int")
