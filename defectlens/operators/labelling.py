"""Labelling of function tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from defectlens.functions.labels import rule_label, threshold_label
from defectlens.functions.numbers import complexity_grade, numeric, to_int_trunc
from defectlens.operators.features import require_columns


def _truncated(df: DataFrame, name: str):
    return to_int_trunc(name) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name).cast("int")


def apply_rule_label(df: DataFrame, grade: str = "from_cc", outcome: str | None = None) -> DataFrame:
    """Fill ``bug_label``: a ``0`` or ``1`` already there stays, all else becomes the rule label or blank.

    ``grade="from_cc"`` grades rows whose ``radon_grade`` is blank by complexity, ``"blank"`` leaves them ungraded.
    ``outcome`` names a column that records kept, updated or blank.
    """
    ccn, nloc, params, length = (_truncated(df, c) for c in ("ccn", "nloc", "params", "length"))
    given = F.coalesce(F.trim("radon_grade"), F.lit("")) if "radon_grade" in df.columns else F.lit("")
    if grade == "from_cc":
        given = F.when(given == "", F.coalesce(complexity_grade(ccn), F.lit(""))).otherwise(given)
    old = F.col("bug_label") if "bug_label" in df.columns else F.lit(None)
    old = old.cast("string")
    kept = F.coalesce(F.trim(old).isin("0", "1"), F.lit(False))
    fresh = rule_label(ccn, given, nloc, params, length).cast("string")
    out = {"bug_label": F.when(kept, old).otherwise(F.coalesce(fresh, F.lit("")))}
    if outcome:
        out[outcome] = F.when(kept, "kept").when(fresh.isNotNull(), "updated").otherwise("blank")
    return df.withColumns(out)


def apply_threshold_label(df: DataFrame) -> DataFrame:
    """Overwrite ``bug_label`` with 0 or 1; metrics that are not numbers reach no threshold."""
    require_columns(df, ["nloc", "ccn", "params", "length"])
    return df.withColumn("bug_label", threshold_label(*(numeric(df, c) for c in ("ccn", "nloc", "params", "length"))))


def label_counters(df: DataFrame, grade: str = "from_cc") -> DataFrame:
    """How many labels ``apply_rule_label`` updates, keeps and leaves blank."""
    outcome = F.col("_outcome")
    return apply_rule_label(df, grade, "_outcome").agg(
        F.count_if(outcome == "updated").alias("updated"),
        F.count_if(outcome == "kept").alias("kept_existing"),
        F.count_if(outcome == "blank").alias("still_blank"),
    )


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
