"""Training and scoring inputs: the history join, label precedence, labelled rows and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from defectlens.functions.numbers import numeric
from defectlens.operators.skew import MAX_GROUP_ROWS, join_lookup
from defectlens.schemas import HISTORY_FEATURES


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def class_counts(df: DataFrame, label: str = "bug_label") -> dict[int, int]:
    """Rows per class of a 0/1 label."""
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(3).collect()
    counts = {int(r[0]): r["n"] for r in rows}
    if not set(counts) <= {0, 1}:
        raise ValueError(f"{label} must hold 0 and 1 only")
    return counts


def require_two_classes(df: DataFrame, label: str = "bug_label") -> dict[int, int]:
    counts = class_counts(df, label)
    if not counts:
        raise ValueError(f"no labelled rows in {label}")
    if len(counts) < 2:
        raise ValueError(f"{label} needs both 0 and 1")
    return counts


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key. The rank filter is applied before the shuffle too, so a hot key sends one row per task."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", first).where(F.col("_nth") == 1).drop("_nth")


def history_projection(history: DataFrame) -> DataFrame:
    require_columns(history, ["file_id"])
    present = [c for c in ["bug_label", *HISTORY_FEATURES] if c in history.columns]
    return history.select("file_id", *present)


def resolve_label(history: Column, static: Column) -> Column:
    return F.coalesce(history, static)


def merge_history(
    functions: DataFrame,
    history: DataFrame | None,
    order: list[Column | str] | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """All functions with their file's history features; the history label goes before the function's own.

    ``order`` decides which history row of a repeated file_id counts; by default all its columns do.
    """
    require_columns(functions, ["function_id", "file_id"])
    label = numeric(functions, "bug_label") if "bug_label" in functions.columns else F.lit(None).cast("double")
    merged = functions
    if history is not None:
        kept = history_projection(history)
        kept = keep_first(kept, ["file_id"], order or [c for c in kept.columns if c != "file_id"])
        if "bug_label" in kept.columns:
            kept = kept.withColumnRenamed("bug_label", "bug_label_history")
        # Features of that name on the function side would be ambiguous; history replaces them.
        merged = join_lookup(
            functions.drop(*[c for c in kept.columns if c != "file_id"]), kept, "file_id", max_group_rows
        )
        if "bug_label_history" in merged.columns:
            label = resolve_label(numeric(merged, "bug_label_history"), label)
    absent = {c: F.lit(0) for c in HISTORY_FEATURES if c not in merged.columns}
    return merged.withColumns({"bug_label": label, **absent}).drop("bug_label_history")


def labeled_rows(df: DataFrame, require: list[str] | None = None) -> DataFrame:
    """Rows with a numeric label, as int. ``require`` also drops rows with a null among those columns."""
    require_columns(df, ["bug_label", *(require or [])])
    numbers = {c: numeric(df, c) for c in ["bug_label", *(require or [])]}
    return df.withColumns(numbers).dropna(subset=list(numbers)).withColumn("bug_label", F.col("bug_label").cast("int"))


def with_group(df: DataFrame, group: str = "repo_name") -> DataFrame:
    given = F.col(group).cast(T.StringType()) if group in df.columns else F.lit(None).cast("string")
    return df.withColumn(group, F.coalesce(given, F.lit("unknown")))
