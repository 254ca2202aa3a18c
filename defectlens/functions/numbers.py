"""Parsing and rounding of numbers. Parsing never raises: bad text becomes null or the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from defectlens.functions.paths import col

# Spark also accepts type suffixes such as "1d"; plain number text does not have them.
NUMBER_TEXT = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"


def numstat_int(c: Column | str) -> Column:
    """A line count of a commit; blank, ``-`` (binary file) and bad text count as 0."""
    return F.coalesce(F.trim(col(c)).try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_int(c: Column | str, default: int | Column = 0) -> Column:
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(col(c).try_cast("int"), fallback)


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a plain number is null."""
    text = col(c)
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def to_int_trunc(c: Column | str) -> Column:
    """Text to int through double, truncating; blank, bad, nan and infinite text is null."""
    return to_number(c).try_cast("int")


def not_nan(c: Column | str) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def numeric(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as double with NaN and bad text as null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return to_number(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return not_nan(F.col(name).cast("double"))
    return F.col(name).cast("double")


def coerce_numeric(df: DataFrame, columns: list[str], fill: float | None = 0.0) -> DataFrame:
    """Make ``columns`` doubles; missing columns are added. ``fill=None`` keeps nulls."""
    out = {}
    for name in columns:
        value = numeric(df, name) if name in df.columns else F.lit(fill).cast("double")
        out[name] = value if fill is None else F.coalesce(value, F.lit(float(fill)))
    return df.withColumns(out)


def clean_value(df: DataFrame, name: str, fallback: object = None) -> Column:
    """Null and NaN become ``fallback``."""
    kind = df.schema[name].dataType
    value = not_nan(name) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(name)
    return value if fallback is None else F.coalesce(value, F.lit(fallback))


def line_span(start: Column | str, end: Column | str) -> Column:
    s, e = col(start), col(end)
    return F.when((s != 0) & (e != 0), e - s + 1).otherwise(F.lit(0))


def py_round(c: Column | str, digits: int = 6) -> Column:
    """Round half to even on the exact binary value, which neither ``round`` nor ``bround`` does."""
    return F.replace(F.format_number(col(c), digits), F.lit(","), F.lit("")).cast("double")


def probability_text(c: Column | str) -> Column:
    return F.coalesce(F.format_number(col(c), 3), F.lit("—"))


def complexity_grade(cc: Column | str) -> Column:
    """Published complexity bands: A to 5, B to 10, C to 20, D to 30, E to 40, then F."""
    c = col(cc)
    grade = F.when(c <= 5, "A")
    for bound, letter in ((10, "B"), (20, "C"), (30, "D"), (40, "E")):
        grade = grade.when(c <= bound, letter)
    return grade.when(c > 40, "F")
