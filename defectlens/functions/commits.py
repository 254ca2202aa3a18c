"""Commit dates and subjects. Dates are taken in UTC whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from defectlens.functions.paths import col

DAY_MICROS = 86_400_000_000

# Words that mark a commit as a bug fix.
BUGFIX_WORDS = [
    "fix", "fixed", "fixes", "bug", "bugs", "bugfix", "defect", "defects", "error", "errors", "issue", "issues",
    "resolve", "resolved", "resolves", "patch", "patched", "hotfix", "repair", "repaired", "correct", "corrected",
]


def commit_ts(c: Column | str) -> Column:
    """ISO-8601 date text to an instant; bad text is null."""
    text = F.trim(col(c))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def age_days(ts: Column | str, as_of: Column) -> Column:
    """Fractional days from ``ts`` to ``as_of``; negative for later commits."""
    return (F.unix_micros(as_of) - F.unix_micros(col(ts))) / F.lit(float(DAY_MICROS))


def is_recent(ts: Column | str, as_of: Column, days: int) -> Column:
    return age_days(ts, as_of) <= days


def utc_day(ts: Column | str) -> Column:
    """Days since 1970-01-01 in UTC."""
    return F.floor(F.unix_seconds(col(ts)) / F.lit(86_400))


def late_night(ts: Column | str) -> Column:
    second = F.unix_seconds(col(ts))
    return F.pmod(second, F.lit(86_400)) < 6 * 3_600


def weekend(ts: Column | str) -> Column:
    # 1970-01-01 was a Thursday, day 3 of a week that starts on Monday.
    return F.pmod(utc_day(ts) + 3, F.lit(7)) >= 5


def is_bugfix(subject: Column | str) -> Column:
    """True if the subject holds one of the words, in any case, as a whole word."""
    return F.coalesce(col(subject).rlike(rf"(?iuU)\b({'|'.join(BUGFIX_WORDS)})\b"), F.lit(False))
