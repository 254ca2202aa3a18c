"""Table layouts. Column order is the order of the written files."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
          "TIMESTAMP": T.TimestampType()}


def _struct(spec: str) -> T.StructType:
    """Schema of flat columns; unlike Spark's own DDL parser this needs no session."""
    pairs = (column.split() for column in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CHANGED_FILES = T.ArrayType(_struct("added BIGINT, deleted BIGINT, file_path STRING"))

COMMITS = _struct("repo_name STRING, commit_hash STRING, date_str STRING, commit_ts TIMESTAMP, subject STRING").add(
    "files", CHANGED_FILES
)

FILE_HISTORY = _struct(
    "repo_name STRING, file_id STRING, commit_count BIGINT, churn_added BIGINT, churn_deleted BIGINT, "
    "total_churn BIGINT, file_age_days BIGINT, days_since_last_change BIGINT, recent_7d_commits BIGINT, "
    "recent_30d_commits BIGINT, late_night_commits BIGINT, late_night_ratio DOUBLE, weekend_commits BIGINT, "
    "weekend_ratio DOUBLE, active_days BIGINT, avg_commits_per_active_day DOUBLE, max_commits_one_day BIGINT, "
    "burstiness_score DOUBLE, bug_fix_commits BIGINT, bug_label INT"
)

SOURCE_FILES = _struct("path STRING, content STRING")

FUNCTION_METRICS = _struct(
    "repo_name STRING, file STRING, file_id STRING, file_name STRING, relative_path STRING, extension STRING, "
    "language STRING, is_test_file INT, function_id STRING, function STRING, start_line INT, end_line INT, "
    "line_span INT, nloc INT, ccn INT, token INT, params INT, length INT, radon_grade STRING, radon_cc INT, "
    "bug_label STRING"
)

BASIC_METRICS = _struct(
    "file STRING, function STRING, start_line STRING, end_line STRING, nloc STRING, ccn STRING, token STRING, "
    "params STRING, length STRING, radon_grade STRING, radon_cc STRING, bug_label STRING"
)


# Model inputs, in training order.
STATIC_FEATURES = [
    "start_line", "end_line", "line_span", "nloc", "ccn", "token", "params", "length", "radon_cc", "is_test_file",
]
HISTORY_FEATURES = [
    "commit_count", "churn_added", "churn_deleted", "total_churn", "file_age_days", "days_since_last_change",
    "recent_7d_commits", "recent_30d_commits", "late_night_commits", "late_night_ratio", "weekend_commits",
    "weekend_ratio", "active_days", "avg_commits_per_active_day", "max_commits_one_day", "burstiness_score",
]
COMBINED_FEATURES = STATIC_FEATURES + HISTORY_FEATURES
BASIC_FEATURES = ["start_line", "end_line", "nloc", "ccn", "token", "params", "length", "radon_cc"]
ROC_FEATURES = ["nloc", "ccn", "params", "length", "radon_cc"]

# Columns of the two prediction tables.
PREDICTION_COLUMNS = [
    "model_name", "feature_set", "threshold", "predicted_bug_label", "repo_name", "file", "file_id", "function_id",
    "function", "language", "nloc", "ccn", "params", "length", "radon_cc", "commit_count", "total_churn",
    "days_since_last_change", "late_night_ratio", "burstiness_score", "bug_label", "bug_probability",
]
SHORT_PREDICTION_COLUMNS = ["file", "function", "nloc", "ccn", "params", "bug_label", "bug_probability"]
# Types of the prediction columns that are not doubles.
PREDICTION_TYPES = {c: "string" for c in ("repo_name", "file", "file_id", "function_id", "function", "language")} | {
    "predicted_bug_label": "int", "bug_label": "int",
}
