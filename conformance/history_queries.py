"""Commit logs and file history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from conformance.adapters import AS_OF, commits, log_blocks, table, with_views
from conformance.registry import query
from defectlens.functions.labels import history_label
from defectlens.operators import history as H
from defectlens.schemas import FILE_HISTORY
from defectlens.session import new_table_path
from defectlens.sources import git_logs, tables

# What the rendered log text means, event by event.
PARSED = """
  SELECT 'repo' || (user_id % 9) AS repo_name, 'h' || event_id AS commit_hash,
         event_type || CASE WHEN event_id % 7 = 0 THEN ' a|b ' ELSE ' ' END || event_id AS subject,
         CASE WHEN event_id % 50 = 0 THEN -1 ELSE epoch_us(date_trunc('second', ts)) END AS micros,
         CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS files,
         CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END
           + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS added,
         CAST(props->>'$.k' AS BIGINT) + CASE WHEN event_id % 5 = 0 THEN 3 ELSE 0 END AS deleted
  FROM events WHERE event_id % 13 <> 0"""


def _facts(parsed, *more):
    total = lambda part: F.aggregate("files", F.lit(0).cast("bigint"), lambda n, f: n + f[part])
    return parsed.select(
        *more, "commit_hash", "subject", F.coalesce(F.unix_micros("commit_ts"), F.lit(-1)).alias("micros"),
        F.size("files").alias("files"), total("added").alias("added"), total("deleted").alias("deleted"),
    )


def _named_logs(spark, folder):
    """Moves the one file of each repository's folder to a name of its own, as exported logs have it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    logs = []
    for status in system.globStatus(hadoop(f"{folder}/repo_name=*/part-*")):
        repo = status.getPath().getParent().getName().partition("=")[2]
        logs.append(f"{folder}-named/{repo}.log")
        system.mkdirs(hadoop(f"{folder}-named"))
        system.rename(status.getPath(), hadoop(logs[-1]))
    return logs


@query("a5_read_git_logs", PARSED)
def a5(spark, sf_dir):
    """One log per repository; its file is named after it."""
    path = new_table_path(spark, "commit_logs")
    blocks = log_blocks(spark, sf_dir).select("repo_name", "value").repartition("repo_name")
    blocks.write.partitionBy("repo_name").text(path, lineSep="\n" + git_logs.MARKER)
    return _facts(H.parse_commits(git_logs.read_git_logs(spark, _named_logs(spark, path))), "repo_name")


@query("a6_repo_status", """
  SELECT 'repo' || (user_id % 9) AS repo_name, count(*) AS blocks, count(*) FILTER (WHERE event_id % 13 = 0) AS bad_blocks,
         'analyzed' AS status
  FROM events GROUP BY ALL UNION ALL SELECT DISTINCT 'empty' || (user_id % 9), 0, 0, 'skipped' FROM events""")
def a6(spark, sf_dir):
    """Each repository has a sister whose log is empty."""
    blocks = log_blocks(spark, sf_dir)
    empty = blocks.select(F.regexp_replace("repo_name", "^repo", "empty").alias("repo_name"), F.lit(None).cast("string").alias("value")).distinct()
    return H.repo_status(H.parse_blocks(blocks.select("repo_name", "value").unionByName(empty)))


@query("c1_parse_commits", PARSED)
def c1(spark, sf_dir):
    return _facts(H.parse_commits(log_blocks(spark, sf_dir)), "repo_name")


@query("c2_commit_files", with_views(["commit_files"], """
  SELECT repo_name, commit_hash, epoch_us(commit_ts) AS micros, subject, added, deleted, file_path, file_id
  FROM commit_files"""))
def c2(spark, sf_dir):
    return H.commit_files(commits(spark, sf_dir)).select(
        "repo_name", "commit_hash", F.unix_micros("commit_ts").alias("micros"), "subject", "added", "deleted",
        "file_path", "file_id",
    )


HISTORY_SQL = with_views(["file_history"], "SELECT * FROM file_history")


def history(spark, sf_dir):
    return H.file_history(H.commit_files(commits(spark, sf_dir)), AS_OF)


@query("f1_file_history", HISTORY_SQL)
def f1(spark, sf_dir):
    return history(spark, sf_dir)


@query("a7_write_table", HISTORY_SQL)
def a7(spark, sf_dir):
    path = new_table_path(spark, "file_history")
    tables.write_table(history(spark, sf_dir), path, FILE_HISTORY.names)
    return tables.read_table(spark, path, FILE_HISTORY)


@query("d4_history_label", "SELECT event_id, CAST(user_id % 3 > 0 AS INTEGER) AS bug_label FROM events")
def d4(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 3 AS fixes")
    return rows.select("event_id", history_label("fixes").alias("bug_label"))


REPOS = """
  SELECT 'repo' || (user_id % 9) AS repo_name, count(*) AS commits_processed,
         count(*) FILTER (WHERE user_id % 4 <> 2) AS commit_file_events,
         count(DISTINCT user_id) FILTER (WHERE user_id % 4 <> 2) AS files_with_history
  FROM events GROUP BY ALL"""


def repositories(spark, sf_dir):
    return H.repo_summary(commits(spark, sf_dir), history(spark, sf_dir))


@query("f2_repo_summary", REPOS)
def f2(spark, sf_dir):
    return repositories(spark, sf_dir)


@query("f3_history_run_summary", f"""
  SELECT count(*) AS repositories_analyzed, CAST(sum(files_with_history) AS BIGINT) AS files_with_history,
         CAST(sum(commits_processed) AS BIGINT) AS commits_processed,
         CAST(sum(commit_file_events) AS BIGINT) AS commit_file_events, CAST(0 AS BIGINT) AS repositories_skipped
  FROM ({REPOS})""")
def f3(spark, sf_dir):
    return H.history_run_summary(repositories(spark, sf_dir), H.repo_status(H.parse_blocks(log_blocks(spark, sf_dir))))


@query("i1_union_repositories", with_views(["commit_files"], """
  SELECT repo_name, commit_hash, added FROM commit_files"""))
def i1(spark, sf_dir):
    events = H.commit_files(commits(spark, sf_dir)).select("repo_name", "commit_hash", "added")
    return reduce(DataFrame.unionByName, [events.where(F.col("repo_name") == f"repo{i}") for i in range(9)])


@query("i2_distinct_repositories", "SELECT DISTINCT 'repo' || (user_id % 9) AS repo_name FROM events ORDER BY 1")
def i2(spark, sf_dir):
    return commits(spark, sf_dir).select("repo_name").distinct().orderBy("repo_name")
