"""History mining: commit logs to the file history table and its summaries."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from defectlens.operators.history import (
    commit_files, commits_of, file_history, history_run_summary, parse_blocks, repo_status, repo_summary,
)
from defectlens.schemas import FILE_HISTORY
from defectlens.session import materialize
from defectlens.sources.tables import write_json, write_table


@dataclass
class MinedHistory:
    history: DataFrame
    repositories: DataFrame
    status: DataFrame
    summary: DataFrame


def mine_history(logs: DataFrame, as_of: Column | dt.datetime | str) -> MinedHistory:
    """Parses the logs once and makes the history once, into written tables that all results are made from."""
    blocks = materialize(parse_blocks(logs), "commit_blocks")
    commits = commits_of(blocks)
    history = materialize(file_history(commit_files(commits), as_of), "file_history")
    repositories, status = repo_summary(commits, history), repo_status(blocks)
    return MinedHistory(history, repositories, status, history_run_summary(repositories, status))


def write_history(mined: MinedHistory, folder: str) -> None:
    write_table(mined.history, f"{folder}/file_history", FILE_HISTORY.names)
    write_json(mined.repositories, f"{folder}/repositories")
    write_json(mined.status, f"{folder}/status")
    write_json(mined.summary, f"{folder}/summary")
