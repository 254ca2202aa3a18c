import datetime as dt

import pytest

from defectlens.operators import history as H
from defectlens.plans.mining import mine_history, write_history
from defectlens.schemas import FILE_HISTORY
from defectlens.sources.git_logs import read_git_logs

LOG = """__COMMIT__|h1|2024-01-06T01:00:00+00:00|fix a|b with __COMMIT__|inside
3\t1\tsrc/a.py
-\t-\tsrc/b.js
1\t1\tREADME.md

__COMMIT__|h2|2024-01-08T12:00:00+02:00|plain
4\t0\tsrc/a.py
two\tfields
2\t2\t{old => new}/x.py
9\t9\tsrc/{a.py => b.py}

__COMMIT__|h3|bad date|error
5\t5\tsrc/a.py

__COMMIT__|broken|header
7\t7\tsrc/a.py

__COMMIT__|h4|2024-01-08T13:00:00+00:00|no files
"""
AS_OF = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "one.log").write_text(LOG)
    (folder / "two.v2.log").write_text("__COMMIT__|only|header\n")
    (folder / "three.log").write_text("")
    return read_git_logs(spark, [f"file://{folder}/*.log", f"file://{folder}/absent.txt"])


def test_parse(logs):
    commits = {r["commit_hash"]: r for r in H.parse_commits(logs).collect()}
    assert set(commits) == {"h1", "h2", "h3", "h4"}
    assert commits["h1"]["subject"] == "fix a|b with __COMMIT__|inside"
    assert [tuple(f) for f in commits["h1"]["files"]] == [(3, 1, "src/a.py"), (0, 0, "src/b.js")]
    assert [tuple(f) for f in commits["h2"]["files"]] == [(4, 0, "src/a.py"), (2, 2, "{old => new}/x.py")]
    assert commits["h3"]["commit_ts"] is None and commits["h4"]["files"] == []
    assert {r["repo_name"] for r in commits.values()} == {"one"}


def test_status(logs):
    rows = {r["repo_name"]: r for r in H.repo_status(H.parse_blocks(logs)).collect()}
    assert (rows["one"]["blocks"], rows["one"]["bad_blocks"], rows["one"]["status"]) == (5, 1, "analyzed")
    assert (rows["two.v2"]["blocks"], rows["two.v2"]["bad_blocks"], rows["two.v2"]["status"]) == (1, 1, "analyzed")
    assert all((rows[r]["blocks"], rows[r]["status"]) == (0, "skipped") for r in ("three", "absent")) and len(rows) == 4


def test_file_history(logs):
    rows = {r["file_id"]: r for r in mine_history(logs, AS_OF).history.collect()}
    assert set(rows) == {f"data/repos/one/{p}" for p in ("src/a.py", "src/b.js", "{old => new}/x.py")}
    a = rows["data/repos/one/src/a.py"]
    assert (a["commit_count"], a["churn_added"], a["churn_deleted"], a["total_churn"]) == (2, 7, 1, 8)
    assert (a["file_age_days"], a["days_since_last_change"]) == (3, 1)
    assert (a["late_night_commits"], a["late_night_ratio"], a["weekend_commits"], a["weekend_ratio"]) == (1, 0.5, 1, 0.5)
    assert (a["active_days"], a["avg_commits_per_active_day"], a["max_commits_one_day"], a["burstiness_score"]) == (2, 1, 1, 1)
    assert (a["bug_fix_commits"], a["bug_label"], a["recent_7d_commits"], a["recent_30d_commits"]) == (1, 1, 2, 2)
    assert rows["data/repos/one/{old => new}/x.py"]["bug_label"] == 0


def test_ages_truncate_toward_zero(spark, logs):
    early = dt.datetime(2024, 1, 6, 22, tzinfo=dt.timezone.utc)  # 36 hours before h2
    rows = {r["file_id"]: r for r in mine_history(logs, early).history.collect()}
    x = rows["data/repos/one/{old => new}/x.py"]
    assert x["days_since_last_change"] == -1
    assert x["recent_7d_commits"] == 1


def test_burstiness_uses_the_unrounded_average(spark):
    day = lambda d, n: [("r", "f", "h", dt.datetime(2024, 1, d, 10, tzinfo=dt.timezone.utc), "s", 1, 0)] * n
    events = spark.createDataFrame(
        day(1, 1) + day(2, 4) + day(3, 2),
        "repo_name string, file_id string, commit_hash string, commit_ts timestamp, subject string, added bigint, deleted bigint",
    )
    row = H.file_history(events, AS_OF).first()
    assert row["avg_commits_per_active_day"] == round(7 / 3, 6)
    assert row["burstiness_score"] == round(4 / (7 / 3), 6)


def test_summaries(spark, logs, tmp_path):
    mined = mine_history(logs, AS_OF)
    repo = mined.repositories.first()
    assert (repo["repo_name"], repo["commits_processed"], repo["commit_file_events"], repo["files_with_history"]) == (
        "one", 4, 4, 3)
    total = mined.summary.first()
    assert (total["repositories_analyzed"], total["repositories_skipped"], total["files_with_history"]) == (2, 2, 3)
    write_history(mined, f"file://{tmp_path}/out")
    header = spark.read.csv(f"file://{tmp_path}/out/file_history", header=True)
    assert header.columns == FILE_HISTORY.names and header.count() == 3
    assert spark.read.json(f"file://{tmp_path}/out/summary").first()["files_with_history"] == 3
    assert spark.read.json(f"file://{tmp_path}/out/status").where("status = 'skipped'").count() == 2
