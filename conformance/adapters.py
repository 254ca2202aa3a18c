"""The given tables seen as the engine's tables. ``SQL`` holds the same views for the oracle.

``events`` are commits of one file each, ``orders`` are functions and scored functions, ``part`` is generated source
code and ``documents`` are file texts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from defectlens.functions.paths import extension, file_name, is_supported, is_test_file, language
from defectlens.schemas import CHANGED_FILES, FUNCTION_METRICS

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)  # after every commit
FUNCTIONS_PER_FILE = 20  # generated source files hold at most this many functions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- commits ----------------------------------------------------------------------------------------------------

def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr(
        "concat('repo', user_id % 9) AS repo_name",
        "concat('h', event_id) AS commit_hash",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS date_str",
        "CAST(ts AS TIMESTAMP) AS commit_ts",
        "concat(event_type, ' ', event_id) AS subject",
        "array(named_struct('added', CAST(floor(value) AS BIGINT), "
        "'deleted', CAST(get_json_object(props, '$.k') AS BIGINT), "
        "'file_path', concat('src/f', user_id, element_at(array('.py', '.js', '.md', '.java'), "
        "CAST(user_id % 4 + 1 AS INT))))) AS files",
    )
    supported = F.filter("files", lambda f: is_supported(f["file_path"]))
    return events.withColumn("files", supported.cast(CHANGED_FILES))


def log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log text per commit: some bad dates, damaged headers, pipes in subjects, binary files and renames."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat('repo', user_id % 9) AS repo_name",
        """concat_ws('\n',
             CASE WHEN event_id % 13 = 0 THEN concat('h', event_id, '|damaged')
                  ELSE concat('h', event_id, '|',
                              CASE WHEN event_id % 50 = 0 THEN 'bad'
                                   ELSE date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'") END, '|',
                              event_type, CASE WHEN event_id % 7 = 0 THEN ' a|b ' ELSE ' ' END, event_id) END,
             concat(CASE WHEN event_id % 11 = 0 THEN '-' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END,
                    '\t', CAST(get_json_object(props, '$.k') AS BIGINT), '\tsrc/f', user_id, '.py'),
             '1\t1\tdocs/readme.md',
             CASE WHEN event_id % 5 = 0 THEN '2\t3\t{old => new}/x.py' END,
             CASE WHEN event_id % 6 = 0 THEN 'two\tfields' END,
             '') AS value""",
    )


# --- functions --------------------------------------------------------------------------------------------------

def _orders_as_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About ten functions per file; a tenth of the files has a history. Some probabilities are null."""
    raw = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "o_orderkey",
        "concat('data/repos/repo', o_custkey % 9, '/src/f', o_custkey, "
        "element_at(array('.py', '.js', '.ts', '.java'), CAST(o_custkey % 4 + 1 AS INT))) AS file",
        "concat('fn', o_orderkey) AS function",
        "CAST(o_orderkey % 400 + 1 AS INT) AS start_line",
        "CAST(floor(o_totalprice) % 45 AS INT) AS nloc",
        "CAST(o_orderkey * 5 % 14 + 1 AS INT) AS ccn",
        "CAST((o_orderkey * 11 + o_custkey) % 6 AS INT) AS params",
        "CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE '' END AS bug_label",
        "CASE WHEN o_orderkey % 97 <> 0 THEN floor(o_totalprice) % 1000 / 1000.0D END AS bug_probability",
    ).withColumn("length", F.expr("CAST(nloc + o_orderkey % 12 AS INT)"))
    return raw.withColumns({
        "repo_name": F.expr("concat('repo', o_custkey % 9)"),
        "file_id": F.col("file"),
        "file_name": file_name("file"),
        "relative_path": F.col("file"),
        "extension": extension("file"),
        "language": language("file"),
        "is_test_file": is_test_file("file"),
        "function_id": F.expr("concat(file, '::', function, '::', start_line)"),
        "end_line": F.expr("start_line + length - 1"),
        "line_span": F.expr("CASE WHEN start_line + length - 1 <> 0 THEN length ELSE 0 END"),
        "token": F.expr("nloc * 7 + ccn"),
        "radon_grade": F.lit(""),
        "radon_cc": F.col("ccn"),
    })


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_as_functions(spark, sf_dir).select(*FUNCTION_METRICS.names)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function table with numeric labels, null for some, and probabilities of three decimals."""
    return _orders_as_functions(spark, sf_dir).select(*FUNCTION_METRICS.names, "bug_probability").withColumn(
        "bug_label", F.col("bug_label").try_cast("int")
    )


# --- source files -----------------------------------------------------------------------------------------------

def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) with one function per part: ``p_size`` conditions and ``p_partkey % 5`` parameters."""
    args = "array_join(transform(slice(array(0, 1, 2, 3), 1, CAST(p_partkey % 5 AS INT)), i -> concat('a', i)), ', ')"
    conditions = lambda one: f"array_join(transform(sequence(1, p_size), i -> {one}), '')"
    python = (
        f"concat('def f', p_partkey, '(', {args}, '):\n', '    \"\"\"doc ', p_partkey, '\"\"\"\n', "
        "'    # if and or\n', '    total = 0\n', "
        + conditions("concat('    if total > ', i, ':\n        total += ', i, '\n')")
        + ", '\n    return total\n\n')"
    )
    script = (
        f"concat('function f', p_partkey, '(', {args}, ') {{\n', '  // if and or\n', '  var total = 0;\n', "
        + conditions("concat('  if (total > ', i, ') {\n    total += ', i, ';\n  }\n')")
        + ", '\n  return total;\n}\n\n')"
    )
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"CAST(floor(p_partkey / {FUNCTIONS_PER_FILE}) AS BIGINT) AS f", f"{python} AS py", f"{script} AS js"
    )
    text = F.when(F.col("f") % 4 == 1, F.col("js")).otherwise(F.col("py"))
    grouped = parts.groupBy("f").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("text")))).alias("functions")
    )
    path = "concat('data/repos/repo', f % 3, '/gen/m', f, CASE WHEN f % 4 = 1 THEN '.js' ELSE '.py' END) AS path"
    files = grouped.selectExpr(path, "array_join(transform(functions, x -> x.text), '') AS content")
    # Spread like the files a source tree is read from; adaptive execution would merge them by their small size.
    return files.repartition(spark.sparkContext.defaultParallelism, "path")


# --- questions --------------------------------------------------------------------------------------------------

QUESTIONS = [
    "Why was something flagged?", "Show high-risk functions", "Show medium-risk functions",
    "What metrics does the model use?", "Which functions are most bug-prone?", "how to fix this", " Most COMPLEX? ",
    "explain the code",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per event, about the files of the first customers; some are about files nobody uploaded."""
    message = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(
            "concat('data/repos/repo', user_id % 9, '/src/f', user_id, "
            "element_at(array('.py', '.js', '.md', '.java'), CAST(user_id % 4 + 1 AS INT)))"
        ).alias("file"),
        message.alias("message"),
    )


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the text of the files the questions are about."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('data/repos/repo', doc_id % 9, '/src/f', doc_id, "
        "element_at(array('.py', '.js', '.md', '.java'), CAST(doc_id % 4 + 1 AS INT))) AS path",
        "text AS content",
    )


# --- the same views for the oracle ------------------------------------------------------------------------------

def r6(x: str) -> str:
    return f"CAST(printf('%.6f', {x}) AS DOUBLE)"


EXTS = "(['.py', '.js', '.md', '.java'])"
FUNCTION_EXTS = "(['.py', '.js', '.ts', '.java'])"

SQL = {
    "commit_files": f"""
      SELECT 'repo' || (user_id % 9) AS repo_name, 'h' || event_id AS commit_hash, ts AS commit_ts,
             event_type || ' ' || event_id AS subject, CAST(floor(value) AS BIGINT) AS added,
             CAST(props->>'$.k' AS BIGINT) AS deleted,
             'src/f' || user_id || {EXTS}[user_id % 4 + 1] AS file_path,
             'data/repos/repo' || (user_id % 9) || '/src/f' || user_id || {EXTS}[user_id % 4 + 1] AS file_id
      FROM events WHERE user_id % 4 <> 2""",
    "days": """
      SELECT repo_name, file_id, CAST(commit_ts AS DATE) AS day, count(*) AS commits, sum(added) AS added,
             sum(deleted) AS deleted, min(commit_ts) AS first_seen, max(commit_ts) AS last_seen,
             count(*) FILTER (WHERE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(commit_ts) <= 7 * 86400000000) AS r7,
             count(*) FILTER (WHERE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(commit_ts) <= 30 * 86400000000) AS r30,
             count(*) FILTER (WHERE hour(commit_ts) < 6) AS late,
             count(*) FILTER (WHERE isodow(commit_ts) >= 6) AS weekend,
             count(*) FILTER (WHERE subject LIKE 'error %') AS fixes
      FROM commit_files GROUP BY ALL""",
    "file_history": f"""
      SELECT repo_name, file_id, CAST(sum(commits) AS BIGINT) AS commit_count, CAST(sum(added) AS BIGINT) AS churn_added,
             CAST(sum(deleted) AS BIGINT) AS churn_deleted, CAST(sum(added) + sum(deleted) AS BIGINT) AS total_churn,
             CAST(trunc((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(min(first_seen))) / 86400000000.0) AS BIGINT)
               AS file_age_days,
             CAST(trunc((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(last_seen))) / 86400000000.0) AS BIGINT)
               AS days_since_last_change,
             CAST(sum(r7) AS BIGINT) AS recent_7d_commits, CAST(sum(r30) AS BIGINT) AS recent_30d_commits,
             CAST(sum(late) AS BIGINT) AS late_night_commits, {r6("sum(late) / sum(commits)")} AS late_night_ratio,
             CAST(sum(weekend) AS BIGINT) AS weekend_commits, {r6("sum(weekend) / sum(commits)")} AS weekend_ratio,
             count(*) AS active_days, {r6("sum(commits) / count(*)")} AS avg_commits_per_active_day,
             max(commits) AS max_commits_one_day,
             {r6("max(commits) / (sum(commits) / count(*))")} AS burstiness_score,
             CAST(sum(fixes) AS BIGINT) AS bug_fix_commits,
             CAST(CASE WHEN sum(fixes) > 0 THEN 1 ELSE 0 END AS INTEGER) AS bug_label
      FROM days GROUP BY repo_name, file_id""",
    "base_functions": f"""
      SELECT *, CAST(nloc + o_orderkey % 12 AS INTEGER) AS length,
             CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE '' END AS bug_label
      FROM (SELECT o_orderkey, o_custkey, o_orderstatus,
                   'data/repos/repo' || (o_custkey % 9) || '/src/f' || o_custkey || {FUNCTION_EXTS}[o_custkey % 4 + 1]
                     AS file,
                   'fn' || o_orderkey AS function, CAST(o_orderkey % 400 + 1 AS INTEGER) AS start_line,
                   CAST(floor(o_totalprice)::BIGINT % 45 AS INTEGER) AS nloc,
                   CAST(o_orderkey * 5 % 14 + 1 AS INTEGER) AS ccn,
                   CAST((o_orderkey * 11 + o_custkey) % 6 AS INTEGER) AS params,
                   CASE WHEN o_orderkey % 97 <> 0 THEN (floor(o_totalprice)::BIGINT % 1000) / 1000.0::DOUBLE END
                     AS bug_probability
            FROM orders)""",
    "functions": """
      SELECT 'repo' || (o_custkey % 9) AS repo_name, file, file AS file_id, regexp_extract(file, '[^/]*$') AS file_name,
             file AS relative_path, regexp_extract(file, '\\.[a-z]+$') AS extension,
             (['Python', 'JavaScript', 'TypeScript', 'Java'])[o_custkey % 4 + 1] AS language,
             CAST(0 AS INTEGER) AS is_test_file, file || '::' || function || '::' || start_line AS function_id, function,
             start_line, CAST(start_line + length - 1 AS INTEGER) AS end_line,
             CAST(CASE WHEN start_line + length - 1 <> 0 THEN length ELSE 0 END AS INTEGER) AS line_span,
             nloc, ccn, CAST(nloc * 7 + ccn AS INTEGER) AS token, params, length, '' AS radon_grade, ccn AS radon_cc,
             bug_label, bug_probability, o_orderkey, o_custkey
      FROM base_functions""",
    "scored": """
      SELECT * REPLACE (TRY_CAST(bug_label AS INTEGER) AS bug_label) FROM functions""",
    "labelled": """
      SELECT function_id, CASE WHEN bug_label IN ('0', '1') THEN bug_label
        WHEN ccn >= 8 OR ccn > 10 OR (ccn >= 6 AND nloc >= 10) OR (params >= 4 AND ccn >= 5)
             OR (length >= 30 AND ccn >= 5) THEN '1'
        WHEN ccn <= 2 AND nloc <= 8 AND params <= 2 THEN '0' ELSE '' END AS bug_label FROM functions""",
    "usable": """
      SELECT bug_label AS actual, bug_probability AS score FROM scored
      WHERE bug_label IS NOT NULL AND bug_probability IS NOT NULL""",
    "counts": """
      SELECT score, sum(actual) AS pos, sum(1 - actual) AS neg FROM usable GROUP BY score""",
    "curve": """
      SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, count(*) OVER w AS seen,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n
      FROM counts WINDOW w AS (ORDER BY score DESC)""",
    "banded": """
      SELECT *, CASE WHEN rank <= high THEN 'High' WHEN rank <= medium THEN 'Medium' ELSE 'Low' END AS risk_label
      FROM (SELECT *, greatest(high + 1, CAST(floor(functions_in_file * 0.5) AS BIGINT)) AS medium
            FROM (SELECT *, greatest(1, CAST(floor(functions_in_file * 0.2) AS BIGINT)) AS high
                  FROM (SELECT *, row_number() OVER (PARTITION BY file
                                    ORDER BY coalesce(bug_probability, -1) DESC, start_line, function) AS rank,
                               count(*) OVER (PARTITION BY file) AS functions_in_file
                        FROM scored)))""",
    "risk_points": """
      SELECT *, CASE WHEN ccn > 10 THEN 3 WHEN ccn >= 6 THEN 2 WHEN ccn >= 4 THEN 1 ELSE 0 END
              + CASE WHEN nloc >= 20 THEN 2 WHEN nloc >= 10 THEN 1 ELSE 0 END
              + CASE WHEN params >= 4 THEN 2 WHEN params >= 2 THEN 1 ELSE 0 END
              + CASE WHEN length >= 30 THEN 2 WHEN length >= 15 THEN 1 ELSE 0 END AS points
      FROM functions""",
    "ruled": """
      SELECT *, row_number() OVER (PARTITION BY file ORDER BY CASE risk_label WHEN 'High' THEN 1 WHEN 'Medium' THEN 2
                                   ELSE 3 END, start_line, function) AS rank,
             count(*) OVER (PARTITION BY file) AS functions_in_file,
             count(*) OVER (PARTITION BY file, risk_label) AS risk_total
      FROM (SELECT *, CASE WHEN points >= 6 THEN 'High' WHEN points >= 3 THEN 'Medium' ELSE 'Low' END AS risk_label
            FROM risk_points)""",
}
NEEDS = {
    "days": ["commit_files"], "file_history": ["days"], "functions": ["base_functions"], "scored": ["functions"],
    "labelled": ["functions"],
    "usable": ["scored"], "counts": ["usable"], "curve": ["counts"], "banded": ["scored"],
    "risk_points": ["functions"], "ruled": ["risk_points"],
}


def with_views(names: list[str], select: str, **more: str) -> str:
    """``select`` behind the named views and all they need; ``more`` adds views of its own."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    views = [f"{n} AS ({SQL[n]})" for n in ordered] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH {', '.join(views)} {select}" if views else select
