"""Function tables: reading, extraction, labelling, joining, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformance.adapters import (
    FUNCTIONS_PER_FILE, functions, r6, scored, source_files, table, with_views,
)
from conformance.history_queries import history
from conformance.registry import query
from defectlens.functions import labels as L
from defectlens.functions.numbers import coerce_numeric, complexity_grade, py_round
from defectlens.operators import extraction as X, features as E, labelling as D, ranking as R, split as S
from defectlens.plans import training as T
from defectlens.schemas import FUNCTION_METRICS, HISTORY_FEATURES, ROC_FEATURES
from defectlens.session import new_table_path
from defectlens.sources import code_tree, tables

COLUMNS = ", ".join(FUNCTION_METRICS.names)

# --- sources and sinks ------------------------------------------------------------------------------------------


def _written(spark, sf_dir):
    path = new_table_path(spark, "functions")
    tables.write_table(functions(spark, sf_dir), path, FUNCTION_METRICS.names)
    return path


# A blank and a missing text are the same in CSV; both come back as null from a typed read.
_TYPED = COLUMNS.replace("radon_grade", "'' AS radon_grade")


@query("a1_read_table", with_views(["functions"], f"SELECT {_TYPED} FROM functions"))
def a1(spark, sf_dir):
    return tables.read_table(spark, _written(spark, sf_dir), FUNCTION_METRICS).na.fill("", ["radon_grade", "bug_label"])


@query("a2_read_optional", with_views(["functions"], """
  SELECT function_id, CAST(0 AS DOUBLE) AS commit_count, coalesce(bug_label, '') AS label FROM functions"""))
def a2(spark, sf_dir):
    absent = tables.read_optional(spark, new_table_path(spark, "absent"), FUNCTION_METRICS)
    merged = E.merge_history(functions(spark, sf_dir), absent)
    label = F.coalesce(F.col("bug_label").cast("int").cast("string"), F.lit(""))
    return merged.select("function_id", F.col("commit_count").cast("double"), label.alias("label"))


_AS_TEXT = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in FUNCTION_METRICS.names)


@query("a3_read_raw", with_views(["functions"], f"SELECT {_AS_TEXT} FROM functions"))
def a3(spark, sf_dir):
    return tables.read_raw(spark, _written(spark, sf_dir))


@query("a3_read_raw_split", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, "
                            "md5(regexp_replace(coalesce(text, ''), '\\r', '', 'g')) AS text_md5 FROM documents")
def a3_split(spark, sf_dir):
    """Whole texts with line breaks as values; every file is cut into blocks."""
    path = new_table_path(spark, "texts")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\\r", "")
    tables.write_table(table(spark, sf_dir, "documents").select("doc_id", "lang", text.alias("text")), path, ["doc_id", "lang", "text"])
    rows = tables.read_raw(spark, path, block_bytes=0)
    return rows.select("doc_id", "lang", F.md5("text").alias("text_md5"))


# Generated code, function by function: lines and counts follow from p_size and p_partkey.
_GENERATED = f"""
  SELECT *, 'data/repos/repo' || (f % 3) || '/gen/m' || f || CASE WHEN js THEN '.js' ELSE '.py' END AS file,
         1 + coalesce(CAST(sum(CASE WHEN js THEN 3 * p_size + 7 ELSE 2 * p_size + 7 END) OVER (
           PARTITION BY f ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start_line,
         CASE WHEN js THEN 3 * p_size + 6 ELSE 2 * p_size + 6 END AS length,
         CASE WHEN js THEN 3 * p_size + 4 ELSE 2 * p_size + 3 END AS nloc,
         greatest(0, 2 * params - 1) + CASE WHEN js THEN 12 * p_size + 13 ELSE 8 * p_size + 10 END AS token
  FROM (SELECT p_partkey, p_size, p_partkey // {FUNCTIONS_PER_FILE} AS f, p_partkey % 5 AS params,
               (p_partkey // {FUNCTIONS_PER_FILE}) % 4 = 1 AS js FROM part)"""
_CODE = f"""
  SELECT p_partkey, f, js, CASE WHEN js
    THEN 'function f' || p_partkey || '(' || args || E') {{\\n  // if and or\\n  var total = 0;\\n' ||
         array_to_string(['  if (total > ' || i || E') {{\\n    total += ' || i || E';\\n  }}\\n' FOR i IN range(1, p_size + 1)], '') || E'\\n  return total;\\n}}\\n\\n'
    ELSE 'def f' || p_partkey || '(' || args || E'):\\n    \"\"\"doc ' || p_partkey || E'\"\"\"\\n    # if and or\\n' ||
         E'    total = 0\\n' ||
         array_to_string(['    if total > ' || i || E':\\n        total += ' || i || E'\\n' FOR i IN range(1, p_size + 1)], '') || E'\\n    return total\\n\\n' END AS text
  FROM (SELECT *, array_to_string(['a' || i FOR i IN range(0, p_partkey % 5)], ', ') AS args,
               p_partkey // {FUNCTIONS_PER_FILE} AS f, (p_partkey // {FUNCTIONS_PER_FILE}) % 4 = 1 AS js FROM part)"""


@query("a4_read_source_files", with_views([], """
  SELECT 'data/repos/repo' || (f % 3) || '/gen/m' || f || CASE WHEN js THEN '.js' ELSE '.py' END AS path,
         md5(content) AS content_md5, CAST(length(content) AS INTEGER) AS chars
  FROM (SELECT f, any_value(js) AS js, string_agg(text, '' ORDER BY p_partkey) AS content FROM code GROUP BY f)""",
    code=_CODE))
def a4(spark, sf_dir):
    root = new_table_path(spark, "source_tree")
    code_tree.write_source_files(source_files(spark, sf_dir), root)
    files = code_tree.read_source_files(spark, [root, f"{root}/absent"], base=root)
    return files.select("path", F.md5("content").alias("content_md5"), F.length("content").alias("chars"))


@query("a8_label_table", with_views(["labelled"], "SELECT function_id, bug_label FROM labelled"))
def a8(spark, sf_dir):
    source, target = _written(spark, sf_dir), new_table_path(spark, "labelled")
    tables.label_table(spark, source, target)
    return tables.read_raw(spark, target).select("function_id", "bug_label")


@query("a8_relabel_table", with_views(["labelled"], "SELECT function_id, bug_label FROM labelled"))
def a8_in_place(spark, sf_dir):
    path = _written(spark, sf_dir)
    tables.relabel_table(spark, path)
    return tables.read_raw(spark, path).select("function_id", "bug_label")


@query("a9_write_json", with_views(["scored"], "SELECT file, function, nloc, ccn, params, "
                                               "coalesce(bug_probability, -1) AS bug_probability FROM scored"))
def a9(spark, sf_dir):
    path = new_table_path(spark, "predictions")
    rows = T.prediction_rows_short(scored(spark, sf_dir).withColumn("bug_label", F.lit(None).cast("int")))
    tables.write_json(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    return back.drop("bug_label").withColumn("bug_probability", F.coalesce("bug_probability", F.lit(-1.0)))


# --- extraction -------------------------------------------------------------------------------------------------


@query("j0_extract_functions", with_views([], """
  SELECT file AS path, 'f' || p_partkey AS name, CAST(start_line AS INTEGER) AS start_line,
         CAST(start_line + length - 1 AS INTEGER) AS end_line, CAST(nloc AS INTEGER) AS nloc,
         CAST(p_size + 1 AS INTEGER) AS ccn, CAST(token AS INTEGER) AS token, CAST(params AS INTEGER) AS params,
         CAST(length AS INTEGER) AS length FROM generated""", generated=_GENERATED))
def j0(spark, sf_dir):
    return X.extract_functions(source_files(spark, sf_dir))


@query("c10_function_rows", with_views([], """
  SELECT 'repo' || (f % 3) AS repo_name, file, file AS file_id, regexp_extract(file, '[^/]*$') AS file_name,
         file AS relative_path, CASE WHEN js THEN '.js' ELSE '.py' END AS extension,
         CASE WHEN js THEN 'JavaScript' ELSE 'Python' END AS language, CAST(0 AS INTEGER) AS is_test_file,
         file || '::f' || p_partkey || '::' || start_line AS function_id, 'f' || p_partkey AS function,
         CAST(start_line AS INTEGER) AS start_line, CAST(start_line + length - 1 AS INTEGER) AS end_line,
         CAST(length AS INTEGER) AS line_span, CAST(nloc AS INTEGER) AS nloc, CAST(p_size + 1 AS INTEGER) AS ccn,
         CAST(token AS INTEGER) AS token, CAST(params AS INTEGER) AS params, CAST(length AS INTEGER) AS length,
         '' AS radon_grade, CAST(p_size + 1 AS INTEGER) AS radon_cc, '' AS bug_label FROM generated""",
    generated=_GENERATED))
def c10(spark, sf_dir):
    return X.function_rows(X.extract_functions(source_files(spark, sf_dir)))


_FILES = """
  SELECT path AS file, split_part(path, '/', 3) AS repo_name,
         CASE WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.js' THEN 'JavaScript' WHEN path LIKE '%.java'
              THEN 'Java' ELSE 'Unknown' END AS language, coalesce(n, 0) AS function_count
  FROM (SELECT 'data/repos/repo' || (doc_id % 9) || '/src/f' || doc_id || (['.py', '.js', '.md', '.java'])[doc_id % 4 + 1]
          AS path FROM documents)
  LEFT JOIN (SELECT file, count(*) AS n FROM functions GROUP BY file) ON file = path"""


def _analyzed(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr(
        "concat('data/repos/repo', doc_id % 9, '/src/f', doc_id, "
        "element_at(array('.py', '.js', '.md', '.java'), CAST(doc_id % 4 + 1 AS INT))) AS path"
    )
    return X.analyzed_files(files, functions(spark, sf_dir))


@query("f4_analyzed_files", with_views(["functions"], _FILES))
def f4(spark, sf_dir):
    return _analyzed(spark, sf_dir)


@query("f4_extraction_summary", with_views(["functions"], f"""
  SELECT count(*) FILTER (WHERE function_count > 0) AS files_analyzed,
         count(*) FILTER (WHERE function_count = 0) AS files_skipped,
         CAST(sum(function_count) AS BIGINT) AS total_functions FROM ({_FILES})"""))
def f4_summary(spark, sf_dir):
    return X.extraction_summary(_analyzed(spark, sf_dir))


_WARNED = "ccn > 15 OR length > 1000 OR nloc > 1000000 OR params > 100"


@query("f6_complexity_rollup", with_views([], f"""
  SELECT coalesce(file, 'all') AS file, CAST(grouping(file) AS INTEGER) AS is_total, CAST(sum(nloc) AS BIGINT) AS total_nloc,
         {r6("avg(nloc)")} AS avg_nloc, {r6("avg(ccn)")} AS avg_ccn, {r6("avg(token)")} AS avg_token,
         count(*) AS function_count, count(*) FILTER (WHERE {_WARNED}) AS warning_count,
         {r6(f"count(*) FILTER (WHERE {_WARNED}) / count(*)")} AS warning_rate,
         {r6(f"coalesce(sum(nloc) FILTER (WHERE {_WARNED}), 0) / sum(nloc)")} AS warning_nloc_rate
  FROM (SELECT *, p_size + 1 AS ccn FROM generated) GROUP BY GROUPING SETS ((file), ())""", generated=_GENERATED))
def f6(spark, sf_dir):
    rolled = X.complexity_rollup(X.function_rows(X.extract_functions(source_files(spark, sf_dir))))
    rounded = {c: py_round(c) for c in rolled.columns if c.startswith("avg") or c.endswith("rate")}
    return rolled.withColumns({
        "file": F.coalesce("file", F.lit("all")), "is_total": F.col("is_total").cast("int"), **rounded,
    })


@query("h4_complexity_listing", with_views(["functions"], """
  SELECT file, row_number() OVER (PARTITION BY file ORDER BY ccn DESC, start_line, function) AS position, function,
         start_line, ccn, CASE WHEN ccn <= 5 THEN 'A' WHEN ccn <= 10 THEN 'B' ELSE 'C' END AS grade FROM functions"""))
def h4(spark, sf_dir):
    return R.complexity_listing(functions(spark, sf_dir))


# --- labels -----------------------------------------------------------------------------------------------------

_RULE = """CASE WHEN grade IN ('C', 'D', 'E', 'F') OR ccn >= 8 OR (ccn >= 6 AND nloc >= 10) OR (params >= 4 AND ccn >= 5)
                  OR (length >= 30 AND ccn >= 5) THEN '1'
             WHEN (grade = 'A' AND ccn <= 2 AND nloc <= 8 AND params <= 2)
                  OR (grade = 'B' AND ccn <= 3 AND nloc <= 6 AND params <= 2) THEN '0' ELSE '' END"""
_GRADED = "SELECT *, CASE WHEN ccn <= 5 THEN 'A' WHEN ccn <= 10 THEN 'B' ELSE 'C' END AS grade FROM functions"


@query("d1_rule_label", with_views(["functions"], f"SELECT function_id, {_RULE} AS label FROM ({_GRADED})"))
def d1(spark, sf_dir):
    label = L.rule_label("ccn", complexity_grade("ccn"), "nloc", "params", "length").cast("string")
    return functions(spark, sf_dir).select("function_id", F.coalesce(label, F.lit("")).alias("label"))


@query("d1_rule_label_given_grade", f"""
  SELECT p_partkey, {_RULE} AS label FROM (
    SELECT p_partkey, (['A', 'B', 'C', 'D', ''])[p_partkey % 5 + 1] AS grade, p_size % 7 AS ccn,
           CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 12 END AS nloc, p_partkey % 4 AS params, 5 AS length FROM part)""")
def d1_given(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "element_at(array(' a', 'B', 'c ', 'D', ''), CAST(p_partkey % 5 + 1 AS INT)) AS grade",
        "p_size % 7 AS ccn", "IF(p_partkey % 3 = 0, 5, 12) AS nloc", "p_partkey % 4 AS params", "5 AS length",
    )
    label = L.rule_label("ccn", "grade", "nloc", "params", "length").cast("string")
    return rows.select("p_partkey", F.coalesce(label, F.lit("")).alias("label"))


@query("d2_apply_rule_label", with_views(["labelled"], "SELECT function_id, bug_label FROM labelled"))
def d2(spark, sf_dir):
    return D.apply_rule_label(functions(spark, sf_dir)).select("function_id", "bug_label")


_THRESHOLD = "CAST(ccn >= 6 OR nloc >= 20 OR params >= 4 OR length >= 30 AS INTEGER)"


@query("d3_threshold_label", with_views(["functions"], f"SELECT function_id, {_THRESHOLD} AS bug_label FROM functions"))
def d3(spark, sf_dir):
    return D.apply_threshold_label(functions(spark, sf_dir)).select("function_id", "bug_label")


@query("f5_label_counters", with_views(["functions"], f"""
  SELECT count(*) FILTER (WHERE bug_label = '' AND fresh <> '') AS updated,
         count(*) FILTER (WHERE bug_label <> '') AS kept_existing,
         count(*) FILTER (WHERE bug_label = '' AND fresh = '') AS still_blank
  FROM (SELECT *, {_RULE} AS fresh FROM ({_GRADED}))"""))
def f5(spark, sf_dir):
    return D.label_counters(functions(spark, sf_dir))


@query("f5_value_counts", with_views(["functions"], f"""
  SELECT bug_label, count(*) AS n FROM (SELECT {_THRESHOLD} AS bug_label FROM functions) GROUP BY bug_label"""))
def f5_counts(spark, sf_dir):
    return D.value_counts(D.apply_threshold_label(functions(spark, sf_dir)), "bug_label")


# --- the history join and its inputs ----------------------------------------------------------------------------

_MERGED = """
  SELECT f.*, coalesce(CAST(h.bug_label AS DOUBLE), TRY_CAST(f.bug_label AS DOUBLE)) AS label,
         coalesce(h.commit_count, 0) AS commit_count, coalesce(h.total_churn, 0) AS total_churn,
         coalesce(h.late_night_ratio, 0) AS late_night_ratio, coalesce(h.burstiness_score, 0) AS burstiness_score,
         coalesce(h.days_since_last_change, 0) AS days_since_last_change
  FROM functions f LEFT JOIN file_history h USING (file_id)"""


def merged(spark, sf_dir):
    return E.merge_history(functions(spark, sf_dir), history(spark, sf_dir))


_LABEL_TEXT = "CASE label WHEN 1 THEN '1' WHEN 0 THEN '0' ELSE 'none' END"


_MERGED_COLUMNS = with_views(["functions", "file_history"], f"""
  SELECT function_id, {_LABEL_TEXT} AS label, commit_count, total_churn, late_night_ratio, burstiness_score,
         days_since_last_change FROM ({_MERGED})""")


@query("e1_merge_history", _MERGED_COLUMNS)
def e1(spark, sf_dir):
    return _merged_columns(merged(spark, sf_dir))


@query("e1_merge_history_salted", _MERGED_COLUMNS)
def e1_salted(spark, sf_dir):
    """The plan for files too hot for one task, forced by a small bound."""
    return _merged_columns(E.merge_history(functions(spark, sf_dir), history(spark, sf_dir), max_group_rows=10))


def _merged_columns(table):
    filled = table.na.fill(0, HISTORY_FEATURES)
    label = F.coalesce(F.col("bug_label").cast("int").cast("string"), F.lit("none"))
    return filled.select("function_id", label.alias("label"), "commit_count", "total_churn", "late_night_ratio",
                         "burstiness_score", "days_since_last_change")


@query("e2_keep_first", """
  SELECT user_id, event_id, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) WHERE nth = 1""")
def e2(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return E.keep_first(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("c3_history_projection", with_views(["file_history"], "SELECT file_id, bug_label, " + ", ".join(HISTORY_FEATURES)
                                           + " FROM file_history"))
def c3(spark, sf_dir):
    return E.history_projection(history(spark, sf_dir))


@query("c4_absent_features", with_views(["functions"], "SELECT function_id, CAST(0 AS DOUBLE) AS commit_count, "
                                                       "CAST(ccn AS DOUBLE) AS ccn FROM functions"))
def c4(spark, sf_dir):
    rows = coerce_numeric(functions(spark, sf_dir).select("function_id", "ccn"), ["ccn", "commit_count"])
    return rows.select("function_id", "commit_count", "ccn")


@query("c5_labeled_rows", with_views(["functions"], """
  SELECT function_id, CAST(bug_label AS INTEGER) AS bug_label FROM functions WHERE bug_label <> ''"""))
def c5(spark, sf_dir):
    return E.labeled_rows(functions(spark, sf_dir)).select("function_id", "bug_label")


@query("c5_labeled_rows_strict", with_views(["functions"], """
  SELECT function_id, CAST(bug_label AS INTEGER) AS bug_label, CAST(nloc AS DOUBLE) AS nloc FROM functions
  WHERE bug_label <> '' AND o_orderkey % 10 <> 0"""))
def c5_strict(spark, sf_dir):
    known = F.expr("CAST(substring(function, 3) AS BIGINT) % 10 <> 0")
    holed = functions(spark, sf_dir).withColumn("nloc", F.when(known, F.col("nloc").cast("string")).otherwise("?"))
    return E.labeled_rows(holed, ROC_FEATURES).select("function_id", "bug_label", "nloc")


@query("c9_with_group", """
  SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS repo_name FROM events""")
def c9(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "IF(user_id % 10 = 0, NULL, user_id) AS repo_name")
    return E.with_group(rows)


@query("d5_resolve_label", """
  SELECT event_id, CASE WHEN user_id % 3 < 2 THEN user_id % 3 WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS label
  FROM events""")
def d5(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "IF(user_id % 3 < 2, user_id % 3, NULL) AS h", "IF(event_id % 2 = 0, 1L, NULL) AS s"
    )
    return rows.select("event_id", F.coalesce(E.resolve_label(F.col("h"), F.col("s")), F.lit(-1)).alias("label"))


@query("f7_class_counts", with_views(["functions"], """
  SELECT CAST(bug_label AS INTEGER) AS bug_label, count(*) AS n FROM functions WHERE bug_label <> '' GROUP BY ALL"""))
def f7(spark, sf_dir):
    counts = E.require_two_classes(E.labeled_rows(functions(spark, sf_dir)))
    return spark.createDataFrame(list(counts.items()), "bug_label INT, n BIGINT")


@query("f8_class_weights", with_views(["functions"], f"""
  SELECT function_id, {r6("count(*) OVER () / (2 * count(*) OVER (PARTITION BY bug_label))")} AS weight
  FROM functions WHERE bug_label <> ''"""))
def f8(spark, sf_dir):
    labeled = E.labeled_rows(functions(spark, sf_dir))
    rows = T.weighted(labeled, E.require_two_classes(labeled))
    return rows.select("function_id", py_round("weight").alias("weight"))


# --- splits -----------------------------------------------------------------------------------------------------

_SPLIT_GROUPS = """
  SELECT file_id, CASE WHEN r <= t THEN 'test' WHEN r <= h THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT file_id, row_number() OVER (ORDER BY md5('42|' || file_id)) AS r,
               ceil(0.50 * ceil(0.30 * count(*) OVER ())) AS t, ceil(0.30 * count(*) OVER ()) AS h
        FROM (SELECT DISTINCT file_id FROM functions))"""


@query("j1_group_split", with_views(["functions"], f"""
  SELECT function_id, split FROM functions JOIN ({_SPLIT_GROUPS}) USING (file_id)"""))
def j1(spark, sf_dir):
    return S.group_split(functions(spark, sf_dir), "file_id").select("function_id", "split")


@query("j2_stratified_split", with_views(["functions"], """
  SELECT function_id, CASE WHEN r <= base + CASE WHEN share_nth <= odd THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END AS split
  FROM (SELECT function_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || function_id)) AS r FROM labelled)
  JOIN (SELECT label, base, row_number() OVER (ORDER BY rest DESC, label) AS share_nth, total - sum(base) OVER () AS odd
        FROM (SELECT label, total, total * n // rows AS base, total * n % rows AS rest
              FROM (SELECT label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS rows,
                           CAST(ceil(0.3 * sum(count(*)) OVER ()) AS BIGINT) AS total
                    FROM labelled GROUP BY label))) USING (label)""",
    labelled="SELECT function_id, CAST(bug_label AS INTEGER) AS label FROM functions WHERE bug_label <> ''"))
def j2(spark, sf_dir):
    labeled = E.labeled_rows(functions(spark, sf_dir))
    return S.stratified_split(labeled).select("function_id", "split")


@query("c7_prediction_rows", with_views(["scored"], """
  SELECT 'random_forest' AS model_name, 'static_only' AS feature_set, CAST(0.5 AS DOUBLE) AS threshold,
         CAST(bug_probability >= 0.5 AS INTEGER) AS predicted_bug_label, repo_name, file, file_id, function_id, function,
         language, nloc, ccn, params, length, radon_cc, bug_label, bug_probability, 'none' AS absent
  FROM scored"""))
def c7(spark, sf_dir):
    rows = scored(spark, sf_dir)
    rows = rows.withColumn("predicted_bug_label", (F.col("bug_probability") >= 0.5).cast("int"))
    out = T.prediction_rows(rows, "random_forest", "static_only", 0.5)
    absent = ["commit_count", "total_churn", "days_since_last_change", "late_night_ratio", "burstiness_score"]
    none = F.when(F.coalesce(*[F.col(c).cast("string") for c in absent]).isNull(), "none")
    return out.withColumn("absent", none).drop(*absent)


@query("c8_prediction_rows_short", with_views(["scored"], """
  SELECT file, function, nloc, ccn, params, CASE bug_label WHEN 1 THEN '1' WHEN 0 THEN '0' ELSE '' END AS bug_label,
         coalesce(bug_probability, -1) AS bug_probability FROM scored"""))
def c8(spark, sf_dir):
    out = T.prediction_rows_short(scored(spark, sf_dir))
    return out.withColumns({
        "bug_label": F.coalesce(F.col("bug_label").cast("string"), F.lit("")),
        "bug_probability": F.coalesce("bug_probability", F.lit(-1.0)),
    })
