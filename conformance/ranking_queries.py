"""Ranking, explaining and answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformance.adapters import QUESTIONS, file_texts, functions, questions, scored, with_views
from conformance.registry import query
from defectlens.functions import risk as K
from defectlens.functions.questions import route_question
from defectlens.operators import answers as A, ranking as R
from defectlens.plans.scoring import score_rows
from defectlens.schemas import STATIC_FEATURES

SHORT = f"""CASE WHEN ccn > 10 OR ccn >= 6 OR nloc >= 10 OR params >= 4 OR length >= 30 THEN concat_ws('; ',
    CASE WHEN ccn > 10 THEN 'High complexity' WHEN ccn >= 6 THEN 'Moderate branching' END,
    CASE WHEN nloc >= 20 THEN 'Long function body' WHEN nloc >= 10 THEN 'Moderate length' END,
    CASE WHEN params >= 4 THEN 'Many parameters' END, CASE WHEN length >= 30 THEN 'Large overall size' END)
  ELSE '{K.SHORT_DEFAULT}' END"""
PHRASES = f"""CASE WHEN ccn >= 6 OR nloc >= 10 OR params >= 4 THEN concat_ws('; ',
    CASE WHEN ccn > 10 THEN 'the function has a lot of decision-making steps'
         WHEN ccn >= 6 THEN 'the function has more branching than a simple function' END,
    CASE WHEN nloc >= 20 THEN 'the function is fairly long' WHEN nloc >= 10 THEN 'the function is a moderate size' END,
    CASE WHEN params >= 4 THEN 'the function takes several inputs' END) ELSE '{K.PLAIN_DEFAULT}' END"""
LOOKS = f"""CASE risk_label WHEN 'High' THEN '{K.LOOKS["High"]}' WHEN 'Medium' THEN '{K.LOOKS["Medium"]}'
  ELSE '{K.LOOKS_DEFAULT}' END"""
PLAIN_RULE = f"'In simpler terms, ' || {PHRASES} || '. ' || {LOOKS}"
PLAIN_SCORED = f"""'In simpler terms, ' || {PHRASES} || '. ' || CASE WHEN bug_probability IS NULL THEN {LOOKS} ELSE
  'It is currently ranked in the ' || CASE risk_label WHEN 'High' THEN 'high-risk' WHEN 'Medium' THEN 'medium-risk'
  ELSE 'lower-risk' END || ' group for this file, with probability ' || printf('%.3f', bug_probability) || '.' END"""
FIX = f"""'Suggested fix: ' || CASE WHEN len(tips) = 0 THEN '{K.TIP_DEFAULT}' ELSE array_to_string(tips[1:2], ' ') END"""
TIPS = f"""[t FOR t IN [
    CASE WHEN ccn > 10 THEN '{K.TIP_BRANCHES}' WHEN ccn >= 6 THEN '{K.TIP_CONDITIONS}' END,
    CASE WHEN nloc >= 20 OR length >= 30 THEN '{K.TIP_SECTIONS}' WHEN nloc >= 10 OR length >= 15 THEN '{K.TIP_SETUP}' END,
    CASE WHEN params >= 4 THEN '{K.TIP_GROUP_INPUTS}' WHEN params >= 2 THEN '{K.TIP_COMBINE_INPUTS}' END]
  IF t IS NOT NULL]"""
EXPLAINED = f"SELECT *, {SHORT} AS explanation, {PLAIN_RULE} AS simple_explanation, {FIX} AS fix_suggestion " \
            f"FROM (SELECT *, {TIPS} AS tips FROM ruled)"


def banded(spark, sf_dir):
    return R.risk_bands(scored(spark, sf_dir))


def ruled(spark, sf_dir):
    return score_rows(functions(spark, sf_dir))


def metrics():
    return [F.col(c) for c in ("ccn", "nloc", "params", "length")]


@query("k1_rule_risk", with_views(["ruled"], "SELECT function_id, CAST(points AS INTEGER) AS score, risk_label FROM ruled"))
def k1(spark, sf_dir):
    return functions(spark, sf_dir).select(
        "function_id", K.risk_score(*metrics()).alias("score"), K.rule_risk(*metrics()).alias("risk_label")
    )


@query("k2_risk_class", with_views(["ruled"], """
  SELECT function_id, 'risk-' || lower(risk_label) AS risk_class FROM ruled"""))
def k2(spark, sf_dir):
    return functions(spark, sf_dir).select("function_id", K.risk_class(K.rule_risk(*metrics())).alias("risk_class"))


@query("k3_short_explanation", with_views(["functions"], f"SELECT function_id, {SHORT} AS explanation FROM functions"))
def k3(spark, sf_dir):
    return functions(spark, sf_dir).select("function_id", K.short_explanation(*metrics()).alias("explanation"))


@query("k4_simple_explanation", with_views(["banded"], f"SELECT function_id, {PLAIN_SCORED} AS text FROM banded"))
def k4(spark, sf_dir):
    text = K.simple_explanation("risk_label", "bug_probability", "ccn", "nloc", "params")
    return banded(spark, sf_dir).select("function_id", text.alias("text"))


@query("k5_fix_suggestion", with_views(["functions"], f"""
  SELECT function_id, {FIX} AS fix FROM (SELECT *, {TIPS} AS tips FROM functions)"""))
def k5(spark, sf_dir):
    return functions(spark, sf_dir).select("function_id", K.fix_suggestion(*metrics()).alias("fix"))


_BAND_COLUMNS = """function_id, rank, risk_label, functions_in_file,
  count(*) OVER (PARTITION BY file, risk_label) AS risk_total"""


@query("g1_risk_bands", with_views(["banded"], f"SELECT {_BAND_COLUMNS} FROM banded"))
def g1(spark, sf_dir):
    return banded(spark, sf_dir).select("function_id", "rank", "risk_label", "functions_in_file", "risk_total")


@query("g1_risk_bands_sliced", with_views(["functions"], """
  SELECT function_id, rank, functions_in_file, CASE WHEN rank <= floor(functions_in_file * 0.2) THEN 'High'
         WHEN rank <= floor(functions_in_file * 0.5) THEN 'Medium' ELSE 'Low' END AS risk_label
  FROM (SELECT function_id, count(*) OVER (PARTITION BY repo_name) AS functions_in_file,
               row_number() OVER (PARTITION BY repo_name ORDER BY coalesce(bug_probability, -1) DESC, start_line, function)
                 AS rank FROM functions)"""))
def g1_sliced(spark, sf_dir):
    """Whole repositories as files, with a bound they exceed: the plan for files too big for one task."""
    rows = scored(spark, sf_dir).withColumn("file", F.col("repo_name"))
    return R.risk_bands(rows, max_group_rows=500).select("function_id", "rank", "functions_in_file", "risk_label")


@query("g2_rule_rank", with_views(["ruled"], """
  SELECT function_id, rank, risk_label, functions_in_file, risk_total, '#' || rank || ' · ' || risk_label AS display_score
  FROM ruled"""))
def g2(spark, sf_dir):
    return ruled(spark, sf_dir).select(
        "function_id", "rank", "risk_label", "functions_in_file", "risk_total", "display_score"
    )


@query("g3_display_score", with_views(["banded"], """
  SELECT function_id, '#' || rank || ' · ' || CASE WHEN bug_probability IS NULL THEN '—'
         ELSE printf('%.3f', bug_probability) END || ' · ' || risk_label AS display_score FROM banded"""))
def g3(spark, sf_dir):
    shown = K.display_score("rank", "risk_label", "bug_probability")
    return banded(spark, sf_dir).select("function_id", shown.alias("display_score"))


@query("g4_final_order", with_views(["banded"], """
  SELECT function_id, row_number() OVER (PARTITION BY file ORDER BY coalesce(bug_probability,
    CASE risk_label WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) DESC, start_line, function) AS position
  FROM banded"""))
def g4(spark, sf_dir):
    return R.final_order(banded(spark, sf_dir)).select("function_id", "position")


@query("h1_top_function", with_views(["ruled"], f"SELECT file, function, explanation FROM ({EXPLAINED}) WHERE rank = 1"))
def h1(spark, sf_dir):
    return R.top_functions(ruled(spark, sf_dir), 1).select("file", "function", "explanation")


@query("h2_top_five", with_views(["banded"], "SELECT file, rank, function FROM banded WHERE rank <= 5"))
def h2(spark, sf_dir):
    return R.top_functions(banded(spark, sf_dir), 5).select("file", "rank", "function")


@query("h3_functions_by_risk", with_views(["ruled"], """
  SELECT file, rank, function, risk_total, CAST(nth AS INTEGER) AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rank) AS nth FROM ruled WHERE risk_label = 'Medium')
  WHERE nth <= 10"""))
def h3(spark, sf_dir):
    return R.functions_by_risk(ruled(spark, sf_dir), "Medium").select("file", "rank", "function", "risk_total", "nth")


@query("j10_score_rows", with_views(["ruled"], f"""
  SELECT function_id, rank, risk_label, '—' AS probability_text, explanation, simple_explanation, fix_suggestion
  FROM ({EXPLAINED})"""))
def j10(spark, sf_dir):
    return ruled(spark, sf_dir).select("function_id", "rank", "risk_label", "probability_text", "explanation",
                                       "simple_explanation", "fix_suggestion")


# --- answers ----------------------------------------------------------------------------------------------------

_MESSAGE = "([" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + "])[event_id % 8 + 1]"
_ASKED = f"""SELECT event_id, 'data/repos/repo' || (user_id % 9) || '/src/f' || user_id ||
  (['.py', '.js', '.md', '.java'])[user_id % 4 + 1] AS file, {_MESSAGE} AS message FROM events"""
_ROUTE = "CASE WHEN digest.file IS NULL THEN 'upload' ELSE " \
         "(['why', 'high', 'medium', 'metrics', 'top', 'free', 'top', 'free'])[event_id % 8 + 1] END"
_DIGEST = """
  SELECT file, max(functions_in_file) AS n, max(language) AS language,
         string_agg(CASE WHEN rank <= 5 THEN rank || '. ' || function || ' (—, ' || risk_label || E')\\n' END, '' ORDER BY rank)
           AS top_lines,
         string_agg(CASE WHEN risk_label = 'High' AND nth <= 10 THEN '- #' || rank || ' ' || function || E' (—)\\n' END, ''
           ORDER BY rank) AS high_lines,
         string_agg(CASE WHEN risk_label = 'Medium' AND nth <= 10 THEN '- #' || rank || ' ' || function || E' (—)\\n' END, ''
           ORDER BY rank) AS medium_lines,
         string_agg(CASE WHEN rank <= 5 THEN '- #' || rank || ' ' || function || ' | risk=' || risk_label || ' | ccn=' || ccn ||
           ' | nloc=' || nloc || ' | params=' || params || ' | start=' || start_line || ' | end=' || end_line END, E'\\n'
           ORDER BY rank) AS summary_lines,
         count(*) FILTER (WHERE risk_label = 'High') AS high, count(*) FILTER (WHERE risk_label = 'Medium') AS medium,
         max(CASE WHEN rank = 1 THEN function END) AS top_function, max(CASE WHEN rank = 1 THEN risk_label END) AS top_label,
         max(CASE WHEN rank = 1 THEN explanation END) AS top_why,
         max(CASE WHEN rank = 1 THEN simple_explanation END) AS top_simple,
         max(CASE WHEN rank = 1 THEN fix_suggestion END) AS top_fix
  FROM (SELECT *, row_number() OVER (PARTITION BY file, risk_label ORDER BY rank) AS nth FROM explained) GROUP BY file"""
_VIEWS = {"explained": EXPLAINED, "digest": _DIGEST, "asked": _ASKED}


def _group_sql(kind: str, ending: str) -> str:
    return f"""CASE WHEN {kind} = 0 THEN 'I didn''t find any {kind}-risk functions in your uploaded ' || language || ' file{ending}'
      ELSE 'I found ' || {kind} || ' {kind}-risk functions in your uploaded ' || language || E' file:\\n\\n' || {kind}_lines END"""


_ANSWER = f"""CASE route WHEN 'upload' THEN '{A.NO_UPLOAD}'
  WHEN 'why' THEN 'The highest-ranked function in your uploaded ' || language || ' file is ' || top_function || ' in ' || file ||
    E'.\\n\\nWhy it stands out: ' || top_why || E'.\\n\\n' || top_simple || E'\\n\\n' || top_fix
  WHEN 'high' THEN {_group_sql("high", ".")}
  WHEN 'medium' THEN {_group_sql("medium", " right now.")}
  WHEN 'metrics' THEN 'I analyze your uploaded ' || language || ' file using function-level metrics such as nloc, ccn, params, '
    'and length. When the saved model is available, I use these model features: {", ".join(STATIC_FEATURES)}. I rank functions '
    'within the uploaded file so the riskiest ones are easier to review first.'
  WHEN 'top' THEN 'Here are the top 5 highest-ranked functions in your uploaded ' || language || E' file:\\n\\n' || top_lines
  ELSE 'to model' END"""
_ANSWER = _ANSWER.replace("params, '\n    'and", "params, and").replace("functions '\n    'within", "functions within")


@query("k6_route_question", with_views(["functions"], f"""
  SELECT event_id, {_ROUTE} AS route FROM asked LEFT JOIN digest USING (file)""",
    asked=_ASKED, digest="SELECT DISTINCT file FROM functions"))
def k6(spark, sf_dir):
    files = functions(spark, sf_dir).select("file").distinct().withColumn("known", F.lit(True))
    asked = questions(spark, sf_dir).join(files, "file", "left")
    return asked.select("event_id", route_question("message", F.col("known").isNotNull()).alias("route"))


@query("k8_answer_questions", with_views(["ruled"], f"""
  SELECT event_id, file, message, route, {_ANSWER} AS answer
  FROM (SELECT asked.*, digest.* EXCLUDE (file), {_ROUTE} AS route FROM asked LEFT JOIN digest USING (file))""", **_VIEWS))
def k8(spark, sf_dir):
    answered = A.answer_questions(questions(spark, sf_dir), ruled(spark, sf_dir), STATIC_FEATURES)
    return answered.withColumn("answer", F.coalesce("answer", F.lit("to model")))


@query("k8_upload_summaries", with_views(["ruled"], f"""
  SELECT path AS file, CASE WHEN n IS NULL THEN '{A.NO_FUNCTIONS}' ELSE 'I analyzed ' || file || ' as a ' || language ||
    ' file and found ' || n || E' functions.\\n\\nTop result: #1 ' || top_function || ' (—, ' || top_label ||
    E').\\n\\nWhy it stands out: ' || top_why || E'.\\n\\n' || top_fix END AS message
  FROM (SELECT 'data/repos/repo' || (doc_id % 9) || '/src/f' || doc_id || (['.py', '.js', '.md', '.java'])[doc_id % 4 + 1]
          AS path FROM documents) LEFT JOIN digest ON file = path""", **_VIEWS))
def k8_uploads(spark, sf_dir):
    files = file_texts(spark, sf_dir).select(F.col("path").alias("file"))
    return A.upload_summaries(files, ruled(spark, sf_dir))


@query("k9_build_prompts", with_views(["ruled"], f"""
  SELECT event_id, file, message, coalesce(part, 1)::INT AS part, coalesce(parts, 1)::INT AS parts,
    CASE WHEN code IS NULL THEN 'I need the uploaded code text before I can answer detailed code questions.' END AS answer,
    md5(E'You are a friendly code reviewer.\\n\\nThe user uploaded this file:\\nFile name: ' || file ||
    E'\\nLanguage: ' || language || E'\\n\\nTop ranked functions from local analysis:\\n' || summary_lines ||
    E'\\n\\nUser question:\\n' || message || E'\\n\\nCode:\\n```' || lower(language) || E'\\n' || code ||
    E'\\n```\\n\\nInstructions:\\n- Answer clearly and simply.\\n- Stay specific to the uploaded code.\\n- If you mention a bug, explain why.\\n- If the user asks for a fix, show steps or an example.\\n- If useful, suggest a safer or cleaner refactor.\\n') AS prompt_md5
  FROM (SELECT asked.*, digest.* EXCLUDE (file), {_ROUTE} AS route FROM asked LEFT JOIN digest USING (file))
  LEFT JOIN (SELECT file, parts, part, substring(text, (part - 1) * 20000 + 1, 20000) AS code FROM (
      SELECT *, unnest(range(1, parts + 1)) AS part FROM (
        SELECT 'data/repos/repo' || (doc_id % 9) || '/src/f' || doc_id || (['.py', '.js', '.md', '.java'])[doc_id % 4 + 1]
          AS file, text, ceil(length(text) / 20000)::BIGINT AS parts FROM documents WHERE trim(text) <> ''))) USING (file)
  WHERE route = 'free'""", **_VIEWS))
def k9(spark, sf_dir):
    prompts = A.build_prompts(questions(spark, sf_dir), ruled(spark, sf_dir), file_texts(spark, sf_dir))
    return prompts.select("event_id", "file", "message", "part", "parts", "answer", F.md5("prompt").alias("prompt_md5"))
