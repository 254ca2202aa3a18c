"""Paths, numbers, dates and words: the column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformance.adapters import AS_OF, functions, r6, table, with_views
from conformance.registry import query
from defectlens.functions import commits as C, numbers as N, paths as P, questions as Q
from defectlens.functions.paths import LANGUAGES

DUCK_WORDS = "|".join(C.BUGFIX_WORDS)
# Paths in several spellings, one per event.
RAW_PATHS = [
    "'src//a' || user_id || '.py'", "'src\\b' || user_id || '.PY'", "'./x/./y/' || user_id || '/'",
    "'data/repos/r' || user_id || '/tests/Latest.js'", "'lib/spec_' || user_id || '.hpp'",
    "'.hidden/.git' || user_id", "'data/repos'", "'{old => new}/x' || user_id || '.mm'", "'src/{a.py => b.py}'",
]
_CASES = " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(RAW_PATHS))
PATHS = f"SELECT event_id, CASE event_id % {len(RAW_PATHS)} {_CASES} END AS path FROM events"
NORMAL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '[\\\\/]+', '/', 'g'), "
    "'(?:/\\.)+(/|$)', '\\1', 'g'), '^(?:\\./)+', ''), '(.)/$', '\\1')"
)
EXTENSION = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"
SUPPORTED = "(" + ", ".join(f"'{e}'" for e in LANGUAGES) + ")"


def raw_paths(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    spark_case = _CASES.replace("\\", "\\\\")
    return events.selectExpr("event_id", f"CASE event_id % {len(RAW_PATHS)} {spark_case} END AS path")


def paths_sql(select: str) -> str:
    return with_views([], select, paths=PATHS, normal=f"SELECT event_id, {NORMAL} AS path FROM paths")


@query("b1_norm_path", paths_sql("SELECT event_id, path FROM normal"))
def b1(spark, sf_dir):
    return raw_paths(spark, sf_dir).select("event_id", P.norm_path("path").alias("path"))


@query("b2_b3_file_id", paths_sql(
    "SELECT event_id, 'data/repos/r' || (event_id % 5) || '/' || path AS file_id, path AS static_id FROM normal"))
def b2(spark, sf_dir):
    rows = raw_paths(spark, sf_dir)
    repo = F.expr("concat('r', event_id % 5)")
    return rows.select("event_id", P.file_id(repo, "path").alias("file_id"), P.norm_path("path").alias("static_id"))


@query("b4_repo_name", paths_sql(
    "SELECT event_id, CASE WHEN path LIKE 'data/repos/%' THEN split_part(path, '/', 3) "
    "ELSE split_part(path, '/', 1) END AS repo_name FROM normal"))
def b4(spark, sf_dir):
    return raw_paths(spark, sf_dir).select("event_id", P.repo_name("path").alias("repo_name"))


@query("b5_function_id", with_views(["functions"], "SELECT o_orderkey, function_id FROM functions"))
def b5(spark, sf_dir):
    return functions(spark, sf_dir).select(
        F.expr("CAST(substring(function, 3) AS BIGINT)").alias("o_orderkey"),
        P.function_id("file", "function", "start_line").alias("function_id"),
    )


@query("b6_extension", paths_sql(f"SELECT event_id, {EXTENSION} AS extension FROM normal"))
def b6(spark, sf_dir):
    return raw_paths(spark, sf_dir).select("event_id", P.extension(P.norm_path("path")).alias("extension"))


@query("b7_is_supported", paths_sql(f"SELECT event_id, path FROM normal WHERE {EXTENSION} IN {SUPPORTED}"))
def b7(spark, sf_dir):
    paths = raw_paths(spark, sf_dir).withColumn("path", P.norm_path("path"))
    return paths.where(P.is_supported("path"))


_LANGUAGE = " ".join(f"WHEN '{e}' THEN '{name}'" for e, name in LANGUAGES.items())


@query("b8_language", paths_sql(
    f"SELECT event_id, CASE {EXTENSION} {_LANGUAGE} ELSE 'Unknown' END AS language FROM normal"))
def b8(spark, sf_dir):
    return raw_paths(spark, sf_dir).select("event_id", P.language(P.norm_path("path")).alias("language"))


@query("b9_is_python", paths_sql(f"SELECT event_id, path FROM normal WHERE {EXTENSION} = '.py'"))
def b9(spark, sf_dir):
    paths = raw_paths(spark, sf_dir).withColumn("path", P.norm_path("path"))
    return paths.where(P.is_python("path"))


@query("b10_is_test_file", paths_sql(
    "SELECT event_id, CAST(lower(path) LIKE '%tests%' OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), "
    "'test|spec') AS INTEGER) AS is_test_file FROM normal"))
def b10(spark, sf_dir):
    return raw_paths(spark, sf_dir).select("event_id", P.is_test_file(P.norm_path("path")).alias("is_test_file"))


NAMES = "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '(anonymous)' WHEN 2 THEN ' <anonymous> ' " \
        "WHEN 3 THEN 'anonymous' WHEN 4 THEN NULL ELSE concat(' go_', event_id, ' ') END"


@query("b11_clean_function_name", f"""
  SELECT event_id, CASE WHEN name IS NULL OR trim(name) IN ('', '(anonymous)', '<anonymous>', 'anonymous')
                        THEN 'anonymous closure' ELSE trim(name) END AS shown,
         CASE WHEN coalesce(name, '') = '' THEN 'anonymous_closure' ELSE name END AS extracted
  FROM (SELECT event_id, {NAMES} AS name FROM events)""")
def b11(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{NAMES} AS name").select(
        "event_id", P.clean_function_name("name").alias("shown"),
        P.clean_function_name("name", "extract").alias("extracted"),
    )


NUMBER_TEXTS = "CASE event_id % 8 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN concat(' ', event_id, ' ') " \
               "WHEN 3 THEN concat(event_id, '.75') WHEN 4 THEN concat('x', event_id) WHEN 5 THEN NULL " \
               "WHEN 6 THEN concat('-', event_id) ELSE concat(event_id % 1000, 'e1') END"
NUMBER_VALUE = "CASE event_id % 8 WHEN 2 THEN event_id WHEN 3 THEN event_id + 0.75 WHEN 6 THEN -event_id " \
               "WHEN 7 THEN event_id % 1000 * 10 END"


def number_texts(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{NUMBER_TEXTS} AS text")


@query("b12_numstat_int", "SELECT event_id, CASE event_id % 8 WHEN 2 THEN event_id WHEN 6 THEN -event_id ELSE 0 END "
                          "AS lines FROM events")
def b12(spark, sf_dir):
    return number_texts(spark, sf_dir).select("event_id", N.numstat_int("text").alias("lines"))


@query("b13_safe_int", "SELECT event_id, CAST(CASE event_id % 8 WHEN 2 THEN event_id WHEN 6 THEN -event_id ELSE 7 END "
                       "AS INTEGER) AS n FROM events")
def b13(spark, sf_dir):
    return number_texts(spark, sf_dir).select("event_id", N.safe_int("text", 7).alias("n"))


@query("b14_to_int_trunc", f"SELECT event_id, coalesce(CAST(CAST(trunc({NUMBER_VALUE}) AS BIGINT) AS VARCHAR), 'none') "
                           "AS n FROM events")
def b14(spark, sf_dir):
    number = N.to_int_trunc("text").cast("string")
    return number_texts(spark, sf_dir).select("event_id", F.coalesce(number, F.lit("none")).alias("n"))


@query("b15_coerce_numeric", f"SELECT event_id, CAST(coalesce({NUMBER_VALUE}, 0) AS DOUBLE) AS text, "
                             "CAST(0 AS DOUBLE) AS absent FROM events")
def b15(spark, sf_dir):
    return N.coerce_numeric(number_texts(spark, sf_dir), ["text", "absent"])


@query("b16_clean_value", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE value END AS value FROM events")
def b16(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE event_id % 6 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 3 THEN NULL ELSE value END AS value"
    )
    return rows.select("event_id", N.clean_value(rows, "value", -1.0).alias("value"))


@query("b17_line_span", "SELECT event_id, CASE WHEN event_id % 5 = 0 OR user_id % 7 = 0 THEN 0 "
                        "ELSE user_id % 7 - event_id % 5 + 1 END AS line_span FROM events")
def b17(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 5 AS s", "user_id % 7 AS e")
    return rows.select("event_id", N.line_span("s", "e").cast("bigint").alias("line_span"))


@query("b18_commit_ts", """
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(date_trunc('second', ts)) - 7200000000
                   WHEN 1 THEN epoch_us(date_trunc('second', ts)) ELSE -1 END AS micros FROM events""")
def b18(spark, sf_dir):
    text = "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), " \
           "element_at(array('+02:00', 'Z', 'oops'), CAST(event_id % 3 + 1 AS INT)))"
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{text} AS text")
    micros = F.unix_micros(C.commit_ts("text"))
    return rows.select("event_id", F.coalesce(micros, F.lit(-1)).alias("micros"))


def instants(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts")


_AGE = "(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts))"


@query("b19_recency", f"""
  SELECT event_id, {r6(_AGE + ' / 86400000000.0')} AS age_days,
         CAST({_AGE} <= 7 * 86400000000 AS INTEGER) AS recent_7d,
         CAST({_AGE} <= 30 * 86400000000 AS INTEGER) AS recent_30d FROM events""")
def b19(spark, sf_dir):
    now = F.lit(AS_OF)
    return instants(spark, sf_dir).select(
        "event_id", N.py_round(C.age_days("ts", now)).alias("age_days"),
        C.is_recent("ts", now, 7).cast("int").alias("recent_7d"),
        C.is_recent("ts", now, 30).cast("int").alias("recent_30d"),
    )


@query("b20_late_night_weekend", "SELECT event_id, CAST(hour(ts) < 6 AS INTEGER) AS late_night, "
                                 "CAST(isodow(ts) >= 6 AS INTEGER) AS weekend FROM events")
def b20(spark, sf_dir):
    return instants(spark, sf_dir).select(
        "event_id", C.late_night("ts").cast("int").alias("late_night"), C.weekend("ts").cast("int").alias("weekend")
    )


_SUBJECT = "CASE event_id % 6 WHEN 0 THEN concat('A FIX! ', event_id) WHEN 1 THEN concat('Prefix ', event_id) " \
           "WHEN 2 THEN concat('bug_fix ', event_id) WHEN 3 THEN concat(event_type, ':', event_id) " \
           "WHEN 4 THEN concat('hotfix-', event_type) ELSE concat(event_type, ' ', event_id) END"


@query("b21_is_bugfix", f"SELECT event_id, CAST(regexp_matches({_SUBJECT}, '(?i)\\b({DUCK_WORDS})\\b') AS INTEGER) "
                        "AS is_bugfix FROM events")
def b21(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_SUBJECT} AS subject")
    return rows.select("event_id", C.is_bugfix("subject").cast("int").alias("is_bugfix"))


@query("b22_py_round", f"SELECT event_id, {r6('(event_id % 640) / 640.0::DOUBLE')} AS share FROM events")
def b22(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 640 / 640.0D AS share")
    return rows.select("event_id", N.py_round("share").alias("share"))


@query("b23_probability_text", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0
    THEN printf('%.3f', floor(o_totalprice)::BIGINT % 1000 / 1000.0::DOUBLE) ELSE '—' END AS shown FROM orders""")
def b23(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 97 <> 0 THEN floor(o_totalprice) % 1000 / 1000.0D END AS p"
    )
    return rows.select("o_orderkey", N.probability_text("p").alias("shown"))


@query("b24_complexity_grade", """
  SELECT p_partkey, CASE WHEN cc <= 5 THEN 'A' WHEN cc <= 10 THEN 'B' WHEN cc <= 20 THEN 'C' WHEN cc <= 30 THEN 'D'
                         WHEN cc <= 40 THEN 'E' ELSE 'F' END AS grade FROM (SELECT p_partkey, p_size + 1 AS cc FROM part)""")
def b24(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size + 1 AS cc")
    return rows.select("p_partkey", N.complexity_grade("cc").alias("grade"))


_PRESET_KEYS = "element_at(array('top', 'high', 'medium', 'metrics', 'why', 'other'), CAST(event_id % 6 + 1 AS INT))"
_PRESETS = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(
    [Q.PRESETS[k] for k in ("top", "high", "medium", "metrics", "why")]))


@query("k7_preset_question", f"SELECT event_id, CASE event_id % 6 {_PRESETS} ELSE 'none' END AS question FROM events")
def k7(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_PRESET_KEYS} AS k")
    return rows.select("event_id", F.coalesce(Q.preset_question("k"), F.lit("none")).alias("question"))


@query("k10_fallback_list", """
  SELECT event_id, CASE WHEN user_id % 3 = event_id % 3 THEN 'm' || (user_id % 3)
                   ELSE 'm' || (user_id % 3) || ',m' || (event_id % 3) END AS names FROM events""")
def k10(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "array(concat('m', user_id % 3), '', concat('m', event_id % 3), NULL, concat('m', user_id % 3)) AS a"
    )
    return rows.select("event_id", F.array_join(Q.fallback_list("a"), ",").alias("names"))


_ERRORS = "CASE event_id % 7 WHEN 0 THEN 'Rate Limit hit' WHEN 1 THEN concat('code 429 for ', user_id % 9) " \
          "WHEN 2 THEN 'x is not a valid model ID' WHEN 3 THEN 'HTTP 404' WHEN 4 THEN 'missing API key' " \
          "WHEN 5 THEN 'HTTP 403' ELSE 'boom' END"


@query("k11_classify_error", """
  SELECT event_id, (['rate_limit', 'rate_limit', 'bad_model', 'bad_model', 'auth', 'auth', 'other'])[event_id % 7 + 1]
    AS error_class FROM events""")
def k11(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{_ERRORS} AS message")
    return rows.select("event_id", Q.classify_error("message").alias("error_class"))
