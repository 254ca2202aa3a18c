"""Answers to questions about ranked files, and prompts for the questions no rule answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from defectlens.functions.paths import language
from defectlens.functions.questions import route_question
from defectlens.operators.ranking import label_heads
from defectlens.operators.skew import MAX_GROUP_ROWS, hot_keys, join_lookup

LISTED = 10  # functions named in an answer about a risk group
TOP = 5  # functions named in a top answer and in a prompt
PART_CHARS = 20_000  # a prompt shows this much code; longer code makes several prompts

# Answer texts.
NO_UPLOAD = "Please upload a supported code file first so I can analyze its functions."
NO_FUNCTIONS = "No functions were detected in the uploaded code file."
NO_FEATURES = "no saved feature list found"
NO_RANKED = "No ranked functions available."
NO_CODE = "I need the uploaded code text before I can answer detailed code questions."


def text(template: str, **values: Column | str) -> Column:
    """Fill ``{name}`` places of a template with columns; a missing value reads None."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        value = values[name]
        shown = (F.col(value) if isinstance(value, str) else value).cast("string")
        parts += [F.lit(before), F.coalesce(shown, F.lit("None"))]
    return F.concat(*parts, F.lit(rest))


def _lines(line: Column, keep: Column, separator: str) -> Column:
    """The kept lines of a group in rank order. The group holds a bounded number of rows by then."""
    entries = F.array_sort(F.collect_list(F.when(keep, F.struct(F.col("rank"), line.alias("line")))))
    return F.array_join(F.transform(entries, lambda e: e["line"]), separator)


def file_digest(ranked: DataFrame) -> DataFrame:
    """One row per file with all that answers and prompts say about it.

    Only the first functions of each label go into the grouping, at most 30 per file.
    """
    heads = label_heads(ranked, LISTED)
    listed = text("- #{rank} {function} ({p})\n", rank="rank", function="function", p="probability_text")
    top_line = text("{rank}. {function} ({p}, {label})\n", rank="rank", function="function", p="probability_text",
                    label="risk_label")
    summary = text(
        "- #{rank} {function} | risk={label} | ccn={ccn} | nloc={nloc} | params={params} | start={start} | end={end}",
        rank="rank", function="function", label="risk_label", ccn="ccn", nloc="nloc", params="params",
        start="start_line", end="end_line",
    )
    has = lambda label: F.col("risk_label") == label
    total = lambda label: F.coalesce(F.max(F.when(has(label), F.col("risk_total"))), F.lit(0))
    first = ("rank", "function", "probability_text", "risk_label", "explanation", "simple_explanation",
             "fix_suggestion")
    return heads.groupBy("file").agg(
        F.max("functions_in_file").alias("functions_in_file"),
        F.max(F.when(F.col("rank") == 1, F.struct(*first))).alias("top"),
        total("High").alias("high_total"),
        _lines(listed, has("High"), "").alias("high_lines"),
        total("Medium").alias("medium_total"),
        _lines(listed, has("Medium"), "").alias("medium_lines"),
        _lines(top_line, F.col("rank") <= TOP, "").alias("top_lines"),
        _lines(summary, F.col("rank") <= TOP, "\n").alias("summary_lines"),
    ).withColumn("language", language("file"))


def _group_answer(kind: str) -> Column:
    total, lines = f"{kind}_total", f"{kind}_lines"
    ending = " right now." if kind == "medium" else "."
    none = text(f"I didn't find any {kind}-risk functions in your uploaded {{language}} file" + ending,
                language="language")
    found = text(f"I found {{n}} {kind}-risk functions in your uploaded {{language}} file:\n\n{{lines}}",
                 n=total, language="language", lines=lines)
    return F.when(F.col(total) == 0, none).otherwise(found)


def answer_questions(
    questions: DataFrame, ranked: DataFrame, features: list[str], max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """``questions`` (file, message and any ids) with ``route`` and ``answer``; free-form questions get no answer."""
    joined = join_lookup(questions, file_digest(ranked), "file", max_group_rows)
    top = lambda name: F.col(f"top.{name}")
    why = text(
        "The highest-ranked function in your uploaded {language} file is {function} in {file}.\n\n"
        "Why it stands out: {explanation}.\n\n{simple}\n\n{fix}",
        language="language", function=top("function"), file="file", explanation=top("explanation"),
        simple=top("simple_explanation"), fix=top("fix_suggestion"),
    )
    metrics = text(
        "I analyze your uploaded {language} file using function-level metrics such as nloc, ccn, params, and length. "
        "When the saved model is available, I use these model features: {features}. I rank functions within the "
        "uploaded file so the riskiest ones are easier to review first.",
        language="language", features=F.lit(", ".join(features) if features else NO_FEATURES),
    )
    top_answer = text("Here are the top 5 highest-ranked functions in your uploaded {language} file:\n\n{lines}",
                      language="language", lines="top_lines")
    route = F.col("route")
    answer = (
        F.when(route == "upload", NO_UPLOAD)
        .when(route == "why", why)
        .when(route == "high", _group_answer("high"))
        .when(route == "medium", _group_answer("medium"))
        .when(route == "metrics", metrics)
        .when(route == "top", top_answer)
    )
    routed = joined.withColumn("route", route_question("message", F.col("functions_in_file").isNotNull()))
    return routed.withColumn("answer", answer).select(*questions.columns, "route", "answer")


def upload_summaries(files: DataFrame, ranked: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The message shown after analysing each of ``files`` (column file)."""
    joined = join_lookup(files.select("file"), file_digest(ranked), "file", max_group_rows)
    top = lambda name: F.col(f"top.{name}")
    found = text(
        "I analyzed {file} as a {language} file and found {n} functions.\n\n"
        "Top result: #{rank} {function} ({p}, {label}).\n\nWhy it stands out: {explanation}.\n\n{fix}",
        file="file", language="language", n="functions_in_file", rank=top("rank"), function=top("function"),
        p=top("probability_text"), label=top("risk_label"), explanation=top("explanation"), fix=top("fix_suggestion"),
    )
    return joined.select("file", F.when(F.col("functions_in_file").isNull(), NO_FUNCTIONS).otherwise(found).alias("message"))


def build_prompts(
    questions: DataFrame, ranked: DataFrame, files: DataFrame, max_group_rows: int = MAX_GROUP_ROWS, part_chars: int = PART_CHARS
) -> DataFrame:
    """Free-form ``questions`` with ``part``, ``parts`` and ``prompt``; ``files`` is (path, content).

    Every free-form question has a row for each part of the code of its file, numbered from 1, so that all of the code is
    asked about. Where the file has no code there is one row, whose prompt is null and whose ``answer`` says so. Of a
    path that occurs twice the smallest content counts.
    """
    hot = hot_keys(questions, "file", max_group_rows)
    free = join_lookup(questions, file_digest(ranked), "file", max_group_rows, hot)
    free = free.where(route_question("message", F.col("functions_in_file").isNotNull()) == "free")
    free = free.select(*questions.columns, "summary_lines")
    code = files.where(F.col("content").rlike(r"\S")).groupBy(F.col("path").alias("file")).agg(F.min("content").alias("_code"))
    code = code.withColumn("parts", F.ceil(F.length("_code") / part_chars).cast("int"))
    code = code.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts")))).withColumn(
        "_code", F.substr("_code", (F.col("part") - 1) * part_chars + 1, F.lit(part_chars))
    )
    joined = join_lookup(free, code, "file", max_group_rows, hot)
    prompt = text(
        "You are a friendly code reviewer.\n\n"
        "The user uploaded this file:\nFile name: {file}\nLanguage: {language}\n\n"
        "Top ranked functions from local analysis:\n{summary}\n\n"
        "User question:\n{question}\n\nCode:\n```{fence}\n{code}\n```\n\n"
        "Instructions:\n- Answer clearly and simply.\n- Stay specific to the uploaded code.\n"
        "- If you mention a bug, explain why.\n- If the user asks for a fix, show steps or an example.\n"
        "- If useful, suggest a safer or cleaner refactor.\n",
        file="file", language=language("file"), summary=F.coalesce("summary_lines", F.lit(NO_RANKED)),
        question="message", fence=F.lower(language("file")), code="_code",
    )
    has_code = F.col("_code").isNotNull()
    return joined.select(
        *questions.columns, F.coalesce("part", F.lit(1)).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"),
        F.when(has_code, prompt).alias("prompt"), F.when(~has_code, NO_CODE).alias("answer"),
    )
