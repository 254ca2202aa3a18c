"""Source files to function metrics, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from defectlens.functions.numbers import line_span
from defectlens.functions.paths import (
    clean_function_name, extension, file_name, function_id, is_test_file, language, norm_path, repo_name,
)
from defectlens.operators.function_scan import braced_functions, indented_functions
from defectlens.schemas import FUNCTION_METRICS

def is_indented(path: Column | str) -> Column:
    """Whether functions are delimited by indentation; a file without a path is read as one with braces."""
    return F.coalesce(extension(path).isin(".py", ".rb"), F.lit(False))


def extract_functions(files: DataFrame) -> DataFrame:
    """``files`` (path, content) to one row of plain counts per function. Files are hashed by path once."""
    files = files.select("path", "content")
    return indented_functions(files.where(is_indented("path"))).unionByName(
        braced_functions(files.where(~is_indented("path")))
    )


def function_rows(raw: DataFrame) -> DataFrame:
    """The function table: what the path tells, the counts, and blank grade and label."""
    path = norm_path("path")
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    start, end = count("start_line"), count("end_line")
    name = clean_function_name("name", "extract")
    columns = {
        "repo_name": repo_name(path),
        "file": path,
        "file_id": path,
        "file_name": file_name(path),
        "relative_path": path,
        "extension": extension(path),
        "language": language(path),
        "is_test_file": is_test_file(path),
        "function_id": function_id(path, name, start),
        "function": name,
        "start_line": start,
        "end_line": end,
        "line_span": line_span(start, end),
        **{c: count(c) for c in ("nloc", "ccn", "token", "params")},
        "length": F.coalesce("length", count("nloc")),
        "radon_grade": F.lit(""),
        "radon_cc": count("ccn"),
        "bug_label": F.lit(""),
    }
    return raw.select([columns[f.name].cast(f.dataType).alias(f.name) for f in FUNCTION_METRICS])


def analyzed_files(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Per file: repository, language and number of functions, 0 for a skipped file."""
    counts = functions.groupBy("file").agg(F.count(F.lit(1)).alias("function_count"))
    paths = files.select(norm_path("path").alias("file"))
    return paths.join(counts, "file", "left").select(
        "file", repo_name("file").alias("repo_name"), language("file").alias("language"),
        F.coalesce("function_count", F.lit(0)).alias("function_count"),
    )


def file_status(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Per row of ``files`` (path, content): ``analyzed``, ``empty`` (no functions) or ``failed`` (could not be read).

    ``functions`` is a function table of them; files without a path are never ``analyzed``.
    """
    counts = functions.groupBy("file").agg(F.count(F.lit(1)).alias("function_count"))
    rows = files.select(norm_path("path").alias("file"), F.col("content").isNull().alias("unread"))
    status = F.when(F.col("unread"), "failed").when(F.col("function_count").isNull(), "empty").otherwise("analyzed")
    return rows.join(counts, "file", "left").select(
        "file", status.alias("status"), F.coalesce("function_count", F.lit(0)).alias("function_count")
    )


def extraction_summary(per_file: DataFrame) -> DataFrame:
    """One row over ``analyzed_files``: files with and without functions, functions in all."""
    return per_file.agg(
        F.count_if(F.col("function_count") > 0).alias("files_analyzed"),
        F.count_if(F.col("function_count") == 0).alias("files_skipped"),
        F.coalesce(F.sum("function_count"), F.lit(0)).alias("total_functions"),
    )


def complexity_rollup(functions: DataFrame) -> DataFrame:
    """Per file, and with a null file in all: sums, averages, and the functions beyond a warning threshold."""
    warned = (F.col("ccn") > 15) | (F.col("length") > 1000) | (F.col("nloc") > 1_000_000) | (F.col("params") > 100)
    warned = F.coalesce(warned, F.lit(False))
    per_file = functions.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("nloc", "ccn", "token")],
        F.count_if(warned).alias("warned"),
        F.sum(F.when(warned, F.col("nloc")).otherwise(0)).alias("warned_nloc"),
    )
    # The total is rolled up from the file rows, not from a second copy of all functions.
    sums = per_file.rollup("file").agg(
        F.grouping("file").alias("is_total"),
        *[F.sum(c).alias(c) for c in ("n", "nloc", "ccn", "token", "warned", "warned_nloc")],
    )
    rate = lambda top, bottom: F.when(F.col(bottom) != 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))
    return sums.where(F.col("n").isNotNull()).select(
        "file",
        "is_total",
        F.col("nloc").alias("total_nloc"),
        (F.col("nloc") / F.col("n")).alias("avg_nloc"),
        (F.col("ccn") / F.col("n")).alias("avg_ccn"),
        (F.col("token") / F.col("n")).alias("avg_token"),
        F.col("n").alias("function_count"),
        F.col("warned").alias("warning_count"),
        rate("warned", "n").alias("warning_rate"),
        rate("warned_nloc", "nloc").alias("warning_nloc_rate"),
    )
