"""Exported commit logs, one file per repository.

Written by ``git log --numstat --date=iso-strict --no-merges --pretty=format:'__COMMIT__|%H|%ad|%s'``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from defectlens.sources.tables import exists

MARKER = "__COMMIT__|"  # fixed value


def read_git_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row (repo_name, value) per commit block; the repository is the file name without its extension.

    The record separator is the block marker at a line start, so one log splits over many tasks. Paths that do not
    exist and empty files give a row with a null value, so that they count as skipped.
    """
    wanted = sorted({paths} if isinstance(paths, str) else set(paths))
    found = [p for p in wanted if exists(spark, p)]
    if not found:
        raise FileNotFoundError(", ".join(wanted))
    name = lambda file: F.regexp_replace(file, r"\.[^.]*$", "").alias("repo_name")
    blocks = spark.read.text(found, lineSep="\n" + MARKER)
    read = blocks.select(name(F.col("_metadata.file_name")), F.regexp_replace("value", r"^__COMMIT__\|", "").alias("value"))
    silent = [p for p in wanted if p not in found] + _empty_files(spark, found)
    rows = [(p.rstrip("/").rsplit("/", 1)[-1], None) for p in silent]
    unread = spark.createDataFrame(rows, "file string, value string").select(name(F.col("file")), "value")
    return read.unionByName(unread)


def _empty_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files of no bytes, which Spark's readers pass over, among the paths, patterns and folders given."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in system.globStatus(place):
            inside = system.listStatus(status.getPath()) if status.isDirectory() else [status]
            found += [f.getPath().getName() for f in inside if f.isFile() and f.getLen() == 0]
    return found
