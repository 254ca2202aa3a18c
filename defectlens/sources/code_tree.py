"""Source trees: list in parallel, then read in parallel.

Spark's file source leaves out names that start with ``_`` or ``.``, among them ``__init__.py`` and ``__tests__``,
so the tasks list and read through Arrow's file systems, which know local, HDFS and object-store paths alike.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from defectlens.functions.paths import is_supported
from defectlens.schemas import SOURCE_FILES
from defectlens.session import materialize

TASK_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 16 * 1024 * 1024
ENTRY = "path STRING, is_dir BOOLEAN, size BIGINT"
log = logging.getLogger(__name__)


def _open(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path on it, and what to put in front of its paths to get ours."""
    if path.startswith("file:"):  # Hadoop writes file:/x for what others call file:///x
        inner = "/" + path.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem(), inner, path[: len(path) - len(inner)]
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: path.rindex(inner.rstrip("/"))]


def _entries(path: str) -> list[tuple[str, bool, int]]:
    system, inner, prefix = _open(path)
    try:
        listed = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    except OSError as error:
        log.warning("could not list %s: %s", path, error)
        return []
    return [(prefix + i.path, i.type == fs.FileType.Directory, i.size or 0) for i in listed]


def _root(path: str) -> tuple[str, bool, int] | None:
    system, inner, _ = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        log.warning("target not found and skipped: %s", path)
        return None
    return path, info.type == fs.FileType.Directory, info.size or 0


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the given paths are."""
    for batch in batches:
        yield pd.DataFrame(filter(None, map(_root, batch["path"])), columns=["path", "is_dir", "size"])


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is in the given directories, one level down."""
    for batch in batches:
        for path in batch["path"]:
            yield pd.DataFrame(_entries(path), columns=["path", "is_dir", "size"])


def list_source_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Distinct supported files (path, size) under ``roots``, which may be files or directories.

    Level by level: the directories of a level are dealt to all tasks anew and what is in them is written, until none is left. So a
    branch of any depth or size is listed by as many tasks as it has directories.
    """
    width = spark.sparkContext.defaultParallelism
    given = [(root.rstrip("/") or "/",) for root in sorted(set(roots))]
    found = level = materialize(spark.createDataFrame(given, "path string").repartition(width).mapInPandas(_look, ENTRY), "tree_level")
    while not (inside := level.where("is_dir").select("path").distinct()).isEmpty():
        level = materialize(inside.repartition(width, F.xxhash64("path")).mapInPandas(_expand, ENTRY), "tree_level")
        found = found.unionByName(level)
    files = found.where(~F.col("is_dir") & is_supported("path"))
    return files.groupBy("path").agg(F.max("size").alias("size"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole texts; a file that cannot be read has null content. Batches are kept small in bytes."""
    held, held_bytes = [], 0
    for batch in batches:
        for path in batch["path"]:
            try:
                system, inner, _ = _open(path)
                with system.open_input_stream(inner) as stream:
                    data = stream.read()
                content = data.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")
            except OSError as error:
                log.warning("could not read %s: %s", path, error)
                data, content = b"", None
            held.append((path, content))
            held_bytes += len(data)
            if held_bytes >= BATCH_BYTES:
                yield pd.DataFrame(held, columns=["path", "content"])
                held, held_bytes = [], 0
    yield pd.DataFrame(held, columns=["path", "content"])


def relative_paths(files: DataFrame, base: str | None) -> DataFrame:
    if base is None:
        return files
    prefix = base.rstrip("/") + "/"
    relative = F.when(F.col("path").startswith(prefix), F.substring("path", len(prefix) + 1, 2**31 - 1))
    return files.withColumn("path", F.coalesce(relative, F.col("path")))


def read_listed_files(listing: DataFrame, base: str | None = None) -> DataFrame:
    """(path, content) of the files of a written ``listing``; paths are relative to ``base`` if given.

    The byte total of the listing sets the number of reading tasks, which the size of the path table would not tell.
    """
    total = listing.agg(F.sum("size")).first()[0] or 0
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))
    spread = listing.select("path").repartition(tasks, F.xxhash64("path"))
    return relative_paths(spread.mapInPandas(_read, SOURCE_FILES), base)


def read_source_files(spark: SparkSession, roots: list[str], base: str | None = None) -> DataFrame:
    """(path, content) of every supported file under ``roots``, listed once and then read."""
    return read_listed_files(materialize(list_source_files(spark, roots), "source_listing"), base)


def write_source_files(files: DataFrame, root: str) -> None:
    """Write (path, content) as single files under ``root``. A repeated task writes the same files again."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in batch[["path", "content"]].itertuples(index=False):
                system, inner, _ = _open(f"{root}/{path}")
                system.create_dir(inner.rsplit("/", 1)[0])
                with system.open_output_stream(inner) as stream:
                    stream.write(content.encode("utf-8"))
            yield pd.DataFrame({"written": [len(batch)]})

    files.mapInPandas(task, "written BIGINT").agg(F.sum("written")).first()
