"""Large CSV files whose quoted values hold line breaks, read by many tasks.

A line break ends a record unless an odd number of quotes stands before it in the file. Each block of a file counts its quotes; the sums over
the blocks before it tell whether it begins inside a value, and so where its records begin. Lines are grouped only where a record has
several; the lines that a block begins with belong to the last record of a block before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from defectlens.session import materialize

BLOCK_BYTES = 128 * 1024 * 1024  # files up to this size are left to one task each


def file_sizes(spark: SparkSession, path: str) -> list[int]:
    """Sizes of the files at ``path``: a file, a folder or a pattern."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(place) or []:
        inside = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [f.getLen() for f in inside if f.isFile()]
    return found


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line, quotes): the lines in order of (block, at). Written, as another plan could cut the blocks elsewhere."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )
    return materialize(lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))), "csv_lines")


def records(lines: DataFrame) -> DataFrame:
    """(file, block, at, record): whole records, in order of (block, at)."""
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n"))  # a row per block
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    placed = lines.join(blocks, ["file", "block"]).withColumn("q", F.col("n_before") + F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    placed = placed.withColumn("inside", F.col("q") % 2 == 1).withColumn("open", (F.col("q") + F.col("quotes")) % 2 == 1)
    placed = placed.withColumn("start", F.max(F.when(~F.col("inside"), F.col("at"))).over(upto))  # the line its record begins with, if that is here
    whole = placed.where(~F.col("inside") & ~F.col("open")).select("file", "block", "at", F.col("line").alias("record"))
    parts = placed.where("inside OR open").select("file", "block", "at", "line", "start")
    # A record that goes on in later blocks: its lines there take the start of the last block before them that has one.
    last = placed.where("start IS NOT NULL").groupBy("file", "block").agg(F.max("start").alias("last_start")).withColumn("from_block", F.col("block"))
    known = placed.select("file", "block").distinct().join(last, ["file", "block"], "left")
    known = known.select("file", "block", *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in ("last_start", "from_block")])
    joined = parts.join(known, ["file", "block"]).select(
        "file", F.when(F.col("start").isNull(), F.col("from_block")).otherwise(F.col("block")).alias("of"),
        F.coalesce("start", "last_start").alias("at"), F.struct("block", F.col("at").alias("nth"), "line").alias("part"),
    )
    several = joined.groupBy("file", F.col("of").alias("block"), "at").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["line"]), "\n").alias("record"))
    return whole.unionByName(several)


def read_split_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The table under the header ``columns``, all columns as text, from well-formed CSV: quotes stand around a value or doubled in it."""
    lines = _lines(spark, path)
    found = records(lines).withColumn("record", F.regexp_replace("record", r"\r$", "")).where("record <> ''")
    first = found.groupBy("file").agg(F.min(F.struct("block", "at")).alias("head"))  # a row per file
    rows = found.join(first, "file").where(F.struct("block", "at") != F.col("head"))
    schema = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in columns)
    return rows.select(F.from_csv("record", F.lit(schema), {"escape": '"', "multiLine": "true"}).alias("row")).select("row.*")
