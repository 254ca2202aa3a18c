"""What several operators share: word rules, row identity and cutting lineage."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from defectlens.session import new_table_path, shared_folder

T = TypeVar("T")
WHITE = re.compile(rb"[\x20\x09-\x0d]")
MOST_BITS = 1 << 28  # of hashes, broadcast: 32 MB
BLOCK = 1 << 20  # bytes of a text whose words are held at a time
BATCH = "4m"  # of rows that go to a Python worker at a time


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_blocks(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, A-Z lower-cased, block by block, so that a very long text needs little memory."""
    start = 0
    while start < len(data):
        found = WHITE.search(data, start + size)
        end = found.start() if found else len(data)
        yield data[start:end].lower().split()  # bytes: only ASCII is lower-cased and only ASCII space splits
        start = end


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH`` bytes, unless the session has a size of its own; Spark's is 64 MB, which worker and executor hold at once, some of it twice."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH)


def pieces(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts or bytes in column ``at`` are ``size`` bytes at most, or one row.

    What is made of a slice and sent back needs memory for the slice alone, in the worker and in the executor.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, end - start)
            start, before = end, ends[end - 1]


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared checkpoint folder from now on, so that lost executors cost no rework.

    Spark deletes the files after use where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint()


class Stored:
    """Tables that a job writes to the shared folder for its own use, densely packed, and deletes when its result is made."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_table_path(self.spark, name))
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added to those that are columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * i for i in count()) if n.lower() not in taken) for name in names]


def all_columns(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def may_hold(df: DataFrame, value: Column, hashes: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: true where ``value`` is one of ``hashes`` (one long column), else false but for about one row in 16.

    A bit per place of a hash, 16 places per hash and ``MOST_BITS`` at most, is broadcast, so that wide rows need no shuffle to be told apart.
    """
    bits = max(1 << 15, min(MOST_BITS, 1 << (16 * hashes.count()).bit_length()))
    at, bucket, bitmap = unused(df, "_at", "_bucket", "_bitmap")
    place = lambda h: F.pmod(h, F.lit(bits)) + 1
    bucket_of, bit = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    maps = hashes.select(place(F.col(hashes.columns[0])).alias(at)).groupBy(bucket_of.alias(bucket)).agg(F.bitmap_construct_agg(bit).alias(bitmap))
    found = df.withColumn(at, place(value)).join(F.broadcast(maps), bucket_of == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))) != 0
    return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop(at, bucket, bitmap)


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


_slot: list[tuple[object, object]] = []


def held(owner: object, make: Callable[[], T]) -> T:
    """What ``make`` gives, kept in a worker process as long as tasks of the same ``owner`` run there.

    A worker keeps one such thing: a reused worker does not hold the tables of stages that have passed.
    """
    if not _slot or _slot[0][0] is not owner:
        _slot.clear()
        _slot.append((owner, make()))
    return _slot[0][1]


def let_go() -> None:
    """Frees what an earlier stage has left in this worker."""
    _slot.clear()


@contextmanager
def pinned_splits(spark: SparkSession) -> Iterator[None]:
    """Files are split alike by every job in the block, even when executors are lost or join meanwhile."""
    name, leaves = "spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, spark.conf.get(leaves, None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name)
