"""Building blocks that stay balanced when one key holds a large share of the rows.

Each one measures the keys first and keeps Spark's ordinary plan while every group is small enough for a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from defectlens.session import materialize

MAX_GROUP_ROWS = 1_000_000  # rows of one group that a single task may sort
MANY_SLICES = 1_000  # the bounds of a slice are found from up to 300 rows that the driver samples
PREFIX_DIGITS = 3  # hex digits per refinement step: 4,096 buckets
PICK_ROWS = 50_000  # digests that may be sorted for one pick


def row_hash(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """A hash of the whole row, or of those of ``columns`` that it has; maps, which Spark does not hash, are left out."""
    wanted = None if columns is None else set(columns)
    names = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType) and (wanted is None or f.name in wanted)]
    return F.xxhash64(*names) if names else F.lit(0).cast("long")


def group_sizes(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """Rows of the largest group and rows in all."""
    if not by:
        rows = df.count()
        return rows, rows
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    return row["largest"] or 0, row["rows"] or 0


def prefix_sums(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    measures: dict[str, Column],
    largest_group: int | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    ties: Iterable[str] | None = None,
) -> DataFrame:
    """Add, per measure ``m``, the sum ``m`` over the rows up to this one and the group's sum ``m_total``.

    Rows equal in ``order`` follow each other by the hash of the row, in both plans, so that the sums depend on the rows alone.
    That reads every column; a caller who knows what tells its rows apart names these columns as ``ties``, and only they are read.
    With a group too big for one task the rows are range-partitioned on (group, order) instead, summed within each slice, and
    every slice gets what the slices before it carry over.
    """
    rows = largest_group
    if largest_group is None:
        largest_group, rows = group_sizes(df, by)
    if largest_group <= max_group_rows:
        group = Window.partitionBy(*by)
        return df.withColumns(_sums(measures, group, [*order, row_hash(df, ties)]))
    return _sliced_prefix_sums(df, by, order, measures, slice_count(rows, max_group_rows), ties)


def slice_count(rows: int, max_group_rows: int) -> int:
    """Slices of at most ``max_group_rows`` rows; where that makes very many, of as many rows as a task may sort."""
    return max(2, min(math.ceil(rows / max_group_rows), max(MANY_SLICES, math.ceil(rows / MAX_GROUP_ROWS))))


def _sums(measures: dict[str, Column], group: Window, order: list[Column]) -> dict[str, Column]:
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {name: F.sum(value).over(upto) for name, value in measures.items()}
    return running | {f"{name}_total": F.sum(value).over(group) for name, value in measures.items()}


def _sliced_prefix_sums(
    df: DataFrame, by: list[str], order: list[Column], measures: dict[str, Column], slices: int, ties: Iterable[str] | None = None
) -> DataFrame:
    # The slice number depends on sampled range bounds, so it is written down before two plans read it. The hash of the row,
    # last in the order, lets many rows with equal keys be cut apart, at the same place in a retried task.
    order = [*order, F.col("_row")]
    keyed = df.withColumn("_row", row_hash(df, ties))
    placed = keyed.repartitionByRange(slices, *[F.col(c).asc() for c in by], *order)
    placed = materialize(placed.withColumn("_slice", F.spark_partition_id()), "slices")
    local = placed.withColumns(_sums(measures, Window.partitionBy("_slice", *by), order))

    pieces = placed.groupBy("_slice", *by).agg(*[F.sum(v).alias(f"_{n}") for n, v in measures.items()])
    group = Window.partitionBy(*by)  # at most one row per slice and group
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_pieces": F.count(F.lit(1)).over(group)}
    for name in measures:
        carried[f"_{name}_before"] = F.sum(f"_{name}").over(before)
        carried[f"_{name}_all"] = F.sum(f"_{name}").over(group)
    # A slice holds at most two groups that reach into other slices: its first and its last.
    carry = pieces.withColumns(carried).where(F.col("_pieces") > 1).select(
        F.col("_slice").alias("_at"),
        *[F.col(c).alias(f"_by_{c}") for c in by],
        *[f"_{n}_{part}" for n in measures for part in ("before", "all")],
    )
    match = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_slice") == F.col("_at")
    )
    out = local.join(F.broadcast(carry), match, "left")
    final = {}
    for name in measures:
        final[name] = F.col(name) + F.coalesce(F.col(f"_{name}_before"), F.lit(0))
        final[f"{name}_total"] = F.coalesce(F.col(f"_{name}_all"), F.col(f"{name}_total"))
    return out.withColumns(final).drop("_slice", "_row", *carry.columns)


def hot_keys(df: DataFrame, key: str, max_rows: int) -> DataFrame | None:
    """(key, _salts): every key, null among them, with more than ``max_rows`` rows, and into how many parts it goes; None if none.

    There are at most rows / ``max_rows`` of them, which bounds what the joins broadcast.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    hot = materialize(sizes.select(key, F.ceil(F.col("_n") / max_rows).cast("int").alias("_salts")), "hot_keys")
    return None if hot.isEmpty() else hot


def join_lookup(
    left: DataFrame, right: DataFrame, key: str, max_group_rows: int = MAX_GROUP_ROWS, hot: DataFrame | None = None
) -> DataFrame:
    """Left join to ``right``, which holds each key once or a few times.

    The sides are not hinted: adaptive execution broadcasts ``right`` if its measured size allows. Each key that holds too many
    rows of ``left`` is spread over salts of its own number, and only its rows of ``right`` are repeated. The salt is a hash of the
    row, so that a retried task places the row where it was before. ``hot`` saves counting the keys again.
    """
    hot = hot_keys(left, key, max_group_rows) if hot is None else hot
    if hot is None:
        return left.join(right, key, "left")
    salts = F.broadcast(hot.withColumnRenamed(key, "_hot"))
    numbered = left.join(salts, F.col(key).eqNullSafe(F.col("_hot")), "left").drop("_hot")
    spread = F.pmod(row_hash(left), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = numbered.withColumn("_salt", spread).drop("_salts")
    repeated = right.join(salts, F.col(key) == F.col("_hot"), "left").drop("_hot")
    repeated = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")


def hex_histogram(df: DataFrame, name: str, digits: int = PREFIX_DIGITS) -> list[tuple[str, int]]:
    """Rows per prefix of a column of hex digests, in order."""
    prefix = F.substring(name, 1, digits).alias("prefix")
    return sorted((r["prefix"], r["n"]) for r in df.groupBy(prefix).agg(F.count(F.lit(1)).alias("n")).collect())


def kth_smallest_hex(
    df: DataFrame, name: str, ranks: list[int], histogram: list[tuple[str, int]], small: int = PICK_ROWS, width: int = 30
) -> dict[int, str]:
    """The digests at ``ranks`` (from 1; rank 0 gives ``""``) of column ``name``, whose ``histogram`` is given.

    Narrows down by digest prefix, so no task sorts and no driver sees more than ``small`` or 4,096 rows per rank, but for
    digests that are equal in ``width`` digits.
    """
    found = {rank: "" for rank in ranks if rank <= 0}
    for rank in set(ranks) - set(found):
        left, buckets, rest = rank, histogram, df.select(name)
        while True:
            for prefix, rows in buckets:
                if left <= rows:
                    break  # it is in this bucket
                left -= rows
            rest = rest.where(F.col(name).startswith(prefix))
            if rows <= small or len(prefix) >= width:
                break
            buckets = hex_histogram(rest, name, len(prefix) + PREFIX_DIGITS)
        found[rank] = rest.orderBy(name).offset(left - 1).limit(1).first()[0]
    return found


def ranked_hex(
    df: DataFrame, group: str, name: str, wanted: Callable[[dict], dict], small: int = PICK_ROWS, width: int = 30
) -> tuple[dict, dict]:
    """Exact selection for all groups at once: rows per group, and per group the digest of column ``name`` at its rank.

    ``wanted`` tells the rank (from 1; 0 gives ``""``) of each group from the rows per group, which the first pass counts along with
    their digest prefixes. Every further pass refines, for all groups together, the one prefix per group that holds the rank, until
    those left hold ``small`` rows each, which are then numbered. So small tables take two passes whatever the number of groups, and
    larger ones one more per 4,096-fold; only prefixes and their counts reach the driver, at most 4,096 per group and pass.
    """
    rows = df.select(F.col(group).alias("g"), F.col(name).alias("d"))

    def histogram(kept: DataFrame, digits: int) -> dict:
        found: dict = {}
        for r in kept.groupBy("g", F.substring("d", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
            found.setdefault(r["g"], []).append((r["p"], r["n"]))
        return {g: sorted(cells) for g, cells in found.items()}

    cells, digits = histogram(rows, PREFIX_DIGITS), PREFIX_DIGITS
    counts = {g: sum(n for _, n in parts) for g, parts in cells.items()}
    ranks = wanted(counts)
    ends, open_ = {g: "" for g, rank in ranks.items() if rank <= 0}, {g: (rank, counts[g]) for g, rank in ranks.items() if rank > 0}
    spark = df.sparkSession
    while open_:
        place = {}  # per group: the prefix with the rank, the rank within it, and its rows
        for g, (left, _) in open_.items():
            for prefix, n in cells[g]:
                if left <= n:
                    place[g] = prefix, left, n
                    break
                left -= n
        chosen = spark.createDataFrame([(g, p, left) for g, (p, left, _) in place.items()], f"g {rows.schema['g'].dataType.simpleString()}, p string, left long")
        kept = rows.withColumn("p", F.substring("d", 1, digits)).join(F.broadcast(chosen), ["g", "p"])  # a row per group
        if digits >= width or all(n <= small for _, _, n in place.values()):
            nth = kept.withColumn("nth", F.row_number().over(Window.partitionBy("g").orderBy("d")))
            return counts, ends | {r["g"]: r["d"] for r in nth.where("nth = left").select("g", "d").collect()}
        digits += PREFIX_DIGITS
        cells, open_ = histogram(kept, digits), {g: (left, n) for g, (_, left, n) in place.items()}
    return counts, ends
