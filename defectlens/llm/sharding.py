"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in parts by a hash. How many rows of each part go to each shard is drawn first: the counts that a uniformly random
permutation of all rows would give are multivariate hypergeometric, with the sizes of the parts and of the shards as margins. Each
part is then permuted by itself and cut at its counts, the pieces are exchanged, and what arrives is permuted again. A shard is made
of several cells, so that no task has to order a whole shard; the sizes of all cells are known beforehand, so a row's place in its
shard needs no pass over the cells before it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from defectlens.llm.common import all_columns, shuffle_partitions, unused

TASK_ROWS = 1_000_000  # rows of a part or cell
MAX_PARTS = 1024  # and so at most about 1024 * 1024 counts, 8 MB
TAIL = 1e-18  # of the largest probability: where a distribution is cut off, below what a double can tell from zero


@dataclass(frozen=True)
class Layout:
    """``shards`` shards of ``cells`` cells each over ``rows`` rows; counts of shards, and of cells of a shard, are at most one apart."""

    rows: int
    shards: int
    cells: int

    def sizes(self) -> np.ndarray:
        """(shards, cells) rows of each cell."""
        of_shards = _even(self.rows, self.shards)
        return np.stack([_even(n, self.cells) for n in of_shards])

    def starts(self) -> np.ndarray:
        """(shards, cells) the first slot of each cell in its shard."""
        sizes = self.sizes()
        return np.cumsum(sizes, axis=1) - sizes


def _even(total: int, parts: int) -> np.ndarray:
    return np.full(parts, total // parts, dtype=np.int64) + (np.arange(parts) < total % parts)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, taken from ``good`` and ``bad`` ones, are good.

    Probabilities follow from the mode by their exact ratios, to both sides until they vanish, so there is no limit to the counts.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    spread = draws * (good / (good + bad)) * (bad / (good + bad)) * ((good + bad - draws) / max(good + bad - 1, 1))
    reach = 16 + int(10 * math.sqrt(spread))
    while True:
        first, last = max(low, mode - reach), min(high, mode + reach)
        up, down = np.arange(mode, last, dtype=float), np.arange(mode, first, -1, dtype=float)
        right = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
        left = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
        if (last == high or right[-1] < TAIL) and (first == low or left[-1] < TAIL):
            break
        reach *= 2
    chances = np.cumsum(np.concatenate([left[::-1], [1.0], right]))
    return first + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def communication_matrix(parts: list[int], cells: list[int], seed: int) -> np.ndarray:
    """(parts, cells) counts with these sums, as a uniformly random permutation of all rows gives them."""
    rng = np.random.default_rng(seed)
    rest, matrix = np.array(cells, dtype=np.int64), np.zeros((len(parts), len(cells)), dtype=np.int64)
    for i, rows in enumerate(parts):
        left, after = rows, int(rest.sum())
        for j, size in enumerate(rest.tolist()):
            if not left:
                break
            after -= size
            matrix[i, j] = hypergeometric(rng, size, after, left)
            left -= int(matrix[i, j])
        rest -= matrix[i]
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0, task_rows: int = TASK_ROWS, max_parts: int = MAX_PARTS) -> DataFrame:
    """``df`` with ``shard`` (from 0) and ``slot``, the place in the shard: gapless from 0, in random order.

    Every permutation of the rows is equally likely as far as the hash of (seed, row) is random, and the result depends on the rows and
    the seed alone: not on partitions, nor on lost and repeated tasks. Counts of rows of two shards are at most one apart; with fewer rows
    than shards some shards stay empty. Repeated rows are rows each; they share a part, which holds more rows then. Nulls are values
    like any other, no rows give no rows; columns named ``shard`` or ``slot`` are replaced. ``df`` must give the same rows
    when it is computed again.

    The counts are drawn on the driver from the sizes of at most ``max_parts`` parts; rows go through DataFrame functions only.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    df = df.drop("shard", "slot")
    part, key, order, rank, cell, bounds = unused(df, "_part", "_key", "_order", "_rank", "_cell", "_bounds")
    values = [F.to_json(F.struct(c)) if kind.startswith("map") or "map<" in kind else c for c, (_, kind) in zip(all_columns(df), df.dtypes)]
    total = df.count()
    if not total:
        return df.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    n_parts = min(max_parts, max(shuffle_partitions(df), math.ceil(total / task_rows)))
    layout = Layout(total, shards, max(1, min(max_parts // shards, math.ceil(total / shards / task_rows))))
    dealt = df.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), F.lit("part"), *values), F.lit(n_parts)).cast("int"))
    sizes = {r[part]: r["count"] for r in dealt.groupBy(part).count().collect()}
    if sum(sizes.values()) != total:
        raise RuntimeError("the rows changed between two passes over them")
    matrix = communication_matrix([sizes.get(i, 0) for i in range(n_parts)], layout.sizes().ravel().tolist(), seed)
    # A cell begins where the counts before it end: for each part a list of at most max_parts borders.
    borders = [(i, row.tolist()) for i, row in enumerate(np.cumsum(matrix, axis=1))]
    table = df.sparkSession.createDataFrame(borders, f"{part} int, {bounds} array<long>")
    within = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), F.lit("first"), *values))
    ranked = dealt.withColumn(rank, F.row_number().over(within)).join(F.broadcast(table), part)
    steps = [1 << k for k in reversed(range(matrix.shape[1].bit_length()))]
    place = F.aggregate(  # binary search: the number of borders before this row
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(F.col(bounds), at + step - 1) < F.col(rank), F.lit(False)), at + step).otherwise(at),
    )
    sent = ranked.withColumn(cell, place).drop(part, rank, bounds)
    arrived = Window.partitionBy(cell).orderBy(F.xxhash64(F.lit(seed), F.lit("second"), *values))
    starts = F.array(*[F.lit(int(s)) for s in layout.starts().ravel()])
    slot = F.get(starts, F.col(cell)).cast("long") + F.row_number().over(arrived) - 1
    return sent.withColumns({"shard": F.floor(F.col(cell) / layout.cells).cast("int"), "slot": slot}).drop(cell)
