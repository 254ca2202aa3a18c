"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits link at three or fewer differing bits. Each emits the variants within half that radius and linked
fingerprints meet at a common variant:

* one or two bits apart: both emit all variants at distance 0 and 1;
* three bits apart: their parities differ, so the even one goes two steps and the odd one goes one. Of the three bits two
  lie in one half of the fingerprint, so the even one need only flip pairs of bits inside a half.

All fingerprints at a variant with one of them at distance 0 or 1 link to that one, since 1 + 2 = 3. So a star around the
smallest near fingerprint holds every link of the variant, and pairs within a group are never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from defectlens.llm.common import BLOCK, all_columns, cut, let_go, same, shuffle_partitions, unused, word_blocks
from defectlens.llm.components import connected_components

BITS, RADIUS = 64, 3
HALF = BITS // 2
HASHES = 1 << 17  # shingle hashes whose bits are counted at a time
PER_PARTITION = 10_000  # fingerprints whose variants a partition of the meeting shuffle gets on average


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def near_masks() -> list[int]:
    """Flips of at most one bit."""
    return [0] + [_signed(1 << i) for i in range(BITS)]


def far_masks() -> list[int]:
    """Flips of two bits of one half."""
    halves = (range(HALF), range(HALF, BITS))
    return [_signed(1 << i | 1 << j) for half in halves for i, j in combinations(half, 2)]


def fingerprint(text: str | None, width: int = 3, block: int = BLOCK) -> int:
    """The unsigned fingerprint of a text; 0 if it has no word."""
    counts, total, tail, first = np.zeros(BITS, dtype=np.int64), 0, [], True
    for words in word_blocks((text or "").encode("utf-8", "surrogatepass"), block):
        words = tail + words
        if len(words) >= width:
            first = False
            for start in range(0, len(words) - width + 1, HASHES):
                hashes = shingle_hashes(words[start : start + HASHES + width - 1], width)
                counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                total += len(hashes)
        tail = words[len(words) - width + 1 :] if len(words) >= width else words
    if first and tail:
        return xxhash.xxh64_intdigest(b" ".join(tail), 42)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    shingles = [joined[a:b] for a, b in zip(starts, ends)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=len(shingles))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, text_hash, fingerprint) per row of ``docs``: shingles of ``width`` words, a bit set if set in over half of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            prints = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))],
                names=["id", "text_hash", "fingerprint"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, text_hash long, fingerprint long")


def _variants(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(variant, flip): the number of the flip takes less room in the shuffle than the fingerprint, which it gives back."""
    flips = F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("flip", "mask")
    rows = prints.select("fp", flips)
    return rows.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), F.col("flip").cast("short").alias("flip"))


def _origin(masks: list[int]) -> Column:
    """The fingerprint that emitted a variant."""
    return F.col("variant").bitwiseXOR(F.get(F.array(*[F.lit(m) for m in masks]), F.col("flip")))


def fingerprint_links(prints: DataFrame, distinct_prints: int) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fp`` that span every pair within the radius."""
    parts = max(shuffle_partitions(prints), math.ceil(distinct_prints / PER_PARTITION))
    prints = prints.repartition(parts, "fp")  # small rows lie in few partitions, and each becomes hundreds of variants
    near = _variants(prints, near_masks()).repartition(parts, "variant").select("variant", _origin(near_masks()).alias("fp"))
    star = near.withColumn("hub", F.min("fp").over(Window.partitionBy("variant")))  # at most 65 rows a variant
    hubs = star.where("fp = hub").select("variant", "hub")
    even = prints.where(F.bit_count("fp") % 2 == 0)
    far = _variants(even, far_masks()).repartition(parts, "variant")
    met = far.join(hubs.hint("shuffle_hash"), "variant").select(_origin(far_masks()).alias("fp"), "hub")
    links = star.where("fp <> hub").select("fp", "hub").union(met)
    links = links.distinct().where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))).between(1, RADIUS))
    return links.select(F.col("fp").alias("u"), F.col("hub").alias("v"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, fingerprint (long), root (the component's smallest fingerprint) and
    component_id, the smallest id reachable over links.

    Null, empty and wordless texts have fingerprint 0 and link like any other. Null ids take part but are never a
    component's id unless it has no other. Repeated rows come back repeated. No rows give no rows. Other columns are ignored.
    """
    rows = cut(fingerprints(docs, doc_id, text, width))
    classes = cut(rows.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    roots = connected_components(fingerprint_links(classes.select(F.col("fingerprint").alias("fp")), classes.count()))
    placed = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lookup = placed.join(smallest, "root").select("fingerprint", "root", "component_id")
    return rows.join(lookup, "fingerprint").select("id", "text_hash", "fingerprint", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with one row of each component, with its columns: that with the smallest id.

    Of rows equal in id and text one stays; rows of one id in different components are different documents.
    """
    found = near_duplicates(docs, doc_id, text, width)
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))  # null ids come last
    return first_of_each(docs, found.groupBy("root").agg(smallest.alias("best")), doc_id, text)


def first_of_each(docs: DataFrame, groups: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``best`` (id, text_hash) of a group names; of rows equal in both that with the smallest hash of the row."""
    own_id, own_hash, key, row = unused(docs, "_id", "_hash", "_key", "_row")
    chosen = groups.select(F.col("best.id").alias(own_id), F.col("best.text_hash").alias(own_hash))
    kept = docs.withColumn(key, F.xxhash64(text)).join(
        chosen, same(F.col(doc_id).cast("long"), F.col(own_id)) & (F.col(key) == F.col(own_hash)), "left_semi"
    )
    others = [F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(all_columns(docs), docs.dtypes)]
    nth = F.row_number().over(Window.partitionBy(doc_id, key).orderBy(F.xxhash64(*others)))
    return kept.withColumn(row, nth).where(F.col(row) == 1).drop(key, row)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
