"""Benchmark decontamination: item-sized windows of documents against benchmark items, by SimHash and exact similarity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from defectlens.llm.common import cut, same, unused

WIDTH, SIMILARITY = 5, 0.8
BLOCK_BITS = (11, 11, 11, 11, 10, 10)  # of a 64-bit fingerprint
BLOCK_RADIUS = 2
RADIUS = len(BLOCK_BITS) * (BLOCK_RADIUS + 1) - 1  # 17: within it, one block at least differs in two bits at most
MAX_KEYS = 2_000_000  # block keys, and likewise item shingles, of the part of the benchmark that is broadcast at a time


def words_of(text: Column) -> Column:
    """Lower-cased words between white space; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), "")


def shingle_hashes(words: Column, width: int) -> Column:
    """A 64-bit hash of each run of ``width`` words, by position; runs are hashed by doubling their length."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    done, out = 0, None
    power, size = hashes, 1
    while done < width:
        if (width - done) & size:
            out = power if out is None else _paired(out, power, done)
            done += size
        power, size = (_paired(power, power, size), size * 2) if done < width else (power, size)
    return F.slice(out, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))


def _paired(left: Column, right: Column, ahead: int) -> Column:
    """Hashes of each element of ``left`` with that of ``right`` ``ahead`` places on; what runs over the end is cut off later."""
    moved = F.slice(right, F.lit(ahead + 1), F.size(right))
    return F.zip_with(left, moved, lambda a, b: F.xxhash64(a, b))


def window_fingerprint(shingles: Column) -> Column:
    """The SimHash of an array of hashes: bits set in over half of them."""

    def put(found: Column, bit: Column) -> Column:
        votes = F.aggregate(shingles, F.lit(0), lambda n, x: n + F.call_function("getbit", x, bit).cast("int"))
        mark = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        return found.bitwiseOR(F.when(votes * 2 > F.size(shingles), mark).otherwise(F.lit(0).cast("long")))

    # Never null, so that no null check of this costly expression is moved into a join.
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), put), F.lit(0).cast("long"))


def _block(fingerprint: Column, number: int) -> Column:
    return F.shiftrightunsigned(fingerprint, sum(BLOCK_BITS[:number])).bitwiseAND((1 << BLOCK_BITS[number]) - 1)


def block_keys(fingerprint: Column, n_words: Column) -> Column:
    """Keys of each block's value and of all values one bit from it: two blocks within two bits share one of them."""
    keys = []
    for number, bits in enumerate(BLOCK_BITS):
        value = _block(fingerprint, number)
        place = F.shiftleft(n_words.cast("long"), 16) + number * (1 << 12)
        keys += [place + value.bitwiseXOR(F.lit(flip).cast("long")) for flip in (0, *(1 << i for i in range(bits)))]
    return F.array(*keys)


def _first_meeting(left: Column, right: Column, n_words: Column) -> Column:
    """The one key, of those two fingerprints share, under which the pair counts; null if no block is near enough."""
    tests = []
    for number in range(len(BLOCK_BITS)):
        value, other = _block(left, number), _block(right, number)
        apart = value.bitwiseXOR(other)
        lowest = apart.bitwiseAND(-apart)
        shared = F.when(F.bit_count(apart) == 2, value.bitwiseXOR(lowest)).otherwise(value)
        key = F.shiftleft(n_words.cast("long"), 16) + number * (1 << 12) + shared
        tests.append((F.bit_count(apart) <= BLOCK_RADIUS, key))
    return F.coalesce(*[F.when(near, key) for near, key in tests])


def weighted_similarity(left: Column, right: Column) -> Column:
    """Shared occurrences over all occurrences: each shingle weighs as often as it occurs."""
    common = F.array_intersect(left, right)
    single = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    repeats = F.aggregate(common, F.lit(0), lambda n, x: n + F.least(times(left, x), times(right, x)))
    shared = F.when(single(left) | single(right), F.size(common)).otherwise(repeats)
    return shared / (F.size(left) + F.size(right) - shared)


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item_id, item, n, width, words, shingles, print): items of ``width`` words or less have one shingle, wordless ones none and no row."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).distinct()
    rows = rows.withColumn("n", F.size("words")).where("n > 0").withColumn("width", F.least(F.lit(width), F.col("n")))
    sizes = [F.when(F.col("width") == k, shingle_hashes(F.col("words"), k)) for k in range(1, width + 1)]
    rows = rows.withColumn("shingles", F.coalesce(*sizes)).withColumn("item", F.xxhash64("words"))
    return rows.withColumn("print", window_fingerprint(F.col("shingles")))


def anchor_words(items: DataFrame, similarity: float) -> DataFrame:
    """(word, n): some rare words of each item, so many that a window alike enough holds one of them within a shared shingle.

    Such a window lacks at most 1 - ``similarity`` of the item's shingles; the words taken lie in more shingles than that. Words of few
    items come first, of equals the longer ones. Which words are taken decides the work, not the result.
    """
    spots = items.select("item", "n", "width", F.posexplode("words").alias("at", "word")).distinct()
    known = spots.select("item", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("items"))
    rarity = F.row_number().over(Window.partitionBy("item").orderBy("items", F.length("word").desc(), "word"))
    ranks = spots.select("item", "word").distinct().join(known, "word").withColumn("rank", rarity).select("item", "word", "rank")
    first, last = F.greatest(F.lit(0), F.col("at") - F.col("width") + 1), F.least(F.col("at"), F.col("n") - F.col("width"))
    inside = spots.join(ranks, ["item", "word"]).select("item", "n", "width", "rank", F.explode(F.sequence(first, last)).alias("shingle"))
    rarest = inside.groupBy("item", "n", "width", "shingle").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("rank", "shingle"))
    enough = F.floor((F.col("n") - F.col("width") + 1) * (1 - similarity) + 1e-9) + 1
    cut_off = rarest.withColumn("place", place).where(F.col("place") == enough).select("item", "n", F.col("rank").alias("cut_off"))
    return ranks.join(cut_off, "item").where("rank <= cut_off").select("word", "n").distinct()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, max_keys: int = MAX_KEYS,
) -> DataFrame:
    """(id, text_hash, item_id, similarity, start): each document and item that some window makes ``similarity`` alike.

    A window has as many words as the item (fewer where the document ends). Only windows that can reach the similarity are
    fingerprinted: they hold one of the item's rare words (see ``anchor_words``), and they start at a shingle that the item has too,
    since moving a window on to its first shared shingle loses none. Windows and items within ``RADIUS`` bits meet for certain
    under a block key, and the exact similarity decides. ``start`` is the first word of the best window, the first of equals.

    Null, empty and wordless texts match nothing. Repeated rows and ids give one row per text and item; repeated items one per
    item id. An empty table on either side gives no rows. Other columns are ignored. The benchmark is broadcast in parts of
    bounded size, however large it is, and all documents are read for each part.
    """
    items = cut(benchmark_items(benchmark, item_id, item_text, width))
    facts = items.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("words"), F.collect_set("width").alias("widths")).first()
    per_item = sum(bits + 1 for bits in BLOCK_BITS)
    parts = max(1, math.ceil(max(facts["n"] * per_item, facts["words"] or 0) / max_keys))
    found = []
    for part in range(parts):
        here = items.where(F.pmod(F.xxhash64("item", "item_id"), F.lit(parts)) == part)
        for k in facts["widths"] or [width]:
            found.append(_matches(docs, here.where(F.col("width") == k), doc_id, text, k, similarity))
    matches = reduce(DataFrame.unionAll, found)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return matches.groupBy("id", "text_hash", "item_id").agg(best).select(
        "id", "text_hash", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("start")
    )


def _matches(docs: DataFrame, items: DataFrame, doc_id: str, text: str, width: int, similarity: float) -> DataFrame:
    seeds = items.select(F.explode("shingles").alias("shingle"), "n").distinct()
    keys = items.select(F.explode(block_keys(F.col("print"), F.col("n"))).alias("key"), "item_id", F.col("print").alias("item_print"), F.col("shingles").alias("wanted"))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), words_of(F.col(text)).alias("all"))
    # The words are cut, exploded and looked up in one generated loop; the array is copied only around a word that is found. The
    # outer form keeps Spark from cutting all words twice, once to drop empty arrays.
    places = rows.select("id", "text_hash", "all", F.posexplode_outer("all").alias("at", "word"))
    low = F.greatest(F.lit(0), F.col("at") - F.col("n") + 1)
    around = places.join(F.broadcast(anchor_words(items, similarity)), "word").select(
        "id", "text_hash", "at", "n", low.alias("low"), F.slice("all", low + 1, F.col("at") + F.col("n") - low).alias("around")
    )
    around = around.withColumn("shingles", shingle_hashes(F.col("around"), width))
    starts = around.select("id", "text_hash", "at", "n", "low", "shingles", F.posexplode_outer("shingles").alias("q", "shingle"))
    windows = starts.where("low + q <= at").join(F.broadcast(seeds), ["shingle", "n"]).select(
        "id", "text_hash", (F.col("low") + F.col("q")).alias("start"), "n", F.slice("shingles", F.col("q") + 1, F.col("n") - (width - 1)).alias("window")
    )
    prints = windows.withColumn("print", window_fingerprint(F.col("window")))
    probes = prints.withColumn("key", F.explode(block_keys(F.col("print"), F.col("n"))))
    near = probes.join(F.broadcast(keys), "key").where(
        (F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        & (F.col("key") == _first_meeting(F.col("print"), F.col("item_print"), F.col("n")))
    )
    alike = near.withColumn("similarity", weighted_similarity(F.col("window"), F.col("wanted")))
    return alike.where(F.col("similarity") >= similarity).select("id", "text_hash", "item_id", "similarity", "start")


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs``, with its columns, but for those that hold a benchmark item."""
    own_id, own_hash = unused(docs, "_id", "_hash")
    leaks = contaminated(docs, benchmark, doc_id, text, **settings).select(
        F.col("id").alias(own_id), F.col("text_hash").alias(own_hash)
    ).distinct()
    return docs.join(leaks, same(F.col(doc_id), F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash)), "left_anti")
