"""Line dedup: lines found in many documents are dropped from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from defectlens.llm.common import all_columns, ascii_lower, cut, same, unused

WHITE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(WHITE)))


def _hash(key: Column) -> Column:
    """128 bits in two halves of independent seeds, null for an empty key."""
    return F.when(key != "", F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10) -> DataFrame:
    """(id, text_hash, dropped): positions, from 0, of the lines to drop; documents that lose none have no row.

    A hot line meets its like only as partial counts, and the join that finds its places again can be split by Spark.
    """
    keys = F.transform(F.transform(lines_of(F.col(text)), line_key), _hash)
    keyed = cut(docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), keys.alias("keys")))
    once = keyed.select("id", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    # Ids may repeat, so they count once per key; null ids count as one document.
    per_id = once.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
    frequent = per_id.where(F.col("n_docs") >= min_docs).select("key.a", "key.b")
    places = keyed.select("id", "text_hash", F.posexplode("keys").alias("at", "key")).where("key is not null")
    hits = places.select("id", "text_hash", "at", "key.a", "key.b").join(frequent, ["a", "b"])
    return hits.groupBy("id", "text_hash").agg(F.collect_set("at").alias("dropped"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10) -> DataFrame:
    """``docs`` with kept (the text without the dropped lines), n_lines and n_dropped, which replace columns of the same names.

    A line is dropped if its key, of at least one character, occurs in ``min_docs`` or more documents, told apart by id. Null and
    empty texts are one empty line, which stays. A text that loses all its lines becomes empty. Repeated rows stay
    repeated, and no rows give no rows.
    """
    rows, kept, n_lines, n_dropped = _marked(docs, doc_id, text, min_docs)
    new = {"kept": kept, "n_lines": n_lines.cast("long"), "n_dropped": n_dropped.cast("long")}
    old = [c for c, name in zip(all_columns(docs), docs.columns) if name.lower() not in new]
    return rows.select(*old, *[column.alias(name) for name, column in new.items()])


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10) -> DataFrame:
    """``docs`` with its columns, the dropped lines gone from ``text``; null texts stay null."""
    rows, kept, _, _ = _marked(docs, doc_id, text, min_docs)
    columns = zip(all_columns(docs), docs.columns)
    return rows.select(*[F.when(F.col(text).isNotNull(), kept).alias(name) if name == text else c for c, name in columns])


def _marked(docs: DataFrame, doc_id: str, text: str, min_docs: int) -> tuple[DataFrame, Column, Column, Column]:
    """The documents next to their dropped positions; the text that is kept, and the numbers of lines and of dropped ones."""
    own_id, own_hash, dropped = unused(docs, "_id", "_hash", "_dropped")
    gone = dropped_lines(docs, doc_id, text, min_docs).toDF(own_id, own_hash, dropped)
    rows = docs.join(gone, same(F.col(doc_id), F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash)), "left")
    lines = lines_of(F.col(text))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    whole = F.when(F.col(dropped).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept)
    return rows, whole, F.size(lines), F.coalesce(F.size(dropped), F.lit(0))
