"""The trie of all conversation prefixes, by truncation peeling.

A node is a distinct sequence of first turns. The peeling descends from the greatest depth: conversations that end at a depth are
merged with the nodes that survived from below, which completes the nodes of that depth; each then loses its last turn and what
is equal is grouped again one depth higher. So nodes are found and summed up in the same pass, and a prefix shared by many
conversations goes up as one row.

A level is a shuffle by node, balanced however many conversations share a prefix. Below the first levels prefixes are hardly shared, so
there the conversations below a common node are peeled together inside a task, as long as they are few; those below a node with too
many go through further levels of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from defectlens.llm.common import cut, same

LEVELS = 8  # depths that are always peeled by shuffles
TASK_TURNS = 200_000  # turns below a node that one task may peel
FOUND = "depth int, ids array<binary>, sizes array<long>, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string"
NODE = "depth int, key binary, parent binary, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string"
PEELED = f"{NODE}, ids array<binary>, sizes array<long>"
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns (role, text) of each conversation by ``turn``, null first, equal ones by role and text; null role or text is empty."""
    said = F.struct(
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    talks = rows.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("turns"))
    return talks.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation the identities of its prefixes (128 bits of a running hash), and the bytes of each turn's text."""
    for batch in batches:
        ids, sizes = [], []
        for turns in batch.column(1).to_pylist():
            running, path, weights = xxhash.xxh3_128(seed=42), [], []
            for turn in turns or []:
                role, text = ((turn[c] if turn and turn[c] is not None else "").encode("utf-8", "surrogatepass") for c in ("role", "text"))
                running.update(b"%d %d " % (len(role), len(text)) + role + text)
                path.append(running.digest()), weights.append(len(text))
            ids.append(path), sizes.append(weights)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))], names=["conv_id", "ids", "sizes"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _pack(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct conversation, with the hash of the ids of all that are equal to it, which come one after the other."""
    schema, out, now = _arrow(FOUND), [], None

    def close() -> None:
        if now is not None:
            out.append(now | {"ends": digest.hexdigest()})

    for row in _rows(batches):
        path = row["ids"]
        if now is None or path != now["ids"]:
            close()
            now = {"depth": len(path), "ids": path, "sizes": row["sizes"], "conv_id": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved": 0}
            digest = hashlib.sha256()
            if len(out) >= 4096:
                yield _pack(out, schema)
                out = []
        digest.update(b"," * (now["n_convs"] > 0) + str("" if row["conv_id"] is None else row["conv_id"]).encode())
        now["n_convs"] += 1
        now["conv_id"] = _least(now["conv_id"], row["conv_id"])
    close()
    yield _pack(out, schema)


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _merge(into: dict | None, row: dict) -> dict:
    if into is None:
        return dict(row)
    for name in ("n_convs", "n_children", "n_leaves", "saved"):
        into[name] += row[name]
    into["conv_id"], into["ends"] = _least(into["conv_id"], row["conv_id"]), into["ends"] or row["ends"]
    return into


def peel(rows: list[dict], base: int) -> tuple[list[dict], dict | None]:
    """All nodes deeper than ``base`` of conversations that share their first ``base`` turns, and what goes up to that prefix."""
    ending: dict[int, list[dict]] = {}
    for row in rows:
        ending.setdefault(row["depth"], []).append(row)
    nodes, level = [], {}
    for depth in range(max(ending), base, -1):
        for row in ending.pop(depth, []):
            key = row["ids"][depth - 1]
            level[key] = _merge(level.get(key), row)
        above: dict[bytes | None, dict] = {}
        for key, node in level.items():
            parent = node["ids"][depth - 2] if depth > 1 else None
            done = {
                "depth": depth, "key": key, "parent": parent, "n_leaves": node["n_leaves"] or 1,
                "saved": node["saved"] + (node["n_convs"] - 1) * node["sizes"][depth - 1],
            } | {name: node[name] for name in ("conv_id", "n_convs", "n_children", "ends")}
            nodes.append(done)
            stripped = done | {"depth": depth - 1, "n_children": 1, "ends": None, "ids": node["ids"], "sizes": node["sizes"]}
            above[parent] = _merge(above.get(parent), stripped)
        level = above
    return nodes, next(iter(level.values()), None)


def _peeled(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    """``peel`` for the groups of a sorted partition, one after the other."""
    schema = _arrow(PEELED)

    def finish(group: list[dict]) -> pa.RecordBatch:
        nodes, rest = peel(group, base)
        rest = rest | {"key": rest["parent"], "ids": rest["ids"][:base], "sizes": rest["sizes"][:base]}
        return _pack([*nodes, rest | {"parent": None}], schema)

    group: list[dict] = []
    for row in _rows(batches):
        if group and row["ids"][base - 1] != group[0]["ids"][base - 1]:
            yield finish(group)
            group = []
        group.append(row)
    if group:
        yield finish(group)


def _last(depth: int, back: int = 0) -> Column:
    """The identity of the prefix of ``depth - back`` turns; the root's is null."""
    return F.get("ids", F.lit(depth - back - 1)) if depth > back else F.lit(None).cast("binary")


def _complete(found: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth, from the conversations that end there and the nodes that survived from below; with their paths."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    nodes = found.groupBy(_last(depth).alias("key")).agg(
        F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"), F.first("ids").alias("ids"), F.first("sizes").alias("sizes")
    )
    weight = F.get("sizes", F.lit(depth - 1)) if depth else F.lit(0)
    return nodes.select(
        F.lit(depth).alias("depth"), "key", _last(depth, 1).alias("parent"), "conv_id", "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * weight).alias("saved"), "ends", "ids", "sizes",
    )


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """What the nodes of ``depth + 1`` hand to their parents."""
    shorter = [F.slice(c, 1, depth).alias(c) for c in ("ids", "sizes")]
    return nodes.select(F.lit(depth).alias("depth"), *shorter, "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved", F.lit(None).cast("string").alias("ends"))


def _names(schema: str) -> list[str]:
    return [field.split(" ")[0] for field in schema.split(", ")]


def prefix_trie(talks: DataFrame, conv_id: str = "conv_id", turns: str = "turns", levels: int = LEVELS, task_turns: int = TASK_TURNS) -> DataFrame:
    """One row per node: depth, key, conv_id (its smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``talks`` has a row per conversation with its ``turns`` (role, text); null role or text is empty, null or no turns make a member of
    the root alone. A member's prefix is the node. ``n_leaves`` counts the childless nodes of the subtree, the node included, and
    ``saved_tokens`` sums over the subtree what sharing a turn saves: members less one times the bytes of its text.
    ``ends_sha256`` is the hash of the ids, in order and joined by commas, of those that end here. Conversations with equal turns are
    members each; a null id counts as a member, is empty among the ids, comes first, and is a node's smallest only if it is alone. No
    rows give no node. Other columns are ignored. A conversation is a row by nature; the ids of equal conversations are hashed
    by one task, as the hash goes through them in order, but never held.
    """
    paths = talks.select(F.col(conv_id).cast("long").alias("conv_id"), turns).mapInArrow(_paths, "conv_id long, ids array<binary>, sizes array<long>")
    end = F.try_element_at("ids", F.lit(-1))
    ended = cut(paths.repartition(end).sortWithinPartitions(end, "conv_id").mapInArrow(_ended, FOUND))
    waiting, finished, base, deep = [ended.where(F.col("depth") <= levels)], [], levels, ended.where(F.col("depth") > levels)
    while not deep.isEmpty():
        at = _last(base)
        heavy = cut(deep.groupBy(at.alias("heavy")).agg(F.sum(F.col("depth") - base).alias("n")).where(F.col("n") > task_turns).select("heavy"))
        few = deep.join(heavy, at == F.col("heavy"), "left_anti")
        many = deep.join(heavy, at == F.col("heavy"), "left_semi")
        peeled = cut(few.repartition(at).sortWithinPartitions(at).mapInArrow(lambda batches, base=base: _peeled(batches, base), PEELED))
        finished.append(peeled.where("ids IS NULL").select(*_names(NODE)))
        waiting += [peeled.where("ids IS NOT NULL").select(*_names(FOUND)), many.where(F.col("depth") <= 2 * base)]
        base, deep = 2 * base, many.where(F.col("depth") > 2 * base)
    found = cut(reduce(DataFrame.union, waiting))
    nodes = None
    for depth in range(found.agg(F.max("depth")).first()[0] or 0, -1, -1):
        here = found.where(F.col("depth") == depth)
        nodes = cut(_complete(here if nodes is None else here.union(_stripped(nodes, depth)), depth))
        finished.append(nodes.select(*_names(NODE)))
    trie = reduce(DataFrame.union, finished)
    parents = trie.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    known = trie.where("depth > 1").join(parents, "parent", "left")
    root = nodes.select(F.col("key").alias("root"), F.col("conv_id").alias("parent_conv_id"))  # one row, or none
    first = trie.where("depth = 1").join(F.broadcast(root), same(F.col("parent"), F.col("root"))).drop("root")
    alone = trie.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return known.unionByName(first).unionByName(alone).select(
        "depth", "key", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
