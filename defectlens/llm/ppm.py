"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of at most ``ORDER`` bytes with counts of what follows each, learnt from all training texts.
The longest contexts count occurrences; a shorter one counts in how many contexts one byte longer a symbol was seen, as if
only novel symbols reached it. A symbol has probability (c - 1/2) / n in the longest context known, where c is its count, n the
context's sum and d the number of its symbols; else an escape of d / 2n leads to the context one byte shorter, in which the
symbols of the longer one are excluded; below the empty context all symbols left are equally likely.

The trie is never held whole. A symbol and its context are one number (a gram), so the trie is a table of grams. Grams that share the
last three bytes of their context are a branch of at most 2^24 leaves, and branches with the orders above them (at most 2^24
counts of three-byte grams, in UTF-8 far fewer) have all that the probabilities of their grams depend on. Texts are dealt to batches,
and a batch is sent only the grams and words that occur in it.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from defectlens.llm.common import Stored, cut, pinned_splits, shuffle_partitions

ORDER, TOP = 5, 2  # bytes of the longest context, and of the longest one that all branches share
START, END = 0xFF, 0xFE  # never in UTF-8
GRAM, WORD, FIRST = 0, 1, 2  # what a fact is about; the first batch of a word counts it
SYMBOLS = 257  # all bytes and the end; what a text can be made of
BATCH_BYTES = 32 << 20  # and so the size of a batch's words and grams
GROUP = 200_000  # grams that are worked on together, unless a branch has more
CHUNK = 0xFFFF  # bytes whose grams are made and sorted at a time: a place among them, or a count, has 16 bits beside a gram
TOGETHER = 1 << 20  # bytes of texts that are worked on together, unless a text has more
FOLD = 1 << 21  # grams with counts that are held before they are merged
ROWS = 100_000  # rows handed to Spark at a time
FACTS = 2_000_000  # facts that a partition packs together
BLOCK_BYTES = 1 << 20  # of texts that are compressed together


def held_out(doc_id: str = "doc_id"):
    """Rows that are not learnt from; a null id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def grams_of(*texts: bytes) -> Iterator[np.ndarray]:
    """Per byte and for the end of each text: the ``ORDER`` bytes before it, the byte itself last, in 48 bits."""
    whole = b"".join(part for t in texts for part in (bytes([START]) * ORDER, t, bytes([END])))
    for start in range(0, len(whole) - ORDER, CHUNK):
        part = np.frombuffer(whole, np.uint8, min(CHUNK, len(whole) - ORDER - start) + ORDER, start)
        wide = part.astype(np.int64)
        gram = np.zeros(len(part) - ORDER, np.int64)
        for i in range(ORDER + 1):
            gram <<= 8
            gram |= wide[i : len(part) - ORDER + i]
        yield gram[part[ORDER:] != START]


def _first(keys: np.ndarray) -> np.ndarray:
    """Places of sorted keys that differ from the one before."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    keys = np.concatenate(parts)
    keys.sort()
    return keys[_first(keys)]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and the sum of their counts."""
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _first(keys)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin and the last one's end."""
    whole = pc.ascii_trim_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    parts = pc.ascii_split_whitespace(whole)
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # a text without words gives an empty one
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), before[parts.offsets.to_numpy()]


def _in_order(words: list[pa.Array]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words encoded by their distinct ones, and the order of these by bytes: both passes over a batch number them alike."""
    whole = pa.concat_arrays([pa.array([], pa.large_string()), *words]).dictionary_encode()
    return whole, pc.sort_indices(whole.dictionary).to_numpy()


def _encoded(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass").lower()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch in the partition: its distinct grams and words in order, and their counts in training texts, 0 for those only held out."""
    tallies: dict[int, _Tally] = defaultdict(_Tally)
    for batch in batches:
        for number, text, train in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            tallies[number].add(_encoded(text), train)
    for number in list(tallies):
        yield from tallies.pop(number).rows(number)


class _Tally:
    """Counts of the grams and words of a batch."""

    def __init__(self) -> None:
        self.waiting: dict[bool, list[bytes]] = {True: [], False: []}
        self.waits = {True: 0, False: 0}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.words, self.times = 0, [], []

    def add(self, data: bytes, train: bool) -> None:
        self.waiting[train].append(data)
        self.waits[train] += len(data) + ORDER + 1
        if self.waits[train] > TOGETHER:
            self._take(train)

    def _take(self, train: bool) -> None:
        texts = self.waiting[train]
        words = pc.value_counts(_words(texts)[0])
        self.words.append(words.field("values"))
        self.times.append(words.field("counts").to_numpy() * int(train))
        pieces: list[np.ndarray] = []
        for gram in grams_of(*texts):
            gram.sort()
            first = _first(gram)
            pieces.append(gram[first] << 16)
            if train:
                pieces[-1] |= np.diff(first, append=len(gram))
            if len(pieces) * CHUNK > FOLD:
                self._fold(pieces)
                pieces = []
        self._fold(pieces)
        self.waiting[train], self.waits[train] = [], 0

    def _fold(self, pieces: list[np.ndarray]) -> None:
        """Merges grams that have their counts beside them in 16 bits."""
        packed = np.concatenate([np.zeros(0, np.int64), *pieces]).view(np.uint64)
        packed.sort()
        keys = (packed >> np.uint64(16)).view(np.int64)
        first = _first(keys)
        counts = (packed & np.uint64(0xFFFF)).view(np.int64)
        self.parts.append((keys[first], np.add.reduceat(counts, first) if len(keys) else counts))
        self.size += len(first)
        if self.size > FOLD:
            self._merge()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [_merged(self.parts)]
        self.size = 0

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The facts asked for, places by the order of grams and of words."""
        for train in (True, False):
            self._take(train)
        self._merge()
        keys, counts = self.parts[0]
        encoded, order = _in_order(self.words)
        times = np.bincount(encoded.indices.to_numpy(), np.concatenate(self.times), len(order))[order].astype(np.int64)
        words = encoded.dictionary.take(pa.array(order)).view(pa.large_binary())
        for start in range(0, max(len(keys), len(words)), ROWS):
            end = start + ROWS
            yield _rows(number, start, keys[start:end], counts[start:end], None)
            yield _rows(number, start, None, times[start:end], words[start:end])


class _Asked:
    """Grams and words of a batch's texts, which get their values when all are known: each is sorted once and never looked for again."""

    def __init__(self, texts: list[bytes]) -> None:
        self.encoded: list[tuple[np.ndarray, np.ndarray]] = []  # of some texts their words by number, and where each text's begin
        distinct: list[pa.Array] = []
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []  # of some texts their distinct grams, and which one stands at each place
        self.starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        some, size = [], 0
        for i, text in enumerate(texts):
            some.append(text)
            size += len(text) + ORDER + 1
            if size > TOGETHER or i == len(texts) - 1:
                self._take(some, distinct)
                some, size = [], 0
        numbers, self.in_order = _in_order(distinct)
        numbers, start = numbers.indices.to_numpy(), 0
        for i, (words, borders) in enumerate(self.encoded):
            end = start + len(distinct[i])
            self.encoded[i], start = (numbers[start:end][words], borders), end
        self.grams = _distinct([p[0] for p in self.pieces])

    def _take(self, texts: list[bytes], words: list[pa.Array]) -> None:
        found, borders = _words(texts)
        found = found.dictionary_encode()
        words.append(found.dictionary)
        self.encoded.append((found.indices.to_numpy(), borders))
        inside, distinct = [], []
        for gram in grams_of(*texts):
            packed = (gram << 16 | np.arange(len(gram))).view(np.uint64)
            packed.sort()
            keys = (packed >> np.uint64(16)).view(np.int64)
            first = _first(keys)
            distinct.append(keys[first])
            inside.append((np.diff(first, append=len(keys)), packed.astype(np.uint16)))
        grams = _distinct(distinct)
        which = np.empty(sum(len(places) for _, places in inside), np.int32)
        start = 0
        for keys, (times, places) in zip(distinct, inside):
            which[start : start + len(places)][places] = np.repeat(np.searchsorted(grams, keys), times)
            start += len(places)
        self.pieces.append((grams, which))

    def word_sums(self, worth: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Of each text its words, those worth something, and the sum of their worth, which is given by their numbers."""
        for words, borders in self.encoded:
            values = worth[words]
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                yield b - a, int(np.count_nonzero(values[a:b])), math.fsum(values[a:b].tolist())

    def sums(self, p: np.ndarray) -> np.ndarray:
        """Of each text the sum of its grams' values, which are given in the order of ``grams``."""
        out, start = np.zeros(len(self.starts) - 1), 0
        for grams, which in self.pieces:
            here = p[np.searchsorted(self.grams, grams)]
            for at in range(0, len(which), TOGETHER):
                values = here[which[at : at + TOGETHER]]
                first = np.searchsorted(self.starts, start, "right") - 1
                last = np.searchsorted(self.starts, start + len(values), "left")
                out[first:last] += np.add.reduceat(values, np.maximum(self.starts[first:last] - start, 0))
                start += len(values)
        return out


def _rows(number: int, start: int, grams: np.ndarray | None, counts: np.ndarray, words: pa.Array | None) -> pa.RecordBatch:
    n = len(counts)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, number, np.int64)), pa.array(np.arange(start, start + n, dtype=np.int32)),
        pa.nulls(n, pa.int64()) if grams is None else pa.array(grams),
        pa.nulls(n, pa.binary()) if words is None else words.cast(pa.binary()), pa.array(counts),
    ], names=["batch", "at", "gram", "word", "n"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a batch in compressed blocks, which shuffle at a third of the size."""
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        for number in np.unique(numbers):
            rows = pa.table(batch.select(["id", "t", "train"])).filter(pa.array(numbers == number))
            step = max(1, int(len(rows) * BLOCK_BYTES / max(1, rows.nbytes)))
            for start in range(0, len(rows), step):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as stream:
                    stream.write_table(rows.slice(start, step).combine_chunks())
                block = zlib.compress(sink.getvalue(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([block], pa.binary())], names=["batch", "block"])


def _unpack(blocks: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(zlib.decompress(b.as_py())).read_all() for b in blocks.column("block")])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The facts (batch, at, kind, value) of a partition, packed by batch: they shuffle at a fourth of the size."""
    held, size = [], 0

    def packed() -> Iterator[pa.RecordBatch]:
        number, at, kind, value = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((at, kind == GRAM, number))
        number, at, kind, value = number[order], at[order], kind[order], value[order]
        edges = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
        blocks = [_pack_facts(at[a:b], kind[a:b], value[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(number[edges[:-1]]), pa.array(blocks, pa.binary())], names=["batch", "facts"])

    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size > FACTS:
            yield from packed()
            held, size = [], 0
    if size:
        yield from packed()


def _pack_facts(at: np.ndarray, kind: np.ndarray, value: np.ndarray) -> bytes:
    gram = kind == GRAM
    parts = (
        np.array([gram.sum(), len(at) - gram.sum()], np.int32), np.diff(at[gram], prepend=0).astype(np.int32), value[gram].astype(np.float32),
        np.diff(at[~gram], prepend=0).astype(np.int32), value[~gram].astype(np.int64), kind[~gram].astype(np.int8),
    )
    return zlib.compress(b"".join(p.tobytes() for p in parts), 1)


def _unpack_facts(block: bytes) -> tuple[np.ndarray, ...]:
    """(gram places, log probabilities, word places, counts, kinds)."""
    data, out, start = zlib.decompress(block), [], 8
    grams, words = np.frombuffer(data, np.int32, 2)
    for n, form in ((grams, np.int32), (grams, np.float32), (words, np.int32), (words, np.int64), (words, np.int8)):
        out.append(np.frombuffer(data, form, n, start))
        start += int(n) * np.dtype(form).itemsize
    return np.cumsum(out[0]), out[1], np.cumsum(out[2]), out[3], out[4]


class _Level:
    """Counts of one order: symbols by context, and of each context the sum and number of its symbols."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams, self.counts = _merged([(grams, counts)])
        parents = self.grams >> 8
        self.first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if len(parents) else np.zeros(0, np.int64)
        self.contexts = parents[self.first]
        self.n = np.add.reduceat(self.counts, self.first) if len(parents) else self.counts
        self.d = np.diff(np.r_[self.first, len(parents)])

    def shorter(self, order: int) -> _Level:
        """The level below: each symbol counts once per context of this level that it follows."""
        return _Level(_cut(self.grams, order), np.ones_like(self.counts))

    def leave(self, below: _Level, order: int) -> None:
        """What each context leaves of the one a byte shorter when its symbols are excluded there: sum and number of symbols."""
        taken = below.count(_cut(self.grams, order))
        at = below.context(_cut(self.contexts, order - 1))
        self.left_n = below.n[at] - (np.add.reduceat(taken, self.first) if len(self.first) else taken)
        self.left_d = below.d[at] - self.d

    def count(self, grams: np.ndarray) -> np.ndarray:
        return _look_up(self.grams, self.counts, grams)

    def context(self, contexts: np.ndarray) -> np.ndarray:
        """Places of contexts, -1 for unknown ones."""
        return _look_up(self.contexts, np.arange(len(self.contexts)) + 1, contexts) - 1


def _cut(numbers: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes."""
    return numbers & ((1 << 8 * size) - 1)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def log_probabilities(wanted: np.ndarray, grams: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each gram's last byte in its context.

    ``grams`` and ``counts`` are the training counts of branches that hold the grams ``wanted``; ``top`` has the counts of order ``TOP``.
    """
    levels = {ORDER: _Level(grams[counts > 0], counts[counts > 0]), TOP: _Level(*top)}
    for order in [*range(ORDER - 1, TOP, -1), *range(TOP - 1, -1, -1)]:
        levels[order] = levels[order + 1].shorter(order + 1)
    for order in range(1, ORDER + 1):
        levels[order].leave(levels[order - 1], order)
    out, open_, longer = np.zeros(len(wanted)), np.ones(len(wanted), bool), np.full(len(wanted), -1)
    for order in range(ORDER, -1, -1):
        level = levels[order]
        here, count = level.context(_cut(wanted >> 8, order)), level.count(_cut(wanted, order + 1))
        n, d = (np.append(v, 0)[here].astype(float) for v in (level.n, level.d))
        excluded = longer >= 0
        if excluded.any():
            n[excluded], d[excluded] = (v[longer[excluded]] for v in (levels[order + 1].left_n, levels[order + 1].left_d))
        known = open_ & (here >= 0)
        hit, miss = known & (count > 0), known & (count == 0) & (d > 0)
        out[hit] += np.log10((count[hit] - 0.5) / n[hit])
        out[miss] += np.log10(d[miss] / (2 * n[miss]))
        open_ &= ~hit
        longer = here
    out[open_] -= math.log10(max(1, SYMBOLS - len(levels[0].grams)))
    return out


def score_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    All rows that are not ``held_out`` are learnt from. ``base_score`` is that of single words and one end per text, smoothed by
    one; ``score`` is log10 of the probability that the byte model gives the text, A-Z lower-cased, and its end. A null text
    counts as empty and consists of its end. Rows and ids may repeat; no rows give no rows; other columns are ignored.
    """
    stored = Stored(docs.sparkSession)
    try:
        with pinned_splits(docs.sparkSession):
            return _scored(docs, doc_id, text, batch_bytes, stored)
    finally:
        stored.drop()


def _scored(docs: DataFrame, doc_id: str, text: str, batch_bytes: int, stored: Stored) -> DataFrame:
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), (~held_out(doc_id)).alias("train"),
        F.input_file_name().alias("file"), F.input_file_block_start().alias("at"),
    )
    splits = rows.groupBy("file", "at").agg(
        F.sum(F.octet_length("t")).alias("bytes"), F.count(F.when(F.col("train"), 1)).alias("ends")
    ).agg(F.max("bytes").alias("largest"), F.sum("ends").alias("ends"), F.max(F.col("file") == "").alias("unnamed")).first()
    # A batch is a split of the input, or a part of one that is too large, by id and text: every evaluation deals alike. Rows that are
    # not read from files, which have no split, are shuffled to their batches to be counted.
    parts = max(1, math.ceil((splits["largest"] or 0) / batch_bytes))
    number = F.xxhash64("file", "at", F.pmod(F.xxhash64("id", "t"), F.lit(parts)))
    dealt = rows.select(number.alias("batch"), "id", "t", "train")
    texts = dealt.select("batch", "t", "train")
    if splits["unnamed"]:
        texts = texts.repartition(max(parts, shuffle_partitions(docs)), "batch")
    counted = stored.keep(texts.mapInArrow(_count, "batch long, at int, gram long, word binary, n long"), "lm_counts")

    grams = stored.keep(counted.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "lm_grams")
    seen = grams.where("n > 0").select(F.col("gram").bitwiseAND((1 << 8 * (TOP + 2)) - 1).alias("gram")).distinct()
    shared = seen.groupBy(F.col("gram").bitwiseAND((1 << 8 * (TOP + 1)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    shared = shared.toArrow()  # at most 2^24 rows
    top = tuple(shared.column(i).to_numpy() for i in (0, 1))
    top = docs.sparkSession.sparkContext.broadcast(tuple(column[np.argsort(top[0])] for column in top))

    def branches(table: pa.Table) -> pa.Table:
        keys, counts = table.column("gram").to_numpy(), table.column("n").to_numpy()
        return pa.table({"gram": keys, "p": log_probabilities(keys, keys, counts, top.value).astype(np.float32)})

    branch = F.shiftrightunsigned("gram", 8).bitwiseAND((1 << 8 * (TOP + 1)) - 1)
    groups = max(1, math.ceil(grams.count() / GROUP))
    known = grams.groupBy(F.pmod(F.xxhash64(branch), F.lit(groups)).alias("group")).applyInArrow(branches, "gram long, p float")

    needs = counted.where("gram is not null").select("batch", "at", "gram").join(known, "gram").select(
        "batch", "at", F.lit(GRAM).cast("byte").alias("kind"), F.col("p").cast("double").alias("value")
    )
    whole = Window.partitionBy("word")
    asked = counted.where("word is not null").select(
        "batch", "at", F.when(F.row_number().over(whole.orderBy("batch")) == 1, FIRST).otherwise(WORD).cast("byte").alias("kind"),
        F.sum("n").over(whole).cast("double").alias("value"),
    )
    facts = needs.unionByName(asked).mapInArrow(_gather, "batch long, facts binary")

    def score(key: tuple, blocks: pa.Table, known: pa.Table) -> pa.Table:
        texts = _unpack(blocks)
        train = texts.column("train").to_numpy(zero_copy_only=False)
        asked = _Asked([_encoded(t) for t in texts.column("t")])
        texts = texts.drop_columns(["t"])
        p, c, new = np.zeros(len(asked.grams)), np.zeros(len(asked.in_order)), 0
        for block in known.column("facts"):
            gram_at, gram_p, word_at, word_c, kinds = _unpack_facts(block.as_py())
            p[gram_at], c[asked.in_order[word_at]] = gram_p, word_c
            new += int(((kinds == FIRST) & (word_c > 0)).sum())
        rows = [(*words, score) for words, score in zip(asked.word_sums(np.log10(c + 1)), asked.sums(p).tolist())]
        column = lambda i, form: pa.array([r[i] for r in rows], form)
        return pa.table({
            "id": texts.column("id"), "held_out": pc.invert(texts.column("train")), "n_words": column(0, pa.int64()), "n_seen": column(1, pa.int64()),
            "worth": column(2, pa.float64()), "score": column(3, pa.float64()), "new": pa.array([new] + [0] * (len(rows) - 1), pa.int64()),
            "trained": pa.array(np.where(train, column(0, pa.int64()).to_numpy(), 0)),
        })

    schema = "id long, held_out boolean, n_words long, n_seen long, worth double, score double, new long, trained long"
    blocks = dealt.mapInArrow(_pack, "batch long, block binary")
    scored = cut(blocks.groupBy("batch").cogroup(facts.groupBy("batch")).applyInArrow(score, schema))
    sums = scored.agg(F.sum("trained").alias("words"), F.sum("new").alias("distinct")).first()
    ends = splits["ends"] or 0
    tokens, distinct = (sums["words"] or 0) + ends, (sums["distinct"] or 0) + (ends > 0)
    base = F.col("worth") + math.log10(ends + 1) - (F.col("n_words") + 1) * math.log10(tokens + distinct + 1)
    return scored.select(
        "id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_seen") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
