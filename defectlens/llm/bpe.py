"""BPE encoding by a depth-first walk over the trie of the distinct words, and decoding."""

from __future__ import annotations

import struct
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from defectlens.llm.common import held, pieces, small_batches
from defectlens.llm.vocab import CHUNK, Vocabulary, share

CACHE = 150_000  # encoded words a worker remembers of late; those before them are kept until there are as many again
MEMORY = 100_000  # suffixes that it remembers; then it starts afresh
PAIRS = 400_000  # the same for pairs of tokens
PIECE = 3 << 19  # bytes of texts that are encoded, and sent back, at a time
TAIL = 4  # bytes by which the tokens that can come last are looked up; with more of them, fewer endings are met again


def _shared(a: bytes, b: bytes) -> int:
    """The length of their common prefix: numbers are compared at once, bytes one by one."""
    size = min(len(a), len(b))
    differ = int.from_bytes(a[:size]) ^ int.from_bytes(b[:size])
    return size - (differ.bit_length() + 7) // 8


class TrieEncoder:
    """Encodes words by the last token of each of their prefixes.

    A prefix's encoding is that of a shorter prefix and one more token, which is the only suffix that is a token and does
    not merge differently with the last token before it. So a node of the trie needs nothing but its last token, and what
    two words share is worked out once. The sorted distinct words are the trie in depth-first order: each keeps the nodes
    it has in common with the word before it.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.merges = vocabulary.merges
        special = set(vocabulary.special.values())
        self.ids = {t: i for i, t in enumerate(vocabulary.tokens) if t and i not in special}
        self.sizes = [len(t) for t in vocabulary.tokens]
        self.short = {t: (len(t), i) for t, i in self.ids.items() if len(t) <= TAIL}
        self.rank = [-1] * len(self.sizes)
        self.left, self.right = (array("q", [-1]) * len(self.sizes) for _ in range(2))  # the halves of a token
        for pair, rank in vocabulary.merges.items():
            token = vocabulary.merged[rank]
            self.rank[token], self.left[token], self.right[token] = rank, pair >> 32, pair & 0xFFFFFFFF
        self.alone = bytearray(len(self.sizes))  # 1 for tokens that come out whole when they are a word
        for i in self.ids.values():
            self.alone[i] = self.rank[i] < 0 or self._apart(self.left[i], self.right[i], self.rank[i])
        tails: dict[bytes, set[int]] = defaultdict(set)
        for token in self.ids:
            if len(token) > TAIL:
                tails[token[-TAIL:]].add(len(token))
        one: dict[tuple, tuple] = {}  # equal ones are held once
        self.tails = {tail: one.setdefault(found := tuple(sorted(sizes, reverse=True)), found) for tail, sizes in tails.items()}  # by its last bytes, the sizes of longer tokens
        self.near: dict[bytes, tuple] = {}
        self.pairs: dict[int, bool] = {}

    def _apart(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether two adjacent tokens come out as they are: no merge across their border has its turn before theirs.

        Undoes the later of the two tokens again and again, and looks at the pair that then meets at the border.
        """
        merges, rank = self.merges, self.rank
        while True:
            across = merges.get(left << 32 | right)
            if across is not None and across < limit:
                return False
            first, second = rank[left], rank[right]
            if first > second:
                limit, left = first, self.right[left]
            elif second >= 0:  # an equal merge further left comes first
                limit, right = second + 1, self.left[right]
            else:
                return True

    def _suffixes(self, tail: bytes) -> tuple:
        """Sizes of the tokens longer than ``TAIL`` that end in ``tail``, and size and token of each suffix of it that is one, long before short."""
        short = tuple(found for i in range(len(tail)) if (found := self.short.get(tail[i:])))
        found = self.tails.get(tail, ()), short
        if len(self.near) > MEMORY:
            self.near.clear()
        self.near[tail] = found
        return found

    def _meets(self, pair: int) -> bool:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        found = self.pairs[pair] = self._apart(pair >> 32, pair & 0xFFFFFFFF)
        return found

    def _last(self, word: bytes, end: int, last: list[int]) -> int:
        """The last token of ``word[:end]``, given those of its shorter prefixes. Written out, as it runs for every byte of every new word."""
        pairs = self.pairs
        tail = word[end - TAIL : end] if end > TAIL else word[:end]
        longer, short = self.near.get(tail) or self._suffixes(tail)
        for size in longer:
            if size <= end and (token := self.ids.get(word[end - size : end])) is not None:
                if size == end:
                    if self.alone[token]:
                        return token
                else:
                    pair = last[end - size] << 32 | token
                    if pairs[pair] if pair in pairs else self._meets(pair):
                        return token
        for size, token in short:
            if size == end:
                if self.alone[token]:
                    return token
            else:
                pair = last[end - size] << 32 | token
                if pairs[pair] if pair in pairs else self._meets(pair):
                    return token
        raise ValueError("not a complete byte vocabulary")

    def encode(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of each distinct word."""
        out, last, before, sizes = {}, [0], b"", self.sizes
        for word in sorted(set(words)):
            shared = _shared(before, word)
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                last.append(self._last(word, end, last))
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= sizes[last[at]]
            ids.reverse()
            out[word], before = ids, word
        return out


class TextEncoder:
    """Whole texts to packed ids (little-endian unsigned 32-bit) and back, with a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.trie = vocabulary, TrieEncoder(vocabulary)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words known before; those that are met again become known again
        self.open: list[bytes] = []  # of a text whose end has not come yet
        self.tokens = pa.array(vocabulary.tokens, pa.large_binary())
        self.special = {i: struct.pack("<I", i) for i in vocabulary.special.values()}

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids per text; the words of several texts go into one trie."""
        held, size = [], 0
        for text in texts:
            for run, special in self.vocabulary.pre_tokens(text):
                held.append((run, special, False))
                size += len(run)
                if size * 4 >= CHUNK:
                    yield from self._finish(held)
                    held, size = [], 0
            held.append(([], None, True))
        yield from self._finish(held)

    def _finish(self, held: list[tuple[list[str], int | None, bool]]) -> Iterator[bytes]:
        """The texts that end in these runs."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        words = set().union(*(run for run, _, _ in held)).difference(known)
        known.update((w, older[w]) for w in words.intersection(older))
        by_bytes = {w.encode("utf-8", "surrogatepass"): w for w in words.difference(older)}
        for data, ids in self.trie.encode(by_bytes).items():
            known[by_bytes[data]] = struct.pack(f"<{len(ids)}I", *ids)
        for run, special, ends in held:
            self.open.append(b"".join(map(known.__getitem__, run)))
            if special is not None:
                self.open.append(self.special[special])
            if ends:
                yield b"".join(self.open)
                self.open = []

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        ids = pa.Array.from_buffers(pa.uint32(), len(packed) // 4, [None, pa.py_buffer(packed)])
        joined = self.tokens.take(ids)
        _, borders, data = joined.buffers()
        size = struct.unpack_from("<q", borders, 8 * len(joined))[0] if len(joined) else 0
        return str(data[:size], "utf-8", "replace") if size else ""


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids, n_tokens) per row of ``docs``, in its order: ids are packed little-endian unsigned 32-bit integers.

    With ``decoded``, also the text decoded from the ids, in the same pass. The vocabulary file is that of ``path``. No special
    tokens are added; special strings inside a text become their token. A null text counts as empty and has no ids. Ids
    may be null or repeat; no rows give no rows; other columns are ignored.
    """
    shared = share(docs.sparkSession, path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(shared.value, lambda: TextEncoder(shared.value))
        for batch in pieces(batches, 1, PIECE):
            packed = list(encoder.encode_all(t.as_py() or "" for t in batch.column(1)))
            columns = [batch.column(0), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
            names = ["id", "ids", "n_tokens"]
            if decoded:
                columns.append(pa.array(map(encoder.decode, packed), pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, ids binary, n_tokens long" + ", decoded string" * decoded
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``, which it must not have yet; null ids give a null text."""
    shared = share(encoded.sparkSession, path)
    small_batches(encoded.sparkSession)
    schema, at = encoded.select("*").schema.add("decoded", "string"), encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(shared.value, lambda: TextEncoder(shared.value))
        for batch in pieces(batches, at, PIECE):
            texts = [None if p.as_py() is None else encoder.decode(p.as_py()) for p in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
