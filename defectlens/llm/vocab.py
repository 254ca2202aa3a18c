"""Byte-level BPE vocabularies: reading the file, cutting texts into pre-tokens, plain merging."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import regex
from pyspark.sql import SparkSession

# Fixed value: the pre-token rule of byte-level BPE files, with white space as Unicode has it.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CUT = regex.compile(r"(?<=\P{White_Space})(?= \P{White_Space})")  # a pre-token always ends here
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
CHUNK = 1 << 20  # characters cut into pre-tokens at a time


def plain_rule() -> str:
    """``PRE_TOKEN`` for texts without characters beyond U+FFFF, its classes spelled out, so that the faster ``re`` can cut them."""
    letters = "".join(map(chr, range(0x10000)))
    spelled = lambda c: "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(rf"\p{{{c}}}+", letters))
    white, letter, number = map(spelled, ("White_Space", "L", "N"))
    rule = PRE_TOKEN.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{white}{letter}{number}]").replace(r"\P{White_Space}", f"[^{white}]")
    return rule.replace(r"\p{White_Space}", f"[{white}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")


def byte_letters() -> dict[str, int]:
    """The printable character that such files use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Token bytes by id, merges in order of rank, and special strings with their ids."""

    tokens: list[bytes]
    merges: dict[int, int]  # left id << 32 | right id -> rank
    merged: list[int]  # the resulting id by rank
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters, model = byte_letters(), data["model"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens = [b""] * (1 + max([*model["vocab"].values(), *special.values()]))
        for name, number in model["vocab"].items():
            if name not in special:
                tokens[number] = bytes(letters[c] for c in name)
        for name, number in special.items():
            tokens[number] = name.encode()
        merges, merged = {}, []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merges[model["vocab"][left] << 32 | model["vocab"][right]] = len(merged)
            merged.append(model["vocab"][left + right])
        return cls(tokens, merges, merged, special)

    @cached_property
    def byte_ids(self) -> list[int]:
        """The id of each single byte."""
        single = {t[0]: i for i, t in enumerate(self.tokens) if len(t) == 1}
        return [single[b] for b in range(256)]

    @cached_property
    def _cutter(self) -> regex.Pattern:
        return regex.compile(PRE_TOKEN)

    @cached_property
    def _plain_cutter(self) -> re.Pattern:
        return re.compile(plain_rule())

    @cached_property
    def _specials(self) -> regex.Pattern | None:
        names = sorted(self.special, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def pre_tokens(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Runs of pre-tokens, each with the special token that follows it or None; a long text comes in several runs."""
        parts = self._specials.split(text) if self._specials else [text]
        for i in range(0, len(parts), 2):
            start, part = 0, parts[i]
            findall = (self._cutter if ASTRAL.search(part) else self._plain_cutter).findall
            while len(part) - start > CHUNK and (found := CUT.search(part, start + CHUNK)):
                yield findall(part, start, found.start()), None
                start = found.start()
            yield findall(part, start), self.special[parts[i + 1]] if i + 1 < len(parts) else None

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token: the pair of lowest rank merges first, of equal ones the leftmost."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) > 64:
            return self._merge_long(ids)
        find, none = self.merges.get, len(self.merged)
        ranks = [find(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at : at + 2] = [self.merged[best]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = find(ids[at] << 32 | ids[at + 1], none)
            if at:
                ranks[at - 1] = find(ids[at - 1] << 32 | ids[at], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for pre-tokens of any length."""
        size = len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < size:
                found = self.merges.get(ids[i] << 32 | ids[j])
                if found is not None:
                    heapq.heappush(heap, (found, i, ids[i], ids[j]))

        for i in range(size - 1):
            offer(i)
        while heap:
            found, i, left, right = heapq.heappop(heap)
            if ids[i] != left or (j := after[i]) >= size or ids[j] != right:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j], after[i] = self.merged[found], -1, after[j]
            if after[j] < size:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [t for t in ids if t >= 0]


def share(spark: SparkSession, path: str):
    """The vocabulary of ``path``, read by the driver and broadcast; its size is that of the file."""
    return spark.sparkContext.broadcast(Vocabulary.read(path))
