"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, in numpy.

A word, or a piece of a very long one, enters as the embedding of its hash next to the mean embedding of its character sequences. Two recurrent passes read a
window of words, attention pools their states, and a logistic unit scores the window. Windows overlap by half and a text's
score is that of its highest window, so a long text is judged like a short one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from defectlens.llm.common import all_columns, held, small_batches, unused

WINDOW, STRIDE = 32, 16  # words
WORD = re.compile(r"[^\W_]+")
LONGEST, SHARED = 40, 4  # characters; every sequence of up to five lies in one piece
TEXT_PART = 1 << 18  # words of a text whose windows are scored at a time
KNOWN = 250_000  # words whose inputs a worker remembers; then it starts afresh
ROWS = 2048  # windows that pass the network at once


@dataclass(frozen=True)
class Settings:
    """``positives``, ``negatives`` and ``max_bytes`` bound the labelled texts that are fitted: so many, none longer."""

    positives: int = 500
    negatives: int = 1500
    max_bytes: int = 20_000
    buckets: int = 1 << 16
    size: int = 8  # of embeddings, states and attention
    epochs: int = 6
    first_epochs: int = 2  # that take any window for a positive one; the later ones take the highest
    batch: int = 32
    rate: float = 0.01
    seed: int = 7


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased; a longer one is cut into pieces of ``LONGEST`` characters that overlap by ``SHARED``."""
    found = WORD.findall(text.lower())
    if not found or max(map(len, found)) <= LONGEST:
        return found
    step = LONGEST - SHARED
    return [w[a : a + LONGEST] for w in found for a in range(0, max(1, len(w) - SHARED), step)]


def _hash(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


def pieces_of(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each word) of the sequences of 3 to 5 characters of words with their ends marked, word by word.

    An empty word is a space.
    """
    marked = [f"^{w or ' '}$" for w in words]
    sizes = np.array([len(m) for m in marked])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner, ends = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes)
    hashes, owners = [], []
    for n in (3, 4, 5):
        inside = np.flatnonzero(np.arange(len(codes)) + n <= ends)
        mixed = np.full(len(inside), n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ codes[inside + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        hashes.append((mixed % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return np.concatenate(hashes)[order], np.concatenate(([0], np.cumsum(counts)[:-1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows_of(n_words: int) -> list[tuple[int, int]]:
    """Spans of overlapping windows that cover every word."""
    last = max(0, n_words - WINDOW)
    starts = [*range(0, last, STRIDE), last]
    return [(s, min(n_words, s + WINDOW)) for s in starts]


class Network:
    """The parameters, the pass through the network and its gradient."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings
        rng, d, b = np.random.default_rng(settings.seed), settings.size, settings.buckets
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": draw(0.02, b, d), "char": draw(0.02, b, d), "in": draw(0.4, 2, 2 * d, 3 * d), "rec": draw(0.3, 2, d, 3 * d),
            "bias": np.zeros((2, 3 * d), np.float32), "att": draw(0.3, 2 * d, d), "att_v": draw(0.5, d), "out": draw(0.5, 2 * d),
            "out_b": np.full(1, -1, np.float32),
        }

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, word hashes, piece hashes, first piece of each word)."""
        b = self.settings.buckets
        if not words:
            return np.zeros((0, 2 * self.settings.size), np.float32), *[np.zeros(0, np.int64)] * 3
        hashes = np.array([_hash(w, b) for w in words])
        flat, first = pieces_of(words, b)
        sizes = np.diff(np.r_[first, len(flat)])
        chars = np.add.reduceat(self.p["char"][flat], first, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][hashes], chars), axis=1), hashes, flat, first

    def project(self, inputs: np.ndarray) -> np.ndarray:
        """What the recurrent passes read of each word, (directions, words, gates)."""
        return np.stack([inputs @ self.p["in"][k] + self.p["bias"][k] for k in (0, 1)])

    def _pass(self, table: np.ndarray, at: np.ndarray, mask: np.ndarray, k: int, keep: list | None) -> np.ndarray:
        """States of one direction, (steps, windows, size)."""
        d, u = self.settings.size, self.p["rec"][k]
        steps = range(len(at)) if k == 0 else range(len(at) - 1, -1, -1)
        h, states = np.zeros((at.shape[1], d), table.dtype), np.empty((*at.shape, d), table.dtype)
        for t in steps:
            read, inner = table[k].take(at[t], axis=0), h @ u
            gates = read[:, : 2 * d] + inner[:, : 2 * d]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :d], gates[:, d:]
            new = r * inner[:, 2 * d :]
            new += read[:, 2 * d :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, h, inner, z, r, new))
            h = h + mask[t][:, None] * (1 - z) * (new - h)
            states[t] = h
        return states

    def forward(self, table: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows ``at`` (steps, windows) into the projected words of ``table``; ``mask`` is 0 where there is no word."""
        kept = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._pass(table, at, mask, k, kept[k]) for k in (0, 1)], axis=2)
        seen = np.tanh(states @ self.p["att"])
        weight = np.exp(np.clip(seen @ self.p["att_v"], -30, 30)) * mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tb,tbd->bd", weight, states)
        if keep is not None:
            keep.update(kept=kept, states=states, seen=seen, weight=weight, pooled=pooled)
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def backward(self, table_size: int, at: np.ndarray, mask: np.ndarray, keep: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients, given the loss's slope by logit; "table" is that of the projected words."""
        p, d = self.p, self.settings.size
        states, seen, weight, pooled = keep["states"], keep["seen"], keep["weight"], keep["pooled"]
        g = {"out": slope @ pooled, "out_b": slope.sum(keepdims=True)}
        to_pooled = slope[:, None] * p["out"]
        to_weight = np.einsum("tbd,bd->tb", states, to_pooled)
        to_score = weight * (to_weight - (weight * to_weight).sum(0))
        to_seen = to_score[:, :, None] * p["att_v"] * (1 - seen**2)
        g["att_v"] = np.einsum("tb,tba->a", to_score, seen)
        g["att"] = np.einsum("tbd,tba->da", states, to_seen)
        to_states = weight[:, :, None] * to_pooled + to_seen @ p["att"].T
        g["rec"], g["table"] = np.zeros_like(p["rec"]), np.zeros((2, table_size, 3 * d), np.float32)
        for k in (0, 1):
            to_h = np.zeros_like(pooled[:, :d])
            for t, h, inner, z, r, new in reversed(keep["kept"][k]):
                to_h = to_h + to_states[t, :, k * d : (k + 1) * d]
                on = mask[t][:, None]
                to_new = on * to_h * (1 - z) * (1 - new**2)
                to_z = on * to_h * (h - new) * z * (1 - z)
                to_r = to_new * inner[:, 2 * d :] * r * (1 - r)
                to_read = np.concatenate((to_z, to_r, to_new), axis=1)
                to_inner = np.concatenate((to_z, to_r, to_new * r), axis=1)
                g["rec"][k] += h.T @ to_inner
                np.add.at(g["table"][k], at[t], to_read)
                to_h = to_h * (1 - on * (1 - z)) + to_inner @ p["rec"][k].T
        return g

    def step(self, texts: list[list[str]], labels: np.ndarray, state: dict, highest: bool, rng: np.random.Generator) -> None:
        """One step of Adam on one window of each text."""
        vocab = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        inputs, hashes, flat, first = self.inputs(list(vocab))
        table = self.project(inputs)
        spans = [(i, a, b) for i, t in enumerate(texts) for a, b in windows_of(len(t))]
        at, mask = _layout([[vocab[w] for w in texts[i][a:b]] for i, a, b in spans])
        owner = np.array([i for i, _, _ in spans])
        rank = self.forward(table, at, mask) if highest else rng.random(len(spans))
        order = np.lexsort((rank, owner))
        chosen = order[np.r_[owner[order][1:] != owner[order][:-1], True]]
        at, mask = at[:, chosen], mask[:, chosen]
        keep: dict = {}
        slope = (sigmoid(self.forward(table, at, mask, keep)) - labels).astype(np.float32) / len(texts)
        g = self.backward(table.shape[1], at, mask, keep, slope)
        to_table = g.pop("table")
        g["in"] = np.stack([inputs.T @ to_table[k] for k in (0, 1)])
        g["bias"] = to_table.sum(1)
        to_inputs = sum(to_table[k] @ self.p["in"][k].T for k in (0, 1))
        d = self.settings.size
        sizes = np.diff(np.r_[first, len(flat)])
        used = np.flatnonzero(np.abs(to_inputs).sum(1))  # words of the chosen windows
        places = np.repeat(np.arange(len(first)), sizes)
        in_use = np.isin(places, used)
        rows = {
            "word": _summed(hashes[used], to_inputs[used, :d]),
            "char": _summed(flat[in_use], (to_inputs[:, d:] / sizes[:, None])[places[in_use]]),
        } | {name: (slice(None), slope) for name, slope in g.items()}
        state["n"] = n = state.get("n", 0) + 1
        for name, (at, slope) in rows.items():  # embeddings without a gradient rest
            m, v = state.setdefault(name, (np.zeros_like(self.p[name]), np.zeros_like(self.p[name])))
            m[at], v[at] = 0.9 * m[at] + 0.1 * slope, 0.99 * v[at] + 0.01 * slope**2
            self.p[name][at] -= self.settings.rate * (m[at] / (1 - 0.9**n)) / (np.sqrt(v[at] / (1 - 0.99**n)) + 1e-6)


def _summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sum of the values of each."""
    rows, place = np.unique(at, return_inverse=True)
    sums = np.stack([np.bincount(place, values[:, i], len(rows)) for i in range(values.shape[1])], axis=1)
    return rows, sums.astype(np.float32)


def _layout(windows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as (steps, windows) with a mask; shorter ones are filled up with word 0."""
    sizes = np.array([len(w) for w in windows])
    mask = (np.arange(WINDOW)[:, None] < sizes).astype(np.float32)
    at = np.zeros((len(windows), WINDOW), np.int64)
    at[mask.T > 0] = [i for w in windows for i in w]
    return at.T, mask


class Model:
    """A trained network, or the share of label 1 where one label has no example."""

    def __init__(self, settings: Settings, texts: list[str], labels: list[int]) -> None:
        self.share, self.network = (sum(labels) / len(labels) if labels else 0.0), None
        if 0 < sum(labels) < len(labels):
            self._fit(settings, [words_of(t) for t in texts], np.array(labels, np.float32))

    def _fit(self, settings: Settings, texts: list[list[str]], labels: np.ndarray) -> None:
        self.network, state, rng = Network(settings), {}, np.random.default_rng(settings.seed)
        texts = [t or [""] for t in texts]
        for epoch in range(settings.epochs):
            order = rng.permutation(len(texts))
            for start in range(0, len(order), settings.batch):
                part = order[start : start + settings.batch]
                self.network.step([texts[i] for i in part], labels[part], state, epoch >= settings.first_epochs, rng)


class Scorer:
    """Scores texts window by window; remembers what the network reads of a word."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        d = model.network.settings.size if model.network else 1
        self.table = np.zeros((2, KNOWN + TEXT_PART + 1, 3 * d), np.float32)

    def score_all(self, texts: list[str]) -> list[float]:
        if self.model.network is None:
            return [self.model.share] * len(texts)
        best = np.full(len(texts), -np.inf)
        ids: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        size = 0
        for i, text in enumerate(texts):
            words = words_of(text) or [""]
            step = TEXT_PART - TEXT_PART % STRIDE
            for start in range(0, max(1, len(words) - STRIDE), step):  # parts overlap as windows do
                part = words[start : start + step + WINDOW - STRIDE]
                if size + len(part) > TEXT_PART:
                    self._score(ids, owners, best)
                    ids, owners, size = [], [], 0
                ids.append(part)
                owners.append((i, len(part)))
                size += len(part)
        self._score(ids, owners, best)
        return sigmoid(best).tolist()

    def _score(self, parts: list[list[str]], owners: list[tuple[int, int]], best: np.ndarray) -> None:
        if not parts:
            return
        if len(self.known) > KNOWN:
            self.known.clear()
        known, network = self.known, self.model.network
        fresh = list({w for part in parts for w in part if w not in known})
        for start in range(0, len(fresh), 10_000):
            some = fresh[start : start + 10_000]
            self.table[:, len(known) : len(known) + len(some)] = network.project(network.inputs(some)[0])
            known.update(zip(some, range(len(known), len(known) + len(some))))
        flat = np.array([known[w] for part in parts for w in part])
        offset, starts, sizes, owner = 0, [], [], []
        for i, n in owners:
            for a, b in windows_of(n):
                starts.append(offset + a)
                sizes.append(b - a)
                owner.append(i)
            offset += n
        starts, sizes, owner = np.array(starts), np.array(sizes), np.array(owner)
        steps = np.arange(WINDOW)[:, None]
        for a in range(0, len(starts), ROWS):
            at = np.minimum(starts[a : a + ROWS] + steps, len(flat) - 1)
            mask = (steps < sizes[a : a + ROWS]).astype(np.float32)
            np.maximum.at(best, owner[a : a + ROWS], network.forward(self.table, flat[at], mask))


def held_out(doc_id: str = "doc_id"):
    """Rows whose label is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of a bounded sample of the labelled rows that are not held out: per label those with the smallest hash of the id.

    Labels other than 0 and 1, null ids and null texts take no part; an id with several labels counts as 1 if one is.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.max(label).alias("_label"))
    sample = known.where("_label = 1").orderBy(F.xxhash64("_id"), "_id").limit(settings.positives).union(
        known.where("_label = 0").orderBy(F.xxhash64("_id"), "_id").limit(settings.negatives)
    )
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    short = rows.where(F.octet_length("_text") <= settings.max_bytes)
    texts = short.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.max("_label").alias("_label"), F.min("_text").alias("_text"))
    found = sorted((r["_id"], r["_label"], r["_text"]) for r in texts.collect())  # bounded by the settings
    return Model(settings, [t for _, _, t in found], [y for _, y, _ in found])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 from ``threshold`` on), which replace columns of the same names.

    Every word of a text lies in a window. A null, empty or wordless text gets the score of an empty word. Rows may repeat; no
    rows give no rows.
    """
    name, out = _scored(docs, model, text)
    old = [c for c, column in zip(all_columns(docs), docs.columns) if column.lower() not in ("held_out", "score", "predicted")]
    return out.select(
        *old, held_out(doc_id).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= threshold).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs``, with its columns, but for those that score ``threshold`` or more."""
    name, out = _scored(docs, model, text)
    return out.where(F.col(name) < threshold).drop(name)


def _scored(docs: DataFrame, model: Model, text: str) -> tuple[str, DataFrame]:
    """``docs`` with the score in a column of a new name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    small_batches(docs.sparkSession)
    (name,), at = unused(docs, "score"), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(shared.value, lambda: Scorer(shared.value))
        for batch in batches:
            scores = scorer.score_all([t.as_py() or "" for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return name, docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
