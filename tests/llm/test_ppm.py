import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlens.llm import ppm

SCHEMA = "doc_id long, text string, n_tokens string"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows):
    """Word counts, and the trie as plain dictionaries."""
    train = [(t or "").encode().lower() for i, t in rows if not held_out(i)]
    words = Counter(w for t in train for w in t.split())
    n, v, ends = sum(words.values()) + len(train), len(words) + (len(train) > 0), len(train)
    trie = defaultdict(Counter)
    for t in train:
        data = bytes([0xFF]) * 5 + t + bytes([0xFE])
        for at in range(5, len(data)):
            trie[data[at - 5 : at]][data[at]] += 1
    for order in range(4, -1, -1):  # a shorter context counts the longer ones that a symbol follows
        for context in [c for c in trie if len(c) == order + 1]:
            for symbol in trie[context]:
                trie[context[1:]][symbol] += 1
    out = []
    for i, t in rows:
        t = (t or "").encode().lower()
        split = t.split()
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [*(words[w] for w in split), ends])
        data, score = bytes([0xFF]) * 5 + t + bytes([0xFE]), 0.0
        for at in range(5, len(data)):
            barred, p = set(), 1.0
            for order in range(5, -1, -1):
                seen = {s: c for s, c in trie.get(data[at - order : at], {}).items() if s not in barred}
                if not seen:
                    continue
                total = sum(seen.values())
                if data[at] in seen:
                    p *= (seen[data[at]] - 0.5) / total
                    break
                p *= len(seen) / 2 / total
                barred |= set(seen)
            else:
                p /= max(1, 257 - len(barred))
            score += math.log10(p)
        out.append((i, held_out(i), len(split) + 1, sum(words[w] > 0 for w in split) + (ends > 0), n, base, score))
    return out


def compare(spark, rows, **settings):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = sorted(map(tuple, ppm.score_texts(df, **settings).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], rel=1e-6)


def test_equals_plain_dictionaries(spark):
    texts = ["the cat sat on the mat", "the cat ate the rat", "Der Hund  saß\nda", "zzz qqq", "the the the the", "", None, "é日本", "a" * 300]
    rows = [(i, texts[i % len(texts)] if i < 30 else f"{texts[i % 5]} {i}") for i in range(60)]
    assert any(held_out(i) for i, _ in rows)
    compare(spark, rows)
    compare(spark, rows, batch_bytes=100)  # many batches


def test_odd_rows(spark):
    compare(spark, [(None, "a b"), (None, "a b"), (5, "x" * 50_000), (5, "x" * 50_000), (6, "tie tie"), (7, " \t\n")])


def test_nothing_to_learn_from(spark):
    lone = next(i for i in range(100) if held_out(i))
    compare(spark, [(lone, "abc")])
    compare(spark, [(lone, None)])


def test_empty_table(spark):
    assert ppm.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cores_lost_between_the_passes(spark, tmp_path, monkeypatch):
    rows = [(i, f"the cat {i} sat " * (i % 50)) for i in range(600)]
    path, leaves, cost = str(tmp_path / "docs"), "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"
    spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).coalesce(1).write.parquet(path)
    keep = ppm.Stored.keep

    def keep_and_lose(self, df, name):
        kept = keep(self, df, name)
        spark.conf.set(leaves, "1")
        return kept

    monkeypatch.setattr(ppm.Stored, "keep", keep_and_lose)
    before = spark.conf.get(cost)
    spark.conf.set(cost, "1")
    try:
        got = sorted(map(tuple, ppm.score_texts(spark.read.parquet(path)).collect()))
    finally:
        spark.conf.set(cost, before)
        spark.conf.unset(leaves)
    want = sorted(brute(rows))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=1e-6)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_long_text_in_chunks(monkeypatch):
    whole = [int(g) for part in ppm.grams_of(b"abcdefghij") for g in part]
    monkeypatch.setattr(ppm, "CHUNK", 3)
    assert [int(g) for part in ppm.grams_of(b"abcdefghij") for g in part] == whole and len(whole) == 11


def test_sums_across_chunks(monkeypatch):
    texts = [b"the cat", b"", b"a" * 40, b"", b"the mat", "é日本".encode()]
    of_text = [np.concatenate(list(ppm.grams_of(t))) for t in texts]
    for chunk, together in ((0xFFFF, 1 << 20), (7, 10), (3, 1)):
        monkeypatch.setattr(ppm, "CHUNK", chunk)
        monkeypatch.setattr(ppm, "TOGETHER", together)
        asked = ppm._Asked(texts)
        assert asked.grams.tolist() == sorted({g for t in of_text for g in t.tolist()})
        values = dict(zip(asked.grams.tolist(), range(1, 1000)))
        assert asked.sums(np.arange(1.0, len(asked.grams) + 1)).tolist() == [sum(values[g] for g in t.tolist()) for t in of_text]


def test_counts_beyond_16_bits(monkeypatch):
    for fold in (1 << 21, 10):
        monkeypatch.setattr(ppm, "FOLD", fold)
        tally = ppm._Tally()
        tally.add(b"a" * 200_000, True)
        tally.add(b"a" * 10 + b"b", False)
        rows = [r for b in tally.rows(1) for r in b.to_pylist()]
        counts = {r["gram"]: r["n"] for r in rows if r["gram"] is not None}
        assert counts[int.from_bytes(b"aaaaaa")] == 200_000 - 5 and counts[int.from_bytes(b"aaaaab")] == 0


def test_better_than_words_on_held_out_texts(spark):
    found = ppm.score_texts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    row = found.where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert row["s"] > row["b"]


def test_words_are_cut_at_six_characters():
    texts = ["".join(f"a{chr(c)}b" for c in [*range(0, 128), 0x85, 0xA0, 0x2028, 0x3000]).encode(), b"", b" \t", b"\x0b x\x1c\x0c", b"y" * 1000]
    words, borders = ppm._words(texts)
    got = [[w.encode() for w in words[a:b].to_pylist()] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
    assert got == [t.split() for t in texts] and len(got[0]) == 6 + 1
