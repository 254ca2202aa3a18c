import random
import struct
from os.path import commonprefix

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from defectlens.llm import bpe, common, tokencount
from defectlens.llm.vocab import Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, id string, ids string, n_tokens string, n_bytes string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(PATH)


def texts():
    rng = random.Random(3)
    letters = "abcdeth n  \t\n'.,019ABéçñ日😀\x1c\x85\xa0ſ-=_/\\|<>"
    fixed = ["", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "   ", "a   b\n\n c ", "'s 'LL don't we've", "a" * 3000, " " * 2000 + "x",
             "ab" * 4000, "\r\n\r\n", "日本語テキスト", "é" * 300, "\x00\x01", " the the the", "hello" * 500]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(800)]


def test_encodes_as_the_library(vocabulary, library, monkeypatch):
    want = [e.ids for e in library.encode_batch(texts(), add_special_tokens=False)]
    pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    encoder = bpe.TextEncoder(vocabulary)
    assert list(encoder.encode_all(texts())) == [pack(w) for w in want]
    assert [encoder.decode(pack(w)) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]
    broken = [want[12][:2], [50256, 160], [255]]
    assert [encoder.decode(pack(w)) for w in broken] == [library.decode(w, skip_special_tokens=False) for w in broken]
    for name, value in (("CHUNK", 50), ("CACHE", 20), ("MEMORY", 10), ("PAIRS", 10)):
        monkeypatch.setattr(bpe, name, value)
    monkeypatch.setattr("defectlens.llm.vocab.CHUNK", 50)
    assert list(bpe.TextEncoder(vocabulary).encode_all(texts())) == [pack(w) for w in want]


def test_plain_rule_cuts_as_the_full_one(vocabulary):
    every = "".join(map(chr, range(0x10000)))
    rng = random.Random(5)
    for text in [every, *texts(), *("".join(rng.choices(every, k=300)) for _ in range(50)), " ".join(every)]:
        if text.isascii() or max(text) < "\U00010000":
            assert vocabulary._plain_cutter.findall(text) == vocabulary._cutter.findall(text)
            assert vocabulary._plain_cutter.findall(text, 3, 40) == vocabulary._cutter.findall(text, 3, 40)


def test_shared_prefix():
    words = sorted({b"", b"a", b"\x00", b"\x00\x00", b"ab", b"abc", b"abd", b"\xff" * 40, b"\xff" * 39 + b"\x00"})
    assert all(bpe._shared(a, b) == len(commonprefix((a, b))) for a in words for b in words)


def test_counts_as_the_library(vocabulary, library, monkeypatch):
    want = [len(e.ids) for e in library.encode_batch(texts(), add_special_tokens=False)]
    whole = tokencount.whole_tokens(vocabulary)
    counting = tokencount.Counting(vocabulary, whole)
    assert [counting.count(t) for t in texts()] == want
    monkeypatch.setattr(tokencount, "CACHE", 5)
    assert [counting.count(t) for t in texts()] == want
    sample = random.Random(1).sample(sorted(whole), 500)
    assert all(library.encode(w, add_special_tokens=False).ids == [library.token_to_id(library.encode(w).tokens[0])] for w in sample if len(vocabulary._cutter.findall(w)) == 1)


def test_prefixes_are_walked_once(vocabulary, monkeypatch):
    trie, calls = bpe.TrieEncoder(vocabulary), []
    real = bpe.TrieEncoder._last
    monkeypatch.setattr(bpe.TrieEncoder, "_last", lambda self, word, end, last: calls.append(word[:end]) or real(self, word, end, last))
    words = [b"tion", b"tional", b"tionally", b"ti", b"tional"]
    assert trie.encode(words)[b"tionally"] == vocabulary.merge(b"tionally")
    assert len(calls) == len(set(calls)) == len(b"tionally")


def test_every_token_of_the_file_reads_back(vocabulary):
    assert bpe.TextEncoder(vocabulary).decode(struct.pack("<2I", 50256, 0)) == "<|endoftext|>!"


def test_tables(spark, library):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (None, "x"), (3, None), (4, ""), (5, "é " * 600), (6, "a<|endoftext|>")]
    df = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows), key=str)
    out = bpe.encode(df, PATH, decoded=True)
    got = sorted(((r["id"], list(struct.unpack(f"<{r['n_tokens']}I", r["ids"])), r["decoded"]) for r in out.collect()), key=str)
    assert got == want
    again = bpe.decode(out.drop("decoded").withColumn("ids", F.when(F.col("id") != 3, F.col("ids"))), PATH)
    assert sorted((r["decoded"] for r in again.collect()), key=str) == sorted((None if i in (3, None) else t for i, _, t in want), key=str)
    counted = sorted(((r["id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(df, PATH).collect()), key=str)
    assert counted == sorted(((i, len(t.encode()), len(ids), len(ids) > 512) for i, ids, t in want), key=str)
    nothing = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(nothing, PATH).count() == tokencount.count_tokens(nothing, PATH).count() == 0


def test_rows_go_through_in_pieces(spark):
    """What a worker holds of its input and output is bounded in bytes, not only in rows."""
    column = [None, "", "ab", "é" * 4, "x" * 50, "", "y", None, "zz"]
    batch = pa.record_batch([pa.array(range(len(column))), pa.array(column)], names=["id", "t"])
    got = [p.column(1).to_pylist() for p in common.pieces(iter([batch, batch.slice(0, 0), batch.slice(2)]), 1, 10)]
    want = [[None, "", "ab", "é" * 4], ["x" * 50, ""], ["y", None, "zz"], ["ab", "é" * 4], ["x" * 50, ""], ["y", None, "zz"]]
    assert sum(got, []) == sum(want, []) and all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10 for p in got)

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    out = bpe.encode(df, PATH, decoded=True)
    sizes = df.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) < 5 << 20
    assert out.select(F.count("id"), F.min("n_tokens"), F.max("n_tokens"), F.countDistinct("decoded")).first()[:] == (3000, 1001, 1001, 1)
    spark.conf.set(name, "2m")
    bpe.encode(df, PATH)
    assert spark.conf.get(name) == "2m"  # the session's own size stays
    spark.conf.unset(name)


def test_words_met_again_stay_known(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    encoder, asked = bpe.TextEncoder(vocabulary), []
    real = encoder.trie.encode
    monkeypatch.setattr(encoder.trie, "encode", lambda words: asked.extend(words) or real(words))
    for i in range(50):
        list(encoder.encode_all([f"often x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}"]))
        assert len(encoder.known) + len(encoder.older) <= 2 * (3 + 2)
    assert asked.count(b"often") == 1
