"""The registered queries without SQL against brute force, over the whole small tables."""

import hashlib
import math
import zlib

import pytest

import __spark_entry__ as spec
from helpers import simhash_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def rows(spark, prefix):
    name = next(n for n in spec.queries() if n.startswith(prefix))
    return [r.asDict() for r in spec.queries()[name](spark, SF).collect()]


def test_op1(spark, texts):
    prints, roots = simhash_components(texts)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op1_")} == {i: (f"{prints[i]:016x}", roots[i]) for i, _ in texts}


def test_op4_and_op6_columns(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, "op4_")}
    assert set(got) == {i for i, _ in texts}
    for i, t in texts:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and got[i]["n_tokens"] == len(t.encode().split()) + 1
        assert math.isfinite(got[i]["score"]) and got[i]["score"] < 0 and got[i]["base_score"] < 0
    toxic = {r["doc_id"]: r for r in rows(spark, "op6_")}
    assert set(toxic) == set(got) and set(next(iter(toxic.values()))) == {"doc_id", "held_out", "score", "predicted"}


def test_op7(spark):
    talks = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    sample = "\\### Assistant: </turn> ok"
    talks[-7] = [(0, "user", sample), (1, "assistant", sample)]
    got = {r["conv_id"]: r for r in rows(spark, "op7_")}
    assert set(got) == set(talks)
    for c, said in talks.items():
        said.sort()
        learnt = "".join(t for _, r, t in said if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in said)
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(said), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[c]["formatted_chars"] >= len(whole)


def test_op8(spark, texts):
    from test_licenses import brute

    want = {}
    for i, t in texts:
        n, base_n, first, last, base, _, labels, score = brute(t)
        want[i] = (n, base_n, first, last, ",".join(base), ",".join(labels), score)
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in rows(spark, "op8_")} == want


def test_op5_and_op10(spark, texts):
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op5_")} == {
        i: (len(x), sha(struct.pack(f"<{len(x)}I", *x)), sha(library.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(spark, "op10_")} == {
        i: (len((t or "").encode()), len(ids[i]), len(ids[i]) > 512) for i, t in texts}
