"""Each stage against its brute-force version, on what the stage before it kept."""

import hashlib
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as spec
import corpus_pipeline
from defectlens.llm import toxicity
from defectlens.session import materialize
from helpers import leaks, line_dedup
from test_neardup import kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF), name.replace(" ", "_")))
    return [{r["doc_id"]: r.asDict() for r in df.collect()} for df in docs], [df.columns for df in docs]


def test_columns(steps):
    _, columns = steps
    assert all(c == columns[0] for c in columns[:-1])


def test_toxic_documents_go(spark, steps):
    (before, after, *_), _ = steps
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    want = {i for i, s in zip(before, scorer.score_all([r["text"] or "" for r in before.values()])) if s < 0.3}
    assert set(after) == want and all(after[i] == before[i] for i in after)


def test_repeated_lines_go(steps):
    (_, before, after, *_), _ = steps
    rows = [(i, r["text"]) for i, r in before.items()]
    assert {i: r["text"] for i, r in after.items()} == {i: kept for (i, _), (kept, _, _) in zip(rows, line_dedup(rows))}


def test_one_of_each_group_stays(steps):
    """The stage's rule is 0.8 in shingles of five words, over all pairs."""
    (_, _, before, after, *_), _ = steps
    assert sorted(after) == kept([(i, r["text"]) for i, r in before.items()]) and all(after[i] == before[i] for i in after)


def test_leaks_go(spark, steps):
    (_, _, _, before, after, _), _ = steps
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, _ in leaks([(i, r["text"]) for i, r in before.items()], items)}
    assert set(after) == set(before) - dirty


def test_what_stays_is_encoded(steps):
    (*_, before, after), _ = steps
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(after) == set(before)
    for i, row in after.items():
        assert list(struct.unpack(f"<{row['n_tokens']}I", row["ids"])) == library.encode(before[i]["text"], add_special_tokens=False).ids
        assert row["decoded_sha256"] == hashlib.sha256(before[i]["text"].encode()).hexdigest()


def test_registered():
    names = spec.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
