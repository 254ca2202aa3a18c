"""Token counts: pre-tokens that are one token whole are counted by lookup, and only the rest is merged."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from defectlens.llm.common import held
from defectlens.llm.vocab import Vocabulary, share

CACHE = 400_000  # counts of merged pre-tokens that a worker remembers; then it starts afresh


def whole_tokens(vocabulary: Vocabulary) -> frozenset[str]:
    """The vocabulary's strings that encode alone as one token, proven by merging each from its bytes.

    Strings that are not whole characters are left out: no pre-token equals them.
    """
    special, found = set(vocabulary.special.values()), set()
    for number, token in enumerate(vocabulary.tokens):
        if token and number not in special and vocabulary.merge(token) == [number]:
            try:
                found.add(token.decode("utf-8"))
            except UnicodeDecodeError:
                continue
    return frozenset(found)


class Counting:
    """Counts the tokens of texts; remembers how many tokens a merged pre-token has."""

    def __init__(self, vocabulary: Vocabulary, whole: frozenset[str]) -> None:
        self.vocabulary, self.whole, self.known = vocabulary, whole, {}

    def count(self, text: str) -> int:
        total = 0
        for run, special in self.vocabulary.pre_tokens(text):
            total += len(run) + (special is not None)
            rest = [w for w in run if w not in self.whole]
            for word, times in Counter(rest).items():
                total += times * (self._merged(word) - 1)
        return total

    def _merged(self, word: str) -> int:
        size = self.known.get(word)
        if size is None:
            if len(self.known) > CACHE:
                self.known.clear()
            size = self.known[word] = len(self.vocabulary.merge(word.encode("utf-8", "surrogatepass")))
        return size


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``docs``, in its order.

    Counts are those of the vocabulary file ``path`` without added special tokens; special strings inside a text count one
    each. A null text counts as empty. Ids may be null or repeat; no rows give no rows; other columns are ignored.
    """
    shared = share(docs.sparkSession, path)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(shared.value))  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = held(shared.value, lambda: Counting(shared.value, whole.value))
        for batch in batches:
            counts = pa.array([counting.count(t.as_py() or "") for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], names=["id", "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), body.alias("t"), F.octet_length(body).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
