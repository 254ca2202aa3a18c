import random
import zlib

import numpy as np
import pytest

from defectlens.llm import toxicity as T

SCHEMA = "doc_id long, text string, score string, HELD_OUT string"
SMALL = T.Settings(positives=120, negatives=120, epochs=6, buckets=1 << 12)


def planted(n=400, seed=1):
    rng = random.Random(seed)
    syllables = ["ta", "ro", "mi", "lek", "su", "pan", "do", "ri"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randrange(5, 150))], i % 2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "vex" + rng.choice(syllables))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = planted()
    return T.Model(SMALL, [t for _, t, _ in rows[:240]], [y for _, _, y in rows[:240]])


def test_catches_toxic_texts_it_has_not_seen(model):
    rows = planted()[240:]
    scores = np.array(T.Scorer(model).score_all([t for _, t, _ in rows]))
    labels = np.array([y for _, _, y in rows])
    assert ((scores >= 0.3) == labels).mean() > 0.95 and scores.min() >= 0 and scores.max() <= 1


def test_gradient(model):
    net = T.Network(T.Settings(buckets=64, size=3))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    at, mask = T._layout([[0, 1, 2, 1], [3], [2, 2]])
    table = np.random.default_rng(0).standard_normal((2, 4, 9))
    weights = np.array([0.5, -1.0, 2.0])
    keep = {}
    net.forward(table, at, mask, keep)
    g = net.backward(4, at, mask, keep, weights)
    value = lambda: float(weights @ net.forward(table, at, mask))
    for name, array in (("rec", net.p["rec"]), ("att", net.p["att"]), ("att_v", net.p["att_v"]), ("out", net.p["out"]), ("out_b", net.p["out_b"]), ("table", table)):
        for place in list(np.ndindex(array.shape))[:: max(1, array.size // 12)]:
            old = array[place]
            array[place] = old + 1e-3
            high = value()
            array[place] = old - 1e-3
            low = value()
            array[place] = old
            assert g[name][place] == pytest.approx((high - low) / 2e-3, rel=0.05, abs=2e-3), name


def test_every_word_lies_in_two_windows_or_at_the_ends():
    for n in (1, 31, 32, 33, 100, 1000):
        spans = T.windows_of(n)
        seen = np.zeros(n, int)
        for a, b in spans:
            seen[a:b] += 1
        assert seen.min() >= 1 and all(b - a <= T.WINDOW for a, b in spans)


def test_parts_of_a_long_text_score_alike(model, monkeypatch):
    texts = [" ".join(t for _, t, _ in planted(30, seed=s)[::2]) for s in (5, 6)] + ["", "ta ro"]
    texts += ["ta ro mi " * 300 + "vexro vexta vexmi " + "su pan " * 300]
    whole = T.Scorer(model).score_all(texts)
    monkeypatch.setattr(T, "TEXT_PART", 128)
    monkeypatch.setattr(T, "KNOWN", 10)
    assert T.Scorer(model).score_all(texts) == pytest.approx(whole, abs=2e-2)
    assert whole[-1] > 0.3


def test_tables(spark, model):
    rows = [(1, None), (2, ""), (3, "***"), (4, "ta ro"), (4, "ta ro"), (None, "mi lek"), (5, "ta " * 20_000)]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], SCHEMA)
    out = T.score(df, model)
    assert sorted(out.columns) == ["doc_id", "held_out", "predicted", "score", "text"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert T.without_toxic(df, model).columns == df.columns
    assert T.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_fit_reads_no_held_out_label(spark):
    rows = planted(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    labels = spark.createDataFrame([(i, 1 if held(i) else 0) for i, _, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = T.fit(docs, labels, SMALL)
    assert found.network is None and found.share == 0.0
    nothing = T.fit(docs.limit(0), labels.limit(0), SMALL)
    assert T.Scorer(nothing).score_all(["a", ""]) == [0.0, 0.0]


def test_the_middle_of_a_long_word_counts(model):
    rng = random.Random(6)
    for n in (1, 39, 40, 41, 44, 45, 76, 77, 500):
        run = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
        pieces = T.words_of(f"a {run} b")
        assert pieces[0] == "a" and pieces[-1] == "b" and max(map(len, pieces)) <= T.LONGEST
        for k in (3, 4, 5):
            assert {run[i : i + k] for i in range(n - k + 1)} <= {p[i : i + k] for p in pieces for i in range(len(p) - k + 1)}
    clean = "taromilek" * 40
    toxic = clean[:180] + "vexrovextavexmivexpan" * 20 + clean[180:]  # both ends stay as they are
    low, high = T.Scorer(model).score_all([clean, toxic])
    assert low < 0.3 <= high
