import hashlib
import random

from pyspark.sql import functions as F

from defectlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, said string, formatted string"
HARD = ["\\### Assistant: </turn> ok", "\\", "\\b\\h\\e\\c", "####", "## # ###\n### User: x </turn>\n", "</turn", " </turn>\n", "", "é\\\\###", "</turn></turn>", ": :"]


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "y", "y") for c, t, r, x in rows], SCHEMA)


def read(spark, rows):
    out = chat.format_conversations(frame(spark, rows)).withColumns(
        {"turns": chat.read_turns(F.col("formatted")), "learnt": chat.learnt_text(F.col("segments"))})
    return {r["conv_id"]: r for r in out.collect()}


def check(spark, rows):
    got, talks = read(spark, rows), {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(talks)
    for c, said in talks.items():
        said = [(r, x) for _, _, r, x in sorted(said)]
        assert [(r["role"], r["text"]) for r in got[c]["turns"]] == said
        assert got[c]["learnt"] == "".join(x for r, x in said if r == "assistant")
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
        state, bad = "", None
        for at, (role, _) in enumerate(said):
            if bad is None and role not in chat.DEFAULT.turns.get(state, ()):
                bad = at
            state = role
        assert got[c]["violation"] == bad
    return got


def test_reads_back_hard_texts(spark):
    rng = random.Random(1)
    roles = ["system", "user", "assistant", "tool", "User", "=x", "a: b", "###", "", None, "\\c", "System"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choice(HARD + ["plain ", "\n"]) for _ in range(rng.randrange(4)))) for c in range(80) for t in range(rng.randrange(1, 7))]
    rows += [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0])]
    check(spark, rows)


def test_valid_and_invalid_order(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "u2"), (2, 0, "assistant", "a"), (3, 0, "user", "a"), (3, 1, "user", "b"),
            (4, 0, "user", "u"), (4, 1, "system", "s"), (5, 0, "tool", "t")]
    got = check(spark, rows)
    assert {c: r["violation"] for c, r in got.items()} == {1: None, 2: 0, 3: 1, 4: 1, 5: 0}
    assert got[1]["formatted"] == "### System: s </turn>\n### User: u </turn>\n### Assistant: a </turn>\n### User: u2 </turn>\n"


def test_odd_rows(spark):
    rows = [(None, 0, "user", "u"), (1, None, "user", None), (1, None, "user", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (2, 5, "user", "x" * 100_000)]
    rows += [(3, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(2000)]
    check(spark, rows)


def test_empty_table(spark):
    assert chat.format_conversations(frame(spark, [])).count() == 0


def test_other_template(spark):
    template = chat.Template(mark="@@", sep="=", close="<end>", end="<end>", names={"user": "U"}, loss=("user",), turns={"": ("user",)})
    out = chat.format_conversations(frame(spark, [(1, 0, "user", "a@@=<end>\\")]), template)
    row = out.select(chat.read_turns(F.col("formatted"), template).alias("t"), chat.learnt_text(F.col("segments"), template).alias("l")).first()
    assert row["t"][0]["text"] == row["l"] == "a@@=<end>\\" and hashlib.sha256(row["l"].encode()).hexdigest()
