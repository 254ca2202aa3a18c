import hashlib
import random
import zlib

import pytest

import __spark_entry__ as spec
from defectlens.llm import repair

WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string, said string, cost string, there boolean"


def faults(said):
    found, seen = [], set()
    for role, text in said:
        bare = text.rstrip(WHITE)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def plain(said, found):
    """Cheapest (cost, letters, turns) over all ways, turn by turn, from the last to the first."""
    end = {"": (0, "", ()), "a": (0, "", ()), "u": (5, "I", (("assistant", ""),)), "s": (10, "II", (("user", ""), ("assistant", "")))}
    rest = end
    for (role, text), fault in list(zip(said, found))[::-1]:
        now = {}
        for state in NEXT:
            ways, at, paid, letters, made = [], state, 0, "", ()
            for _ in range(4):
                def add(letter, cost, after, turn):
                    c, more, turns = rest[after]
                    ways.append((paid + cost + c, letters + letter + more, made + turn + turns))

                add("D", 2, at, ())
                if fault not in ("blank", "duplicate"):
                    extra = 5 if fault == "truncated" else 0
                    kind = role[:1]
                    if kind == NEXT[at] or (kind == "s" and at == ""):
                        add("K", extra, kind, ((role, text),))
                    add("R", 1 + extra, NEXT[at], ((NAMES[NEXT[at]], text),))
                paid, letters, made, at = paid + 5, letters + "I", made + ((NAMES[NEXT[at]], ""),), NEXT[at]
            now[state] = min(ways)
        rest = now
    return rest[""]


def expected(rows):
    talks = {}
    for conv, turn, role, text, there in rows:
        talks.setdefault(conv, [])
        if there:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, said in talks.items():
        said.sort()
        turns, said = [t for known, t, _, _ in said if known], [(r, x) for _, _, r, x in said]
        kinds, found = [r[:1] for r, _ in said], faults(said)
        cost, audit, repaired = plain(said, found)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        out[conv] = (gaps, illegal, cost, audit, list(repaired), found)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(c, t, r, x, "clash", "clash", there) for c, t, r, x, there in rows], SCHEMA)
    return {
        r["conv_id"]: (r["gaps"], r["illegal"], r["cost"], r["audit"], [tuple(t) for t in r["repaired"]], [t["fault"] for t in r["said"]])
        for r in repair.repair_conversations(df, present="there").collect()
    }


def test_against_plain_search(spark):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "u", "State"]
    texts = ["Yes.", "no", " \n", "", None, "Why?", "So! \t", "é", "a.\x0b"]
    rows = []
    for c in range(400):
        rows += [(c, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{t}.", rng.random() < 0.9) for t in range(rng.randrange(9))]
    got, want = run(spark, rows), expected(rows)
    assert got == want and {len(w[3]) for w in want.values()} > {0, 1, 5}


def test_long_runs_repeats_and_null_ids(spark):
    rows = [(1, t, "user", f"{t}.", True) for t in range(5000)]  # one run
    rows += [(2, t, "assistant" if t % 2 else "user", "x" * 50_000 + f"{t}.", True) for t in range(30)]
    rows += [(3, 7, "user", "same.", True)] * 700 + [(4, None, None, None, True)] * 3 + [(None, 0, "user", "u.", True)] + [(5, 1, "user", "u", False)]
    rows += [(6, t, "user", f"{t}", True) for t in range(3000)] + [(6, 3000 + t, "tool", f"{t}!", True) for t in range(1500)]
    assert run(spark, rows) == expected(rows)


def test_runs_and_powers():
    rng = random.Random(2)
    for _ in range(300):
        symbols = bytes(s for s in (rng.randrange(15) for _ in range(rng.randrange(6))) for _ in range(rng.choice([1, 2, 3, 17, 40])))
        kinds = {0: "tool", 1: "s", 2: "u", 3: "a", 4: "tool"}
        said = [(kinds[s % 5], "") for s in symbols]
        cost, audit, _ = plain(said, [(None, "blank", "truncated")[s // 5] for s in symbols])
        assert repair.cheapest(symbols) == (cost, audit)
        assert sum(n for _, n in repair.runs(symbols)) == len(symbols)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_query_against_plain_search(spark):
    talks = {}
    rows = []
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect():
        role, text = (r[c] if r[c] is not None else " " for c in ("role", "text"))
        damage = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(damage, text)
        rows += [(r["conv_id"], r["turn"], "user" if damage == 4 else role, text, damage != 0)] * (1 + (damage == 3))
    want = expected(rows)
    got = {r["conv_id"]: r for r in spec.queries()["op11_conversation_repair"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(want)
    for c, (gaps, illegal, cost, audit, repaired, found) in want.items():
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
        counts = tuple(found.count(f) for f in ("blank", "duplicate", "truncated"))
        assert tuple(got[c])[1:] == (gaps, *counts, illegal, cost, audit, sha)


@pytest.mark.parametrize("audit,kinds,places,roles", [("KI", b"\x02", [0, -1], [None, "assistant"]), ("DRK", b"\x04\x04\x03", [1, 2], ["user", None]), ("", b"", [], [])])
def test_turns_of(audit, kinds, places, roles):
    assert repair.turns_of(audit, kinds) == (places, roles)
