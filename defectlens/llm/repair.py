"""Conversation structure repair: the cheapest edits that give a conversation a legal order of turns.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an assistant turn. A turn's symbol is the
kind of its role and of its fault. Equal symbols in a row are a run; the min-plus transition of a symbol gives the cheapest way from
each state before a turn to each state after it, so a run of n turns is advanced by the cached binary powers of that transition.
Costs to the end are known run by run, from the last to the first; then the choices are unrolled from the first turn to the last, in
blocks of a power of two that are cached as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the kind of the last turn
STATES = range(4)
OTHER = 4  # a role that no state is named after
NEXT = (USER, USER, ASSISTANT, USER)  # what an inserted turn, or one that gets another role, can only be
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLOCK = 10  # blocks of up to 2^BLOCK choices are cached
FAULTS = {None: 0, BLANK: 1, DUPLICATE: 1, TRUNCATED: 2}  # kinds of faults: none, must go, must pay to stay
Vector = tuple[int, int, int, int]


@dataclass(frozen=True)
class Costs:
    """What an edit costs. ``truncated`` is added where a truncated turn stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


DEFAULT = Costs()
INFINITE = 1 << 60


def _kept_state(state: int, kind: int) -> int | None:
    """The state after a turn that keeps its role; None if it may not stand here."""
    fits = state == START if kind == SYSTEM else NEXT[state] == kind
    return kind if fits else None


def _edits(symbol: int, state: int, costs: Costs) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a turn, in the order of the letters."""
    kind, fault = symbol % 5, symbol // 5
    found = [("D", costs.delete, state)]
    if fault != 1:
        extra = costs.truncated if fault == 2 else 0
        if (kept := _kept_state(state, kind)) is not None:
            found.append(("K", extra, kept))
        found.append(("R", costs.rerole + extra, NEXT[state]))
    return found


@lru_cache(maxsize=None)  # 15 symbols
def power(symbol: int, k: int, costs: Costs) -> tuple[Vector, ...]:
    """Cheapest costs from state to state over 2^k turns of one symbol, with turns inserted before each of them."""
    if k:
        half = power(symbol, k - 1, costs)
        return tuple(tuple(min(half[a][b] + half[b][c] for b in STATES) for c in STATES) for a in STATES)
    return tuple(tuple(_once(symbol, a, costs).get(b, INFINITE) for b in STATES) for a in STATES)


def _once(symbol: int, state: int, costs: Costs) -> dict[int, int]:
    best, inserted = {}, 0
    for _ in range(4):  # three turns inserted lead back to a state that was passed
        for _, cost, after in _edits(symbol, state, costs):
            best[after] = min(best.get(after, INFINITE), cost + inserted)
        state, inserted = NEXT[state], inserted + costs.insert
    return best


def before(symbol: int, k: int, rest: Vector, costs: Costs) -> Vector:
    """Costs to the end before 2^k turns, from those after them."""
    step = power(symbol, k, costs)
    return tuple(min(step[a][b] + rest[b] for b in STATES) for a in STATES)


def _normal(rest: Vector) -> Vector:
    low = min(rest)
    return tuple(x - low for x in rest)


def _turn(symbol: int, state: int, rest: Vector, costs: Costs) -> tuple[str, int]:
    """The least letters among the cheapest edits from ``state`` over one turn, inserted turns first, and the state they lead to."""
    letters, now = "", before(symbol, 0, rest, costs)
    while True:
        best = {letter: after for letter, cost, after in _edits(symbol, state, costs) if cost + rest[after] == now[state]}
        if costs.insert + now[NEXT[state]] == now[state]:
            best["I"] = NEXT[state]
        letter = min(best)
        letters, state = letters + letter, best[letter]
        if letter != "I":
            return letters, state


@lru_cache(maxsize=20_000)
def _block(symbol: int, k: int, rest: Vector, costs: Costs) -> tuple[tuple[str, int], ...]:
    """Per state: the letters over 2^k turns and the state after them."""
    if k == 0:
        return tuple(_turn(symbol, state, rest, costs) for state in STATES)
    first, second = _block(symbol, k - 1, _normal(before(symbol, k - 1, rest, costs)), costs), _block(symbol, k - 1, rest, costs)
    return tuple((letters + second[middle][0], second[middle][1]) for letters, middle in first)


def _pieces(length: int) -> Iterator[int]:
    """Powers of two that sum up to ``length``, none larger than a cached block."""
    yield from (BLOCK for _ in range(length >> BLOCK))
    yield from (k for k in reversed(range(BLOCK)) if length >> k & 1)


def runs(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) of the runs of equal symbols."""
    return [(symbol, len(list(equal))) for symbol, equal in groupby(symbols)]


def cheapest(symbols: bytes, costs: Costs = DEFAULT) -> tuple[int, str]:
    """The least cost of a legal order, and the letters of the edits; of equally cheap ones the least in ASCII."""
    rest = tuple(_ending(state, costs) for state in STATES)
    blocks, last = [], rest  # (symbol, power, costs after it), last turns first
    for symbol, length in reversed(runs(symbols)):
        for k in reversed(list(_pieces(length))):
            blocks.append((symbol, k, rest))
            rest = before(symbol, k, rest, costs)
    letters, state = [], START
    for symbol, k, after in reversed(blocks):
        more, state = _block(symbol, k, _normal(after), costs)[state]
        letters.append(more)
    return rest[START], "".join(letters) + "I" * (last[state] // costs.insert)


def _ending(state: int, costs: Costs) -> int:
    return 0 if state in (START, ASSISTANT) else costs.insert * (2 if state == SYSTEM else 1)


def turns_of(letters: str, kinds: bytes) -> tuple[list[int], list[str | None]]:
    """The repaired turns: the number of the turn each comes from (-1: inserted) and its new role (None: its own)."""
    places, roles, at, state = [], [], 0, START
    for letter in letters:
        if letter == "D":
            at += 1
            continue
        places.append(-1 if letter == "I" else at)
        roles.append(None if letter == "K" else NAMES[NEXT[state]])
        state = kinds[at] % 5 if letter == "K" else NEXT[state]
        at += letter != "I"
    return places, roles


def _audits(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """Adds the cheapest edits to each conversation; the turns themselves pass through."""
    for batch in batches:
        cost, audit, places, roles = [], [], [], []
        for symbols in batch.column(batch.num_columns - 1):
            symbols = bytes(b - 65 for b in symbols.as_py().encode())
            least, letters = cheapest(symbols, costs)
            place, role = turns_of(letters, symbols)
            cost.append(least), audit.append(letters), places.append(place), roles.append(role)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(roles, pa.list_(pa.string()))],
            names=[*batch.schema.names[:-1], "cost", "audit", "places", "roles"],
        )


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def repair_conversations(
    rows: DataFrame, costs: Costs = DEFAULT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None
) -> DataFrame:
    """One row per conversation: conv_id, said (turn, role, text, fault), gaps, illegal, cost, audit, repaired (role, text).

    Turns are ordered by ``turn``, null first, equal ones by role and text. A null role or text is empty. A turn's fault is the
    first of: blank (nothing but white space), duplicate (role and text stand earlier in the conversation), truncated (does not end
    in ``.``, ``!`` or ``?``); blank and duplicate turns are deleted. ``audit`` has a letter per edit: K keep, R another role,
    D delete, I insert; ``repaired`` are the turns that result. ``gaps`` counts the missing numbers between the first and the last
    turn, ``illegal`` the neighbours whose roles may not follow each other. Repeated rows are turns each. A null id is a conversation
    like any other. Rows whose column ``present`` is not true only name their conversation, which may so be without turns: no
    cost, no edit. No rows give no rows; other columns are ignored. A conversation is a row of the result, so its turns meet in
    one task.
    """
    there = F.lit(True) if present is None else F.coalesce(F.col(present), F.lit(False))
    rows = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), there.alias("there"),
    )
    earlier = Window.partitionBy("conv_id", "role", "text", "there").orderBy("turn")
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    fault = F.when(last == "", BLANK).when(F.row_number().over(earlier) > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED)
    talks = rows.repartition("conv_id").withColumn("fault", fault).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("turn", "role", "text", "fault")))).alias("said")
    )
    kinds = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
    faults = {f: n for f, n in FAULTS.items() if f}

    def symbol(t: Column) -> Column:
        kind = F.coalesce(*[F.when(_initial(t["role"]) == i, F.lit(k)) for i, k in kinds.items()], F.lit(OTHER))
        return F.char(65 + kind + 5 * F.coalesce(*[F.when(t["fault"] == f, F.lit(n)) for f, n in faults.items()], F.lit(0)))

    talks = talks.withColumn("symbols", F.array_join(F.transform("said", symbol), ""))
    audited = talks.mapInArrow(
        lambda batches: _audits(batches, costs), f"conv_id {dict(talks.dtypes)['conv_id']}, said {dict(talks.dtypes)['said']}, "
        "cost long, audit string, places array<int>, roles array<string>",
    )
    numbers = F.filter(F.transform("said", lambda t: t["turn"]), lambda n: n.isNotNull())
    gaps = F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))
    initials = F.transform("said", lambda t: _initial(t["role"]))
    pairs = F.zip_with(F.slice(initials, F.lit(1), F.greatest(F.size(initials) - 1, F.lit(0))), F.slice(initials, F.lit(2), F.size(initials)), lambda a, b: F.concat(a, b))
    own = lambda place, field: F.get(F.col("said"), F.nullif(place, F.lit(-1)))[field]
    repaired = F.zip_with("places", "roles", lambda p, r: F.struct(F.coalesce(r, own(p, "role")).alias("role"), F.coalesce(own(p, "text"), F.lit("")).alias("text")))
    return audited.select(
        "conv_id", "said", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"), "cost", "audit", repaired.alias("repaired"),
    )


def fault_count(said: Column, fault: str) -> Column:
    return F.size(F.filter(said, lambda t: t["fault"] == fault)).cast("long")
