"""Chat formatting: a declarative template, a state machine over roles, and text segments with loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """How a turn looks: ``open`` + name + ``sep`` + text + ``close``.

    ``names`` gives the names of known roles, ``loss`` the roles whose text is learnt, ``turns`` the roles that may follow
    each role, with "" for the start. ``mark``, ``close`` and ``sep`` never occur inside an escaped text or name.
    """

    mark: str = "###"
    sep: str = ": "
    close: str = " </turn>\n"
    end: str = "</turn>"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    other: str = "="  # comes before the name of any other role
    loss: tuple[str, ...] = ("assistant",)
    turns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    @property
    def escapes(self) -> list[tuple[str, str]]:
        """Control strings and what stands for them, in the order of escaping; the escape character comes first.

        After the first step every backslash begins one of these codes, so that undoing them in reverse order is exact.
        """
        return [("\\", "\\b"), (self.mark, "\\h"), (self.end, "\\e"), (self.sep.strip(), "\\c")]


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT, name: bool = False) -> Column:
    """``text`` without control strings; names are also kept free of the separator."""
    for plain, code in template.escapes[: None if name else 3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: Template = DEFAULT, name: bool = False) -> Column:
    for plain, code in reversed(template.escapes[: None if name else 3]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _name(role: Column, template: Template) -> Column:
    known = F.coalesce(*[F.when(role == r, F.lit(n)) for r, n in template.names.items()])
    return F.coalesce(known, F.concat(F.lit(template.other), escape(role, template, name=True)))


def _role(name: Column, template: Template) -> Column:
    known = F.coalesce(*[F.when(name == n, F.lit(r)) for r, n in template.names.items()])
    return F.coalesce(known, unescape(F.substring(name, len(template.other) + 1, 1 << 30), template, name=True))


def first_violation(roles: Column, template: Template = DEFAULT) -> Column:
    """The position, from 0, of the first turn whose role may not follow the one before it; null if all may."""
    allowed = F.map_from_entries(F.array(*[
        F.struct(F.lit(state), F.array(*[F.lit(r) for r in after])) for state, after in template.turns.items()
    ]))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(seen: Column, role: Column) -> Column:
        fits = F.coalesce(F.array_contains(F.element_at(allowed, seen["state"]), role), F.lit(False))
        bad = F.coalesce(seen["bad"], F.when(~fits, seen["at"]))
        return F.struct(role.alias("state"), (seen["at"] + 1).alias("at"), bad.alias("bad"))

    return F.aggregate(roles, start, step, lambda seen: seen["bad"])


def format_conversations(
    rows: DataFrame, template: Template = DEFAULT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), formatted (all of them joined), violation.

    Turns are ordered by ``turn``, equal ones by role and text, null ones first; repeated rows are turns each. A null text is
    empty, and so is a null role. Any role is kept; ``violation`` is the first turn the state machine refuses, null for a valid
    conversation. A null id is a conversation like any other. No rows give no rows; other columns are ignored.
    """
    said = F.struct(
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    talks = rows.select(F.col(conv_id).alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))

    def parts(row: Column) -> Column:
        head = F.concat(F.lit(f"{template.mark} "), _name(row["role"], template), F.lit(template.sep))
        return F.array(
            _segment(head, F.lit(False)), _segment(escape(row["text"], template), row["role"].isin(*template.loss)),
            _segment(F.lit(template.close), F.lit(False)),
        )

    talks = talks.select(
        "conv_id", F.flatten(F.transform("said", parts)).alias("segments"),
        first_violation(F.transform("said", lambda r: r["role"]), template).alias("violation"),
    )
    return talks.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "violation")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, f"\\Q{template.mark} \\E", -1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, template.sep)
        text = F.substr(piece, at + len(template.sep), F.length(piece) - at - len(template.sep) - len(template.close) + 1)
        return F.struct(
            _role(F.substr(piece, F.lit(1), at - 1), template).alias("role"), unescape(text, template).alias("text")
        )

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def learnt_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
