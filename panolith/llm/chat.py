"""Chat formatting with DataFrame functions only.

A finite-state machine over roles checks the order of turns; a declarative template gives the
segments of each turn with their loss flags. Control strings are unique to the template: in
texts they are broken by an escape character, so the output reads back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers and loss flag of each role, markers of any other role, and the state machine.

    ``moves`` maps (state, role) to the next state; a role without a move is out of turn. The
    markers must be distinct, and no control string may overlap another.
    """

    turns: dict[str, Turn]
    other: tuple[str, str, str]  # before the role's name, after it, at the turn's end
    between: str
    moves: dict[tuple[str, str], str]
    final: tuple[str, ...]
    start: str = "start"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "controls", (*(s for t in self.turns.values() for s in (t.open, t.close)), *self.other))

    def control_pattern(self) -> str:
        """Matches the first character of a control string."""
        return "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)

    def turn_pattern(self) -> str:
        """Groups: opening, role of other turns, text, closing."""
        opens = "|".join(re.escape(t.open) for t in self.turns.values())
        closes = "|".join(re.escape(t.close) for t in self.turns.values())
        before, after, end = map(re.escape, self.other)
        return f"(?s)({opens}|{before}(.*?){after})(.*?)({closes}|{end})"


TEMPLATE = Template(
    turns={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    other=("<<ROLE>>", "<</ROLE>>", "<<END>>"),
    between="\n",
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    final=("assistant",),
)


def escaped(text: Column, template: Template) -> Column:
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, template.control_pattern(), "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def format_chats(rows: DataFrame, template: Template = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, segments (text, loss), loss_spans (start, length in code points), valid, bad_turn.

    One row per conversation, turns in the order of (turn, role, text) with nulls first. A
    null role or text counts as empty; roles the template does not know keep their name. A
    conversation out of turn is formatted like any other: ``valid`` is false and ``bad_turn``
    is the position from 0 of the first turn out of order (null if only the end is amiss).
    A null conv_id is a conversation of its own. No rows give no conversations.
    """
    picked = rows.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    grouped = picked.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    opens, closes = _map({k: t.open for k, t in template.turns.items()}), _map({k: t.close for k, t in template.turns.items()})
    learnt = _map({k: t.loss for k, t in template.turns.items()})
    before, after, end = map(F.lit, template.other)

    def segments(t: Column) -> Column:
        def segment(s: Column, loss: Column) -> Column:
            return F.struct(s.alias("text"), loss.alias("loss"))

        opening = F.coalesce(F.try_element_at(opens, t["role"]), F.concat(before, escaped(t["role"], template), after))
        closing = F.concat(F.coalesce(F.try_element_at(closes, t["role"]), end), F.lit(template.between))
        return F.array(segment(opening, F.lit(False)), segment(escaped(t["text"], template), F.coalesce(F.try_element_at(learnt, t["role"]), F.lit(False))), segment(closing, F.lit(False)))

    moves = _map({f"{a}>{r}": b for (a, r), b in template.moves.items()})

    def step(acc: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit(">"), t["role"]))
        bad = F.when(acc["bad"].isNull() & to.isNull(), acc["at"]).otherwise(acc["bad"])
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), bad.alias("bad"), (acc["at"] + 1).alias("at"))

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def place(acc: Column, s: Column) -> Column:
        n = F.length(s["text"])
        return F.struct((acc["at"] + n).alias("at"), F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), n.alias("length"))))).otherwise(acc["spans"]).alias("spans"))

    done = grouped.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), F.aggregate("turns", begin, step).alias("fsm"))
    return done.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.aggregate("segments", nothing, place)["spans"].alias("loss_spans"),
        (F.col("fsm.bad").isNull() & F.col("fsm.state").isin(*template.final)).alias("valid"),
        F.col("fsm.bad").alias("bad_turn"),
    )


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The (role, text) turns of a formatted conversation."""
    pattern = F.lit(template.turn_pattern())
    roles = _map({t.open: k for k, t in template.turns.items()})
    parts = F.arrays_zip(*[F.regexp_extract_all(formatted, pattern, F.lit(i)).alias(n) for i, n in ((1, "opening"), (2, "name"), (3, "body"))])
    return F.transform(parts, lambda p: F.struct(F.coalesce(F.try_element_at(roles, p["opening"]), unescaped(p["name"])).alias("role"), unescaped(p["body"]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")
