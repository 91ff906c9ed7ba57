"""Chat formatting from a declarative template, with DataFrame functions only.

A template names the control strings, the states that each role may follow, and
the roles that are learned.  A conversation becomes an array of segments (text,
loss); joined, they are the formatted text.  Control strings inside texts are
escaped, so the formatted text can be split into the same turns again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings start with ``lead``; the escape character is put inside a lead found in a text.

    ``follows`` is the state machine: for each state (``start`` or the role before) the roles that
    may come next; a conversation is complete in one of ``ends``.
    """

    lead: str = "<|"
    escape: str = "\\"
    opens: str = "<|im_start|>"
    role_ends: str = "<|im_sep|>"
    closes: str = "<|im_end|>"
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")}
    )
    ends: tuple[str, ...] = ("assistant",)
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if len(self.lead) != 2 or len(self.escape) != 1 or self.escape in self.lead:
            raise ValueError("the lead has two characters, the escape one other")
        if not all(s.startswith(self.lead) for s in (self.opens, self.role_ends, self.closes)):
            raise ValueError("every control string starts with the lead")

    def escaped(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        return F.replace(doubled, F.lit(self.lead), F.lit(self.lead[0] + self.escape + self.lead[1]))

    def unescaped(self, text: Column) -> Column:
        either = f"{re.escape(self.escape)}([{re.escape(self.escape)}{re.escape(self.lead[1])}])"
        return F.regexp_replace(text, either, "$1")


CHAT = Template()


def format_conversations(messages: DataFrame, template: Template = CHAT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments, formatted, valid, first_bad_turn.

    Turns are ordered by turn (null first), ties by role and text; repeated rows are turns of their
    own.  Null texts are empty; null roles are empty and follow nothing.  ``first_bad_turn`` counts
    from 0 and is null when the order is right; a conversation that stops in a wrong state is not
    valid and has ``first_bad_turn = n_turns``.  Nothing is left out because of its order.  A row
    with a null id is a conversation of its own.  Other columns are not read.  No rows in, none out.
    """
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    rows = messages.select(F.col(id_col).alias("conv_id"), alone.alias("alone"), turn.alias("said"))
    chats = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    chats = chats.withColumn("segments", F.flatten(F.transform("turns", lambda t: _segments(t, template))))
    bad = _first_bad(F.col("turns"), template)
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        bad.isNull().alias("valid"),
        bad.alias("first_bad_turn"),
    )


def _segments(turn: Column, template: Template) -> Column:
    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    never = F.lit(False)
    return F.array(
        segment(F.concat(F.lit(template.opens), template.escaped(turn.role), F.lit(template.role_ends)), never),
        segment(template.escaped(turn.text), turn.role.isin(*template.learned)),
        segment(F.lit(template.closes + "\n"), never),
    )


def _first_bad(turns: Column, template: Template) -> Column:
    """Run the state machine over the roles: the state is the last role, null once an order was wrong."""
    moves = F.create_map(*(F.lit(x) for state, roles in template.follows.items() for role in roles for x in (f"{state}>{role}", role)))
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("done"))

    def step(at: Column, turn: Column) -> Column:
        state = F.try_element_at(moves, F.concat(at.state, F.lit(">"), turn.role))
        return F.struct(state.alias("state"), (at.done + F.when(state.isNotNull(), 1).otherwise(0)).alias("done"))

    end = F.aggregate(turns, begin, step)
    return F.when(~F.coalesce(end.state.isin(*template.ends), F.lit(False)), end.done)


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """The input again, from the output alone: conv_id, turns (role, text) out of ``formatted``,
    learned (the unescaped text under the loss flags) out of ``segments``; and what the state machine
    said of the order of turns, valid and first_bad_turn."""
    controls = "|".join(re.escape(s) for s in (template.role_ends, template.closes))

    def turn(piece: Column) -> Column:
        parts = F.split(piece, controls)
        return F.struct(template.unescaped(parts[0]).alias("role"), template.unescaped(parts[1]).alias("text"))

    pieces = F.split(F.col("formatted"), re.escape(template.opens))
    turns = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    learned = F.transform(F.filter("segments", lambda s: s.loss), lambda s: template.unescaped(s.text))
    return formatted.select(
        "conv_id", turns.alias("turns"), F.array_join(learned, "").alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_bad_turn"
    )
