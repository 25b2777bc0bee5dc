"""Chat formatting: a finite-state machine over roles, and a declarative template that emits text segments with loss flags.

DataFrame functions only. Control strings have the form ``<|name|>``. Inside texts every ``<\\...\\|`` gets one more
backslash, so an escaped text never holds ``<|`` and the change can be undone exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers around a turn, the roles that are trained on, and the machine that says which role may follow which."""

    turn_open: str = "<|im_start|>"
    role_end: str = "\n"
    turn_close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def __post_init__(self) -> None:
        for marker in (self.turn_open, self.turn_close.strip()):
            if not re.fullmatch(r"<\|\w+\|>", marker):
                raise ValueError(f"a control string must look like <|name|>, not {marker!r}")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    for raw, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for raw, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conv_id: conv_id, formatted, segments array<struct<text, loss>>, valid.

    turns: conv_id, turn, role, text; further columns are ignored. Rows are put in order of turn; rows with the same
    turn follow by role, then text (nulls first), and repeated rows stay repeated. A null text is empty; a null role is
    an empty role, which the machine rejects. A row with a null conv_id is a conversation of its own. A conversation in an
    order that the machine rejects is formatted all the same, with valid = false. No rows: no conversations. One
    conversation is one record by definition, so its turns meet in one row; nothing else is gathered.
    """
    t = template or ChatTemplate()
    steps = F.create_map(*[F.lit(x) for (state, role), to in t.transitions.items() for x in (f"{state}|{role}", to)])
    grouped = (
        turns.select(
            "conv_id",
            F.struct(
                F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
            ).alias("t"),
            F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("__alone"),
        )
        .groupBy("conv_id", "__alone")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    state = F.aggregate(
        "turns", F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit("|"), x.role)), F.lit("rejected"))
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.turn_open), _escape_role(x.role), F.lit(t.role_end)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x.text).alias("text"), x.role.isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.turn_close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return grouped.select("conv_id", segments.alias("segments"), state.isin(*t.accepting).alias("valid")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments", "valid"
    )


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    t = template or ChatTemplate()
    parts = F.filter(F.split(formatted, re.escape(t.turn_close).replace("\\\n", "\n"), -1), lambda p: p.startswith(t.turn_open))
    bodies = F.transform(parts, lambda p: F.substr(p, F.lit(len(t.turn_open) + 1)))
    return F.transform(
        bodies,
        lambda b: F.struct(
            _unescape_role(F.substring_index(b, t.role_end, 1)).alias("role"),
            unescape(F.substr(b, F.length(F.substring_index(b, t.role_end, 1)) + F.lit(len(t.role_end) + 1))).alias("text"),
        ),
    )


def read_loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")
