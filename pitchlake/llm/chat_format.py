"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

``format_conversations`` turns rows (conversation, turn, role, text) into one row per conversation with the rendered
string, the segments it is made of, and for each segment whether the loss is taken on it.

Control strings cannot be forged from inside a text: every backslash is doubled, and then ``<|`` becomes ``<\\|``. In an
escaped text a ``<`` is followed by an odd number of backslashes only where a control string was, so ``unescape`` is exact.

Defined results: null text or role counts as empty; rows of a conversation are ordered by turn (null last), then role,
then text, so ties and repeated rows have one order and each is kept; rows whose conversation id is null form one
conversation; no rows give no rows; other columns of the input are ignored. A conversation the machine rejects is still
formatted, with ``valid`` false. A conversation is one output value, so its turns meet in one row by nature.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What surrounds a turn, who may speak after whom, and whose text is trained on."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    #: state -> role -> next state
    transitions: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    accepting: tuple = ("assistant",)
    loss_roles: tuple = ("assistant",)


CHATML = ChatTemplate()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``; a line break, which ends the role, becomes ``<\\n>``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def _next_state(template: ChatTemplate, state: Column, role: Column) -> Column:
    out = None
    for source, moves in template.transitions.items():
        for heard, target in moves.items():
            hit = (state == source) & (role == heard)
            out = F.when(hit, F.lit(target)) if out is None else out.when(hit, F.lit(target))
    return out.otherwise(F.lit("reject"))


def format_conversations(
    df: DataFrame,
    template: ChatTemplate = CHATML,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_col, n_turns, valid, segments array<struct<text, loss>>, formatted)."""
    turn = F.struct(
        df[turn_col].isNull().alias("last"),
        df[turn_col].alias("turn"),
        F.coalesce(df[role_col], F.lit("")).alias("role"),
        F.coalesce(df[text_col], F.lit("")).alias("text"),
    )
    grouped = df.select(df[conv_col].alias("conv"), turn.alias("t")).groupBy("conv").agg(
        F.array_sort(F.collect_list("t")).alias("turns")
    )
    state = F.aggregate("turns", F.lit("start"), lambda s, t: _next_state(template, s, t["role"]))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.open), escape_role(t["role"]), F.lit("\n"))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    return grouped.select(
        F.col("conv").alias(conv_col),
        F.size("turns").cast("long").alias("n_turns"),
        state.isin(*template.accepting).alias("valid"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>, from nothing but the string."""
    parts = F.split(formatted, _quoted(template.open))
    bodies = F.slice(parts, F.lit(2), F.size(parts))

    def turn(body: Column) -> Column:
        cut = F.instr(body, "\n")
        text = F.substring(body, cut + 1, F.length(body) - cut - F.lit(len(template.close)))
        return F.struct(unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, joined with nothing between."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")


def _quoted(literal: str) -> str:
    """A Java pattern for the literal."""
    return "\\Q" + literal + "\\E"
