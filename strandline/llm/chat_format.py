"""Chat formatting: a finite-state machine over roles and a declarative template. DataFrame operations only.

A conversation becomes an array of segments (text, loss). Their texts joined are the formatted string; a trainer takes
the loss on the segments marked so. Control strings inside a text are escaped reversibly: between ``<`` and ``|`` one
backslash is added to however many stand there, so no text can hold a control string, and reading takes one away.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings must have the form <|...|>. loss_roles: whose texts are trained on.

    transitions: (state, role) -> next state. The machine starts in ``start``; what has no transition leads to
    ``error``, which it never leaves. A conversation is valid if it ends in one of ``final``.
    """

    turn_open: str = "<|turn|>"
    text_open: str = "<|text|>"
    turn_close: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "instructed",
            ("start", "user"): "asked",
            ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)


CHAT = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def conversations_to_turns(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row for each conv_id: conv_id, turns (turn, role, text), state, valid, error_turn (index from 0, else null).

    Rows go by turn; of equal turns first the lesser role, then the lesser text; a null turn goes first. Null roles and
    texts count as empty; a null conv_id is a conversation of its own. Repeated rows stay repeated turns. One
    conversation has to fit into one task, as its digest and its training example do; nothing else is collected.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    known = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\n{role}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("error_turn"))

    def step(at: Column, row: Column) -> Column:
        to = F.coalesce(F.element_at(known, F.concat(at["state"], F.lit("\n"), row["role"])), F.lit("error"))
        return F.struct(to.alias("state"), (at["n"] + 1).alias("n"), F.coalesce(at["error_turn"], F.when(to == "error", at["n"])).alias("error_turn"))

    run = F.aggregate("turns", start, step)
    return grouped.select("conv_id", "turns", run.alias("run")).select(
        "conv_id", "turns", F.col("run.state").alias("state"), F.col("run.state").isin(*template.final).alias("valid"), F.col("run.error_turn").alias("error_turn")
    )


def format_chats(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, segments (text, loss), formatted, state, valid, error_turn for rows of (conv_id, turn, role, text).

    Conversations whose turn order the machine rejects are formatted too and marked valid = false, so that the caller
    decides. An empty table gives an empty result; other columns play no part. See conversations_to_turns() for nulls,
    ties and repeated rows.
    """
    def part(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of(turn: Column) -> Column:
        head = F.concat(F.lit(template.turn_open), escape(turn["role"]), F.lit(template.text_open))
        return F.array(part(head, F.lit(False)), part(escape(turn["text"]), turn["role"].isin(*template.loss_roles)), part(F.lit(template.turn_close), F.lit(False)))

    turns = conversations_to_turns(rows, template)
    out = turns.select("conv_id", F.flatten(F.transform("turns", of)).alias("segments"), "state", "valid", "error_turn")
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_chats(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Read format_chats() back: conv_id, turns (role, text) from the formatted string alone, loss_texts by the loss mask."""
    def quoted(control: str) -> str:
        return "".join(f"\\{c}" if not c.isalnum() else c for c in control)

    def turn_of(x: Column) -> Column:
        role_text = F.split(F.substring_index(x, template.turn_close, 1), quoted(template.text_open), 2)
        return F.struct(unescape(role_text[0]).alias("role"), unescape(role_text[1]).alias("text"))

    opened = F.split("formatted", quoted(template.turn_open), -1)
    turns = F.transform(F.slice(opened, 2, F.greatest(F.size(opened) - 1, F.lit(0))), turn_of)
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_texts"), "formatted", "valid", "state", "error_turn")
