"""Chat formatting with DataFrame functions only.

A declarative template names the roles, the text before and after each turn, and the roles whose text is learned.
A finite-state machine over the roles validates the order of turns. The output of a conversation is a list of text
segments with a loss flag each; their concatenation is the formatted text. Control strings inside roles and texts are
escaped with a backslash, so that the formatted text can be taken apart again.

A conversation is one output row, so its turns meet in one task; different conversations are spread by their key.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + middle + text + close for each turn. Control strings begin with `control` and hold no backslash.

    moves: (state, role) -> state. A conversation is valid if every turn has a move and the last state is in `final`.
    """

    control: str = "<|"
    open: str = "<|im_start|>"
    middle: str = "\n"
    close: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked", ("asked", "tool"): "asked",
        ("answered", "tool"): "asked",
    })


CHATML = Template()


def escape(text: Column, template: Template, line: bool = False) -> Column:
    """Backslashes double, a control string gets a backslash inside its opening; in a role (line) so does a line feed."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(template.control), F.lit(template.control[0] + "\\" + template.control[1:]))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if line else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def walk(roles: Column, template: Template) -> Column:
    """The machine's state after all roles: a struct of state and the index of the first turn without a move, or -1."""

    def move(at: Column, role: Column) -> Column:
        to = F.lit(None).cast("string")
        for (state, word), then in template.moves.items():
            to = F.when((at["state"] == state) & (role == word), F.lit(then)).otherwise(to)
        broken = (at["bad"] >= 0) | to.isNull()
        return F.struct(
            F.coalesce(to, at["state"]).alias("state"),
            F.when(at["bad"] >= 0, at["bad"]).when(broken, at["n"]).otherwise(F.lit(-1)).alias("bad"),
            (at["n"] + 1).alias("n"),
        )

    return F.aggregate(roles, F.struct(F.lit(template.start).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("n")), move)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: conv_id, valid, first_bad_turn, segments (array of text, loss), formatted.

    turns has conv_id, turn, role, text; other columns are ignored. Turns go by turn (null first), then role, then
    text, so ties and repeated rows have a fixed order. Null roles and texts count as empty. Rows with a null conv_id
    are one conversation. Conversations that break the turn order are formatted all the same, with valid = false and
    the index of the first turn without a move (the number of turns if only the end is wrong). No rows give no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(t: Column) -> Column:
        return F.array(
            piece(F.concat(F.lit(template.open), escape(t["role"], template, line=True), F.lit(template.middle)), F.lit(False)),
            piece(escape(t["text"], template), t["role"].isin(*template.learned)),
            piece(F.lit(template.close), F.lit(False)),
        )

    out = grouped.select("conv_id", walk(F.transform("turns", lambda t: t["role"]), template).alias("at"), F.flatten(F.transform("turns", pieces)).alias("segments"))
    valid = (F.col("at.bad") < 0) & F.col("at.state").isin(*template.final)
    return out.select(
        "conv_id",
        valid.alias("valid"),
        F.when(valid, F.lit(-1)).when(F.col("at.bad") >= 0, F.col("at.bad")).otherwise(F.col("at.n")).alias("first_bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_chats(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (array of role, text) of a formatted text. No escaped text holds an opening, so the split is exact."""
    parts = F.filter(F.split(formatted, re.escape(template.open)), lambda part, i: i > 0)

    def turn(part: Column) -> Column:
        role = F.regexp_extract(part, r"(?s)\A((?:[^\\\n]|\\.)*+)\n", 1)
        text = F.substring(part, F.length(role) + len(template.middle) + 1, F.length(part) - F.length(role) - len(template.middle) - len(template.close))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def chat_digest(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid: read back from formatted and segments."""
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    read = chats.select("conv_id", "valid", "formatted", read_chats(F.col("formatted"), template).alias("turns"), F.array_join(learned, "").alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
