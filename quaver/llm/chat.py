"""Chat formatting by a finite-state machine over roles.

A declarative template says how a turn opens and closes and which roles are trained on; a table of transitions says
which role may follow which. Every conversation becomes an array of segments, each a text and a loss flag, whose
concatenation is the formatted text. Control strings inside texts are escaped with a backslash, which read_back()
undoes. Only DataFrame functions are used.

All conversations are formatted; those the machine rejects have valid = false. Null texts and roles count as empty, a
null conv_id is a conversation of its own, a null turn comes first. Turns with equal numbers are ordered by role, then
text; repeated rows are repeated turns. Only conv_id, turn, role and text are read, so other columns can't clash. An
empty table gives an empty result. A conversation is one output record and is put together in one task, from lists
that map tasks have gathered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles carry loss, and what may follow what."""

    open: str = "<|im_start|>"
    role_end: str = "\n"
    close: str = "<|im_end|>\n"
    control: str = "<|"
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("user", "assistant")
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )


CHATML = Template()


def escape(text: Column, t: Template) -> Column:
    """Doubles backslashes, then parts every control string with one."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(t.control), F.lit(f"{t.control[0]}\\{t.control[1:]}"))


def unescape(text: Column, t: Template) -> Column:
    return F.replace(F.replace(text, F.lit(f"{t.control[0]}\\{t.control[1:]}"), F.lit(t.control)), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column, t: Template) -> Column:
    """As escape(), and line ends, which end a role, become \\n after a part that texts can't have."""
    return F.replace(escape(role, t), F.lit("\n"), F.lit(f"{t.control[0]}\\n"))


def unescape_role(role: Column, t: Template) -> Column:
    return unescape(F.replace(role, F.lit(f"{t.control[0]}\\n"), F.lit("\n")), t)


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, valid, state, segments (array of text, loss) and formatted of every conversation."""
    t = template
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for a, to in t.moves.items() for role, b in to.items() for x in (f"{a}>{role}", b)])
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), x["role"])), F.lit("rejected")))

    def emitted(x: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(
            segment(F.concat(F.lit(t.open), escape_role(x["role"], t), F.lit(t.role_end)), F.lit(False)),
            segment(escape(x["text"], t), x["role"].isin(*t.loss)),
            segment(F.lit(t.close), F.lit(False)),
        )

    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.alias("state"), F.flatten(F.transform("turns", emitted)).alias("segments"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", "n_turns", F.col("state").isin(*t.accept).alias("valid"), "state", "segments", text.alias("formatted"))


def read_back(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, turns (array of role, text) parsed from `formatted`, loss_text from the segments under the mask, formatted."""
    t = template

    def turn(piece: Column) -> Column:
        at = F.instr(piece, t.role_end)
        text = F.substring(piece, at + F.lit(len(t.role_end)), F.length(piece) - at - F.lit(len(t.role_end) - 1 + len(t.close)))
        return F.struct(unescape_role(F.substring(piece, F.lit(1), at - 1), t).alias("role"), unescape(text, t).alias("text"))

    pieces = F.split("formatted", re.escape(t.open).replace("<", "[<]"), -1)
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t))
    return chats.select("conv_id", F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted", "valid", "state")
