"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives each role the control string that opens its turns and says whether
its text counts for the loss; one control string closes every turn. Control strings
inside texts are escaped: a backslash goes in after the first character, and where one
or more stand there already, one more; taking one away restores the text. So the output
splits back into its turns. Column expressions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Opening string and loss flag by role; other roles are written out between ``named``."""

    roles: tuple[tuple[str, str, bool], ...] = (
        ("system", "[SYS]", False), ("user", "[INST]", False), ("assistant", "[/INST]", True))
    named: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    close: str = "</s>"

    def controls(self) -> list[str]:
        return [*(r[1] for r in self.roles), *self.named, self.close]


#: State -> role -> next state. All else leads to "bad", which is never left.
STEPS = {
    "start": {"system": "asked", "user": "answer"},
    "asked": {"user": "answer"},
    "answer": {"assistant": "done"},
    "done": {"user": "answer"},
}
DEFAULT = Template()


def _pattern(template: Template, slashes: str) -> str:
    tails = "|".join(re.escape(c[1:]).replace("/", "/") for c in template.controls())
    heads = "".join(sorted({re.escape(c[0]) for c in template.controls()}))
    return rf"([{heads}])({slashes})(?=(?:{tails}))"


def escape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, _pattern(template, r"\\*"), r"$1$2\\")


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, _pattern(template, r"\\*") .replace(r"(\\*)", r"(\\*)\\"), "$1$2")


def state(roles: Column) -> Column:
    """State after all turns: "done" for a whole conversation, "bad" for a wrong order."""
    moves = F.create_map(*(F.lit(x) for s, to in STEPS.items() for r, t in to.items() for x in (f"{s}>{r}", t)))
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(
        F.try_element_at(moves, F.concat(s, F.lit(">"), r)), F.lit("bad")))


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, n_turns, state, valid, segments, formatted) of each conversation.

    ``turns``: conv_id, turn, role, text. Turns go by number, ties by role and text, null
    numbers first; null roles and texts count as empty. All conversations are formatted,
    ``valid`` tells those whose turns follow the state machine to its end. ``segments``:
    the pieces (text, loss) that make up ``formatted``, end to end; only the texts of
    roles that count have a loss flag. A null conv_id is one conversation. A
    conversation is one text, so its turns meet in one row.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def opening(role: Column) -> Column:
        other = F.concat(F.lit(template.named[0]), escape(role, template), F.lit(template.named[1]))
        found = other
        for name, control, _ in template.roles:
            found = F.when(role == name, F.lit(control)).otherwise(found)
        return found

    losses = [name for name, _, loss in template.roles if loss]

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(t: Column) -> Column:
        return F.array(piece(opening(t["role"]), F.lit(False)),
                       piece(escape(t["text"], template), t["role"].isin(losses)),
                       piece(F.lit(template.close), F.lit(False)))

    found = chats.select("conv_id", F.size("t").cast("long").alias("n_turns"), state(F.transform("t", lambda t: t["role"])).alias("state"),
                         F.flatten(F.transform("t", pieces)).alias("segments"))
    return found.select("conv_id", "n_turns", "state", (F.col("state") == "done").alias("valid"), "segments",
                        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    closed = F.split(formatted, re.escape(template.close))
    parts = F.slice(closed, F.lit(1), F.size(closed) - 1)

    def turn(part: Column) -> Column:
        named = F.struct(
            unescape(F.substring_index(F.substr(part, F.lit(len(template.named[0]) + 1)), template.named[1], 1), template).alias("role"),
            unescape(F.substr(part, F.instr(part, template.named[1]) + len(template.named[1])), template).alias("text"))
        found = named
        for name, control, _ in template.roles:
            found = F.when(F.startswith(part, F.lit(control)), F.struct(
                F.lit(name).alias("role"), unescape(F.substr(part, F.lit(len(control) + 1)), template).alias("text"))).otherwise(found)
        return found

    return F.transform(parts, turn)
