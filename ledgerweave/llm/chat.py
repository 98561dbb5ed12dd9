"""Chat formatting with column expressions only.

A template declares, for each role, which roles may come before it and whether its text is trained on. A finite-state
machine runs over a conversation's roles; its states are the roles themselves and a start state. Every turn becomes three
segments, opening mark, text and closing mark, of which only the texts of trained roles carry the loss flag. Marks cannot
occur inside a text: the backslash and both marks are replaced there by escapes that no text contains otherwise.

Defined results: turns are in the order of (turn, role, text), NULLs first, so repeated rows and ties have one order; a
NULL role or text counts as empty; rows with a NULL conversation id form one conversation. A conversation that breaks the
turn order is formatted all the same and flagged with the position of the first turn that does not fit (-1: none). A
conversation is one string in the result, so it must fit in a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Template:
    """``after``: the states after which a role may speak. ``trained``: roles whose texts carry loss."""

    after: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"system": (START,), "user": (START, "system", "assistant"), "assistant": ("user",)})
    trained: tuple[str, ...] = ("assistant",)
    opening: str = "### "
    colon: str = ": "
    closing: str = "</turn>\n"
    # Control string and its escape; the backslash itself comes first when escaping and last when reading.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("### ", "\\h"), ("</turn>", "\\t"))
    role_escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("### ", "\\h"), ("</turn>", "\\t"), (": ", "\\c"))


def escaped(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(rows: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, segments, formatted, bad_turn``; ``segments`` holds (text, loss) in order and ``formatted`` joins them."""
    t = template or Template()
    picked = rows.select(
        F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t")
    )
    turns = picked.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    legal = F.array(*[F.lit(f"{a}\n{b}") for b, before in t.after.items() for a in before])
    machine = F.aggregate(
        "turns",
        F.struct(F.lit(START).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad")),
        lambda s, x: F.struct(
            x["role"].alias("state"),
            (s["at"] + 1).alias("at"),
            F.when((s["bad"] < 0) & ~F.array_contains(legal, F.concat(s["state"], F.lit("\n"), x["role"])), s["at"]).otherwise(s["bad"]).alias("bad"),
        ),
        lambda s: s["bad"],
    )
    part = lambda words, loss: F.struct(words.alias("text"), loss.alias("loss"))
    silent = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                part(F.concat(F.lit(t.opening), escaped(x["role"], t.role_escapes), F.lit(t.colon)), silent),
                part(escaped(x["text"], t.escapes), x["role"].isin(*t.trained)),
                part(F.lit(t.closing), silent),
            ),
        )
    )
    made = turns.select("conv_id", segments.alias("segments"), machine.alias("bad_turn"))
    return made.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), "bad_turn")


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text) that a formatted conversation stands for."""
    t = template or Template()
    parts = F.split(formatted, f"\\Q{t.closing}\\E", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)  # nothing follows the last mark
    start = F.lit(len(t.opening) + 1)

    def parse(x: Column) -> Column:
        colon = F.locate(t.colon, x)
        role = F.substring(x, start, colon - start)
        return F.struct(unescaped(role, t.role_escapes).alias("role"), unescaped(F.substring(x, colon + len(t.colon), F.length(x)), t.escapes).alias("text"))

    return F.transform(turns, parse)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t.escapes)), "")
