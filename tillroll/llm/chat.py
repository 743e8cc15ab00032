"""Chat formatting: a finite-state machine over roles and a declarative template.

Rows (one per turn) become one formatted text per conversation and its
segments, each with a loss flag.  Everything is a DataFrame expression.

Control strings start with ``<``.  Inside roles and texts ``\\`` becomes
``\\e``, ``<`` becomes ``\\l`` and, in roles, ``|`` becomes ``\\p``; so no text can
hold a control string, every backslash begins an escape, and undoing them in
the order ``\\l``, ``\\p``, ``\\e`` gives the text back.

The machine starts in ``start`` and moves with each role; a role without a move
leads to ``error``, which it never leaves.  A conversation is ``valid`` when it
ends in an accepting state.  Invalid ones are formatted too.

Defined cases: a null text or role counts as empty; a null turn comes first;
equal turns are ordered by role, then text; repeated rows are repeated turns; a
null conv_id is one conversation; roles outside the template use its default
entry; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"
#: role -> what stands around its text, and whether its text is learnt.
TEMPLATE = {
    "system": {"open": "<|system|>", "close": END, "loss": False},
    "user": {"open": "<|user|>", "close": END, "loss": False},
    "assistant": {"open": "<|assistant|>", "close": END, "loss": True},
}
#: For other roles; ``{role}`` is the escaped role.
DEFAULT = {"open": "<|{role}|>", "close": END, "loss": False}
#: (state, role) -> state.
MOVES = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}
ACCEPTING = ("user", "assistant")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("|"), F.lit("\\p"))


def unescaped(text: Column) -> Column:
    for mark, plain in (("\\l", "<"), ("\\p", "|"), ("\\e", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def _by_role(role: Column, part: str, template: dict, default: dict) -> Column:
    other = default[part]
    out = F.lit(other)
    if part != "loss" and "{role}" in other:
        before, after = other.split("{role}")
        out = F.concat(F.lit(before), escaped_role(role), F.lit(after))
    for name, entry in template.items():
        out = F.when(role == name, F.lit(entry[part])).otherwise(out)
    return out


def final_state(roles: Column) -> Column:
    moves = F.create_map(*(F.lit(x) for (state, role), to in MOVES.items() for x in (f"{state}>{role}", to)))
    step = lambda state, role: F.coalesce(F.element_at(moves, F.concat(state, F.lit(">"), role)), F.lit("error"))
    return F.aggregate(roles, F.lit("start"), step)


def format_conversations(rows: DataFrame, template: dict = TEMPLATE, default: dict = DEFAULT) -> DataFrame:
    """``conv_id, valid, formatted, segments(array of text, loss)``; the
    segments' texts joined are ``formatted``."""
    turns = rows.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        part = lambda name: _by_role(t["role"], name, template, default)
        plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        said = F.struct(escaped(t["text"]).alias("text"), part("loss").alias("loss"))
        return F.array(plain(part("open")), said, plain(part("close")))

    made = held.select(
        "conv_id",
        final_state(F.transform("turns", lambda t: t["role"])).isin(*ACCEPTING).alias("valid"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return made.select("conv_id", "valid", joined.alias("formatted"), "segments")


def parsed_turns(formatted: Column, end: str = END) -> Column:
    """The turns (role, text) of a formatted text, escapes undone."""
    whole = F.filter(F.split(formatted, end.replace("|", "\\|")), lambda p: p != "")
    mark = r"(?s)^<\|([^|]*)\|>(.*)$"
    return F.transform(
        whole,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, mark, 1)).alias("role"),
            unescaped(F.regexp_extract(p, mark, 2)).alias("text"),
        ),
    )


def learnt(segments: Column) -> Column:
    """All text under the loss mask, escapes undone."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted output says when read back."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return formatted.withColumns({"turns": parsed_turns(F.col("formatted")), "learnt": learnt(F.col("segments"))}).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
