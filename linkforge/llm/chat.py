"""Chat formatting by a role automaton and a declarative template, in DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles carry loss, which strings are control strings, who may speak when.

    ``moves`` maps (state, role) to the next state; ``ends`` are the states a conversation may end in.
    Control strings may not hold the escape character or begin with a letter, digit or full stop.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"
    start: str = "start"
    ends: tuple[str, ...] = ("assistant",)
    moves: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})


CHATML = Template()


def escaped(text: Column, t: Template = CHATML) -> Column:
    """text without control strings: the escape character becomes ``\\e``, control string number k ``\\ck.``."""
    first = F.replace(text, F.lit(t.escape), F.lit(f"{t.escape}e"))
    return reduce(lambda c, k: F.replace(c, F.lit(k[1]), F.lit(f"{t.escape}c{k[0]}.")), enumerate(t.control), first)


def unescaped(text: Column, t: Template = CHATML) -> Column:
    """Undoes :func:`escaped`."""
    first = reduce(lambda c, k: F.replace(c, F.lit(f"{t.escape}c{k[0]}."), F.lit(k[1])), enumerate(t.control), text)
    return F.replace(first, F.lit(f"{t.escape}e"), F.lit(t.escape))


def format_conversations(turns: DataFrame, t: Template = CHATML) -> DataFrame:
    """One row per conversation of turns(conv_id, turn, role, text): conv_id, n_turns, valid, segments, formatted.

    ``segments`` is an array of (text, loss); ``formatted`` their concatenation. A turn gives three
    segments: the opening mark with role and line feed, its escaped text (loss for the template's loss
    roles), the closing mark. ``valid`` says whether the template's automaton accepts the roles; a
    conversation that it rejects is formatted all the same. Turns go by turn, ties by role, then text;
    repeated rows are turns of their own. Null text and null role count as empty, and a role is escaped
    like text, with line feeds as ``\\n``. A null conv_id is a conversation. Empty: empty. Other columns
    are ignored. A conversation is one string, so its turns meet in one task; nothing larger does.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    table = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])
    end = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("\n"), x["role"])), F.lit("rejected")))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def three(x: Column) -> Column:
        role = F.replace(escaped(x["role"], t), F.lit("\n"), F.lit(f"{t.escape}n"))
        return F.array(
            segment(F.concat(F.lit(t.open), role, F.lit("\n")), F.lit(False)),
            segment(escaped(x["text"], t), x["role"].isin(*t.loss_roles)),
            segment(F.lit(t.close), F.lit(False)),
        )

    out = talks.select("conv_id", F.size("turns").cast("long").alias("n_turns"), end.isin(*t.ends).alias("valid"), F.flatten(F.transform("turns", three)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, t: Template = CHATML) -> Column:
    """The array of (role, text) that a formatted string holds."""
    pieces = F.split(formatted, re.escape(t.close).replace("\\\n", "\n"))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = unescaped(F.replace(F.substring(head, len(t.open) + 1, 2**31 - 1), F.lit(f"{t.escape}n"), F.lit("\n")), t)
        return F.struct(role.alias("role"), unescaped(F.substring(piece, F.length(head) + 2, F.length(piece)), t).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def digests(formatted: DataFrame, t: Template = CHATML) -> DataFrame:
    """What :func:`format_conversations` holds, read back: counts and digests of all turns and of the loss text.

    Turns and loss text come out of ``formatted``; of ``segments`` only the loss flags are used. valid is
    the automaton's verdict. Empty: empty.
    """
    flags = F.transform(F.filter("segments", lambda s, i: i % 3 == 1), lambda s: s["loss"])
    back = formatted.select("conv_id", "valid", F.length("formatted").cast("long").alias("formatted_chars"), F.arrays_zip(read_back(F.col("formatted"), t).alias("turn"), flags.alias("loss")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["turn"]["role"], F.lit("\n"), x["turn"]["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["turn"]["text"]), "")
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), "formatted_chars", "valid")
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("told", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
