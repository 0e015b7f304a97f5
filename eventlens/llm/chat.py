"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

Input is an event log: ``conv, seq, msg, kind, role, text``. Kinds:

* ``message``: sets the message to ``text``; with a null ``msg`` the event is
  a message of its own.
* ``delta``: appends ``text`` to its message (streaming).
* ``edit``: replaces what the message holds.
* ``regenerate``: empties the message; deltas after it make the new answer.

Events of a message are sorted by sequence and folded from the last one that
resets it; messages of a conversation are sorted by their first sequence
number (ties: message id, role, text) and rendered. A message without an
event that names a role has an empty one. Null text counts as empty. A log
without events gives no rows; null conversation ids form one conversation.
What one task gathers is one message, then one conversation, which is the
size of the output row. Extra columns are ignored.

The template writes ``<|turn|>role\\n`` body ``<|end|>`` for each turn. In
roles and bodies every backslash is doubled and every control string of
common chat templates gets a backslash after its first character, so none
occurs inside a text and the reader recovers every byte. ``loss`` lists start
and length, in code points, of the assistant bodies.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this and other public chat templates.
CONTROL = (
    TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
)
ASSISTANT = "assistant"
RESETS = ("message", "edit", "regenerate")


def _java(text: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", text)


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    inside = "|".join(f"{_java(s[0])}(?={_java(s[1:])})" for s in CONTROL)
    return F.regexp_replace(doubled, f"({inside})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: ``conv, at, msg, role, text``, one row each."""
    empty = F.lit("")
    alone = F.col("msg").isNull() & (F.col("kind") == "message")
    single = events.filter(alone).select(
        "conv", F.col("seq").alias("at"), F.lit(None).cast("string").alias("msg"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
    )
    logs = (
        events.filter(~F.coalesce(alone, F.lit(False)))
        .groupBy("conv", F.col("msg").cast("string").alias("msg"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    )
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i + 1).otherwise(1)))
    folded = logs.select(
        "conv",
        F.col("log")[0]["seq"].alias("at"),
        "msg",
        F.coalesce(F.get(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), 0), empty).alias("role"),
        F.array_join(
            F.transform(F.slice("log", last, F.size("log")), lambda e: F.when(e["kind"] == "regenerate", empty).otherwise(F.coalesce(e["text"], empty))),
            "",
        ).alias("text"),
    )
    return single.unionByName(folded)


def render(messages: DataFrame) -> DataFrame:
    """``conv, formatted, loss`` for each conversation."""
    turns = messages.select(
        "conv",
        F.struct(
            "at", "msg", "role", "text",
            F.regexp_replace(escape(F.col("role")), "\n", "\\\\\n").alias("head"), escape(F.col("text")).alias("body"),
        ).alias("turn"),
    ).groupBy("conv").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    formatted = F.array_join(
        F.transform("turns", lambda t: F.concat(F.lit(TURN), t["head"], F.lit("\n"), t["body"], F.lit(END))), ""
    )
    span = "struct<start: bigint, length: bigint>"
    start = lambda s, t: s["end"] + len(TURN) + F.length(t["head"]) + 1
    loss = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda s, t: F.struct(
            (start(s, t) + F.length(t["body"]) + len(END)).alias("end"),
            F.when(
                t["role"] == ASSISTANT,
                F.concat(s["spans"], F.array(F.struct(start(s, t).alias("start"), F.length(t["body"]).cast("bigint").alias("length")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return turns.select("conv", formatted.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv, turns`` (role, text) and ``loss_text``, from the rendered text and the mask alone."""
    head = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    parts = F.slice(F.split("formatted", _java(TURN)), 2, F.length("formatted"))
    turns = F.transform(
        F.transform(parts, lambda p: F.substring(p, F.lit(1), F.length(p) - len(END))),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")
        ),
    )
    masked = F.transform(
        "loss", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    return formatted.select("conv", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")
