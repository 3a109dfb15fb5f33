"""Relational chat formatting.

Turns are collected per conversation as structs, sorted, and merged where neighbours have the
same role; the text of a conversation is one concatenation of Spark expressions.  The template:

    <|role|>\\n text <&> text </turn>\\n

with ``<&>`` between the texts of merged turns.  In roles and texts ``\\`` is written ``\\b``,
``<`` ``\\l`` and ``>`` ``\\g``; no other angle bracket can then stand in the output, so no text
can look like a control string and plain splitting reads every turn back exactly.

The loss mask is a list of spans of code points: one for each text of the trained role.

Only DataFrame expressions.  Defined cases: a null text or role is empty; null turn numbers come
first; rows with equal turn numbers stand by role, then text; repeated rows stand as often as
they are given; rows of a null conversation form one conversation; a conversation is one row of
the result and so has to fit one, as any text has; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
HEAD, HEAD_END, JOIN, END = "<|", "|>\n", "<&>", "</turn>\n"
#: Written order of the escapes; they are undone in the other order.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _prefix(turns: Column, turn: Column, at: Column) -> Column:
    """What stands before a turn's text: a join inside a merged message, else a new head."""
    before = F.get(turns, at - 1)
    head = F.concat(F.lit(HEAD), turn["role"], F.lit(HEAD_END))
    return (
        F.when(at == 0, head)
        .when(before["role"] == turn["role"], F.lit(JOIN))
        .otherwise(F.concat(F.lit(END), head))
    )


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = TRAINED_ROLE,
) -> DataFrame:
    """One row per conversation: ``(conv_id, formatted, loss_spans, n_messages)``.

    ``loss_spans`` are (start, length) in code points of ``formatted``, starts from 0.
    """
    one = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    collected = turns.select(F.col(conv_col).alias("conv_id"), one.alias("turn")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("turn")).alias("turns")
    )
    written = collected.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == F.lit(trained_role)).alias("trained"),
                escape(t["role"]).alias("role"),
                escape(t["text"]).alias("text"),
            ),
        ).alias("turns"),
    )
    pieces = written.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t, at: F.struct(
                t["trained"].alias("trained"), _prefix(F.col("turns"), t, at).alias("prefix"), t["text"].alias("text")
            ),
        ).alias("pieces"),
    )
    start = F.expr("named_struct('at', 0L, 'spans', cast(array() AS array<struct<start:bigint,length:bigint>>))")

    def place(done: Column, piece: Column) -> Column:
        begin = done["at"] + F.char_length(piece["prefix"])
        length = F.char_length(piece["text"]).cast("bigint")
        span = F.array(F.struct(begin.alias("start"), length.alias("length")))
        return F.struct(
            (begin + length).alias("at"),
            F.when(piece["trained"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["prefix"], p["text"])), "")
    return pieces.select(
        "conv_id",
        F.concat(text, F.lit(END)).alias("formatted"),
        F.aggregate("pieces", start, place, lambda done: done["spans"]).alias("loss_spans"),
        F.size(F.filter("pieces", lambda p: p["prefix"] != JOIN)).cast("bigint").alias("n_messages"),
    )


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted conversation, read back: array of (role, text)."""
    messages = F.slice(F.split(formatted, END), F.lit(1), F.size(F.split(formatted, END)) - 1)

    def turns(message: Column) -> Column:
        role = F.substring_index(F.substring(message, F.lit(len(HEAD) + 1), F.char_length(message)), HEAD_END, 1)
        body = F.substring(message, F.char_length(role) + len(HEAD) + len(HEAD_END) + 1, F.char_length(message))
        return F.transform(
            F.split(body, JOIN), lambda text: F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
        )

    return F.flatten(F.transform(messages, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    part = F.transform(
        spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
    )
    return unescape(F.array_join(part, ""))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the output of ``format_conversations`` says when read back."""
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return (
        formatted.select(
            "conv_id", "n_messages",
            read_turns(F.col("formatted")).alias("turns"),
            read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
            F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
            F.char_length("loss").cast("bigint").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            "formatted_chars",
            "n_messages",
        )
    )
