"""Operator 10, chat formatting by prefix-target expansion, in column expressions only.

Every assistant turn becomes an example of its own: all turns before it as
context, and only that reply trainable. Turns after the last reply, which no
example would show, go to one more example that trains nothing, so that each
conversation can be read back from its last example.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts
a backslash is doubled and ``<|`` becomes ``<\\|``, so that no text can hold a
control string; a line break in a role becomes ``<\\n>``. This is reversible: an
odd backslash after ``<`` only ever comes from the template.

Defined results: a null text or role is empty; equal turn numbers are ordered
by role and text; repeated rows are turns like others; rows with a null conv_id
form one conversation; nulls in turn come first; an empty table gives no
example. A conversation's turns are held in one row, so a conversation must fit
a row (2 GB), and its output grows with the square of its turns, as the method
says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Examples ``conv_id, example, text, loss_start, loss_length`` from ``rows(conv_id, turn, role, text)``.

    ``loss_start`` (from 0) and ``loss_length`` are code points of the trainable
    part of ``text``: the escaped reply; null in an example that trains nothing.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(
            (t["role"] == TRAINED_ROLE).alias("trained"),
            F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
        )).alias("turns"),
    )
    # The context is cut at each target, then put together: no turn is formatted twice.
    convs = convs.select(
        "conv_id", "turns",
        F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))).alias("parts"),
        F.expr("filter(sequence(1, size(turns)), i -> turns[i - 1].trained or i = size(turns))").alias("ends"),
    )
    each = convs.select("conv_id", "turns", "parts", F.posexplode("ends").alias("example", "end"))
    each = each.select(
        "conv_id", "example",
        F.expr("array_join(slice(parts, 1, end), '')").alias("text"),
        F.expr("turns[end - 1].trained").alias("trained"),
        F.expr("char_length(turns[end - 1].body)").alias("body"),
    )
    tail = len(END) + 1
    return each.select(
        "conv_id", "example", "text",
        F.when(F.col("trained"), F.char_length("text") - tail - F.col("body")).alias("loss_start"),
        F.when(F.col("trained"), F.col("body")).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Turns and trained replies ``conv_id, turns, replies, formatted_chars`` out of formatted examples alone."""
    reply = F.when(F.col("loss_start").isNotNull(), unescape(F.expr("substr(text, loss_start + 1, loss_length)")))
    last = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.sort_array(F.collect_list(F.struct("example", reply.alias("reply")))).alias("replies"),
        F.sum(F.char_length("text").cast("long")).alias("formatted_chars"),
    )
    # A part is "role\ntext<|im_end|>\n"; the first, before any mark, is empty.
    parts = F.filter(F.split("text", r"<\|im_start\|>"), lambda p, i: i > 0)
    turns = F.transform(parts, lambda p: F.struct(
        _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1, F.char_length(p) - F.instr(p, F.lit("\n")) - (len(END) + 1))).alias("text"),
    ))
    return last.select(
        "conv_id", turns.alias("turns"),
        F.expr("transform(filter(replies, x -> x.reply is not null), x -> x.reply)").alias("replies"),
        "formatted_chars",
    )


def chat_digest(examples: DataFrame) -> DataFrame:
    """One row a conversation: counts and digests of what ``read_back`` finds."""
    loss = F.array_join("replies", "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(examples).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
