"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document.  A visitor, one rule per kind, flattens the parts in
order: text is escaped and kept, every attachment becomes a numbered placeholder, and its reference and the
number of tokens that the placeholder stands for are recorded.  Turns are marked with control strings; the same
strings inside texts (and those of other common templates) are escaped reversibly, so the formatted string can be
read back exactly.  The loss mask is the list of spans that assistant texts occupy.

Null conversation ids form one conversation; null turns come first; null roles, texts and part lists are empty;
parts of an unknown kind are kept as attachments without tokens.  Turns with the same number are ordered by role and
content; repeated rows stay.  An empty table gives no rows; other columns are ignored.  A conversation becomes one
string, so it must fit one row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that must not survive inside a text; each is broken after its first character.
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
PART = "struct<kind string, text string, ref string, width int, height int, seconds double, pages int>"
#: Tokens that attachments expand to: per image tile side, per audio second, per document page.
TILE, PER_SECOND, PER_PAGE = 28, 25, 400


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    for c in reversed(CONTROL):
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _visit(part: Column, number: Column) -> Column:
    """One part as (string, reference, kind, tokens); tokens of text are left to the tokenizer."""
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    known = {
        "image": F.ceil(F.coalesce(part["width"], F.lit(0)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(0)) / TILE),
        "audio": F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND),
        "document": F.coalesce(part["pages"], F.lit(0)) * F.lit(PER_PAGE),
    }
    tokens = F.lit(0).cast("long")
    for name, count in known.items():
        tokens = F.when(kind == name, count.cast("long")).otherwise(tokens)
    mark = F.concat(F.lit("<|"), F.when(kind.isin(*known), kind).otherwise(F.lit("attachment")), F.lit(":"), number.cast("string"), F.lit("|>"))
    is_text = kind == "text"
    return F.struct(
        F.when(is_text, escape(part["text"])).otherwise(mark).alias("string"), F.when(~is_text, F.coalesce(part["ref"], F.lit(""))).alias("ref"),
        F.when(~is_text, kind).alias("kind"), F.when(~is_text, tokens).alias("tokens"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """``(conv_id, formatted, loss, attachments)``: the string, (start, end) spans of assistant content, attachments in order.

    Placeholders are numbered within their turn; ``attachments`` holds (turn index, number, kind, ref, tokens).
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    rows = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.transform(F.filter(parts, lambda p: p.isNotNull()), _visit).alias("seen"))
    rows = rows.withColumn("body", F.array_join(F.transform("seen", lambda s: s["string"]), ""))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.withColumn("head", F.length(head)).withColumn("whole", F.concat(head, "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("whole")).over(before), F.lit(0))).withColumn("i", F.row_number().over(order) - 1)
    held = F.filter(F.transform("seen", lambda s, k: F.struct(F.col("i").alias("turn"), k.alias("number"), s["kind"].alias("kind"), s["ref"].alias("ref"), s["tokens"].alias("tokens"))), lambda a: a["kind"].isNotNull())
    start = F.col("at") + F.col("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "whole", span.alias("span"), held.alias("held")))).alias("t"))
    return told.select(
        "conv_id", F.array_join(F.col("t.whole"), "").alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss"), F.flatten("t.held").alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted string, unescaped; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, F.lit("<\\|turn\\|>")), lambda p: p != "")
    cut = lambda p: F.split(p, F.lit("<\\|text\\|>"))
    return F.transform(pieces, lambda p: F.struct(
        unescape(cut(p)[0]).alias("role"), unescape(F.substring(cut(p)[1], F.lit(1), F.length(cut(p)[1]) - len(END))).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
