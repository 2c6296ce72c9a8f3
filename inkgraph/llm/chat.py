"""Chat formatting over typed content parts, in DataFrame functions only.

A visitor has one branch for each kind of part: text goes into the output escaped; an
image, an audio clip or a document becomes a placeholder, and its reference and the number
of tokens that the placeholder stands for go to the attachment list.

Escaping: a backslash becomes two, then ``<|`` becomes ``<\\|``; so no control string of
the template can occur inside a text, and one replacement (a backslash and the character
after it become that character) undoes it.  In role names a line feed gets a backslash too.

Defined cases: null texts, roles and part lists are empty; rows of one conversation are
ordered by turn, role, then content, nulls first; repeated rows are repeated turns; an
empty table gives no conversation; a null conversation id is a conversation of its own; very
long texts are escaped whole; other columns are not read, whatever their names.
One conversation is one output value and so is put together by one task; its running
offsets come from a window that spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import let, pick

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A plain text column as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def visit(part: Column) -> Column:
    """What a part puts into the output, whether it is text, and the tokens its placeholder stands for."""
    kind = part["kind"]
    tokens = (
        F.when(kind == "image", F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH))
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0)).cast("long")
    )
    shown = F.when(kind.isin("image", "audio", "document"), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
    return F.struct(shown.alias("shown"), (~F.coalesce(kind.isin("image", "audio", "document"), F.lit(False))).alias("is_text"), kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("n_tokens"))


def _spans(parts: Column, first: Column) -> Column:
    """(start, length) of each text part of one turn, the first part starting at ``first``."""
    begin = F.struct(first.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out"))

    def step(acc, p):
        size = F.length(p["shown"]).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), size.alias("length")))
        return F.struct((acc["at"] + size).alias("at"), F.when(p["is_text"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, begin, step, lambda acc: acc["out"])


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation.

    ``formatted``; ``turn_starts`` (offset of each turn in it); ``loss`` (turn, start,
    length: the texts under the loss mask); ``attachments`` (turn, part, kind, ref,
    n_tokens); ``n_attachment_tokens``.
    """
    parts = F.coalesce(pick(df, parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")) if parts_col else text_part(pick(df, text_col))
    turns = df.select(
        pick(df, conv_col).alias("conv"), pick(df, turn_col).alias("turn"), F.coalesce(pick(df, role_col), F.lit("")).alias("role"),
        F.transform(parts, visit).alias("parts"),
    )
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    body = F.array_join(F.transform("parts", lambda p: p["shown"]), "")
    turns = turns.select("conv", "turn", "role", "parts", head.alias("head"), F.concat(head, body, F.lit(END + "\n")).alias("seg"))
    in_order = Window.partitionBy("conv").orderBy("turn", "role", "seg")
    turns = turns.select(
        "conv", "role", "parts", "seg", "head",
        (F.row_number().over(in_order) - 1).alias("at"),
        F.coalesce(F.sum(F.length("seg").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    loss = F.when(F.col("role") == loss_role, F.transform(_spans(F.col("parts"), F.col("start") + F.length("head")), lambda s: F.struct(F.col("at").alias("turn"), s["start"].alias("start"), s["length"].alias("length")))).otherwise(F.array().cast("array<struct<turn:int,start:bigint,length:bigint>>"))
    attached = F.filter(F.transform("parts", lambda p, i: F.struct(F.col("at").alias("turn"), i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens"), p["is_text"].alias("is_text"))), lambda a: ~a["is_text"])
    attached = F.transform(attached, lambda a: F.struct(*[a[c].alias(c) for c in ("turn", "part", "kind", "ref", "n_tokens")]))
    turns = turns.select("conv", F.struct("at", "seg", "start", loss.alias("loss"), attached.alias("attached")).alias("t"))
    chats = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    out = chats.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("ts", lambda t: t["seg"]), "").alias("formatted"),
        F.transform("ts", lambda t: t["start"]).alias("turn_starts"),
        F.flatten(F.transform("ts", lambda t: t["loss"])).alias("loss"),
        F.flatten(F.transform("ts", lambda t: t["attached"])).alias("attachments"),
    )
    return out.withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["n_tokens"]))


def segments(formatted: Column) -> Column:
    """The turns of a formatted conversation, as written."""
    return F.array_remove(F.split(formatted, r"(?<=<\|im_end\|>\n)"), "")


def read_turns(formatted: Column) -> Column:
    """(role, text) of every turn, unescaped, read from the output alone."""
    head = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)<\|im_end\|>\n$"
    return F.transform(segments(formatted), lambda s: F.struct(unescape(F.regexp_extract(s, head, 1)).alias("role"), unescape(F.regexp_extract(s, head, 2)).alias("text")))


def read_loss(formatted: Column, turn_starts: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, cut out of the output by the mask's spans."""
    return let(segments(formatted), lambda segs: let(turn_starts, lambda starts: F.transform(loss, lambda x: unescape(F.substring(F.get(segs, x["turn"]), (x["start"] - F.get(starts, x["turn"]) + 1).cast("int"), x["length"].cast("int"))))))
