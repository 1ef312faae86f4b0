"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of typed parts ``struct<type, text, ref, units>``. A visitor
(one ``aggregate`` over the parts) writes text parts with control characters escaped, puts a
placeholder for each image, audio or document part, and records the attachment (its
reference, type, place and expanded token count). Turns are rendered as

    [TURN]role[SAYS]content[END]

All control strings start with ``[``, ``<`` or hold a backslash; the escape replaces these
three characters (\\\\e, \\\\b, \\\\l), so no text holds a control string of this or of the common
``<s>``/``[INST]`` formats, a reader may split on the marks, and unescaping restores every text.

Positions are running sums of rendered lengths over the turns of a conversation, then the
rendered turns are joined: work is linear in a conversation's length. The result is one string per
conversation, so a conversation's turns meet in one task by contract.

Defined results: null text, role or part: empty; unknown part types are read as text; an
empty array gives an empty turn; a null conversation id is a conversation of its own; null
turns come first; equal turn numbers follow role, then content; an empty table gives no
rows. Other columns are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "[TURN]", "[SAYS]", "[END]"
ESCAPES = [("\\", "\\e"), ("[", "\\b"), ("<", "\\l")]
# Tokens that one unit (image tile, second of audio, document page) expands to.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 800}
PART = "struct<type:string,text:string,ref:string,units:long>"


def escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A turn of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("long").alias("units"))).cast(f"array<{PART}>")


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit("]"))


def visit(parts: Column, tokens_per_unit: dict[str, int] = TOKENS_PER_UNIT) -> Column:
    """``struct<body, length, attachments, texts>`` of a turn's parts, in order. ``texts`` are the
    spans (start, length) of text parts in the body, in code points."""
    kinds = list(tokens_per_unit)
    attachment = "array<struct<type:string,ref:string,start:long,tokens:long>>"
    start = F.struct(F.lit("").alias("body"), F.lit(0).cast("long").alias("length"),
                     F.array().cast(attachment).alias("attachments"),
                     F.array().cast("array<struct<start:long,length:long>>").alias("texts"))

    def step(acc: Column, part: Column) -> Column:
        kind = F.lower(part["type"])
        attached = F.coalesce(kind.isin(kinds), F.lit(False))
        piece = F.when(attached, placeholder(kind)).otherwise(escape(part["text"]))
        size = F.length(piece).cast("long")
        rate = F.coalesce(*[F.when(kind == k, F.lit(v).cast("long")) for k, v in tokens_per_unit.items()])
        new = F.array(F.struct(kind.alias("type"), part["ref"].alias("ref"), acc["length"].alias("start"),
                               (rate * F.coalesce(part["units"], F.lit(1).cast("long"))).alias("tokens")))
        span = F.array(F.struct(acc["length"].alias("start"), size.alias("length")))
        return F.struct(F.concat(acc["body"], piece).alias("body"), (acc["length"] + size).alias("length"),
                        F.when(attached, F.concat(acc["attachments"], new)).otherwise(acc["attachments"]).alias("attachments"),
                        F.when(attached, acc["texts"]).otherwise(F.concat(acc["texts"], span)).alias("texts"))

    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), start, step)


def format_conversations(turns: DataFrame, parts: Column | None = None, loss_role: str = "assistant",
                         conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, turns, attachments, attachment_tokens``.

    ``turns``: per turn its role, place (start, length) and the spans under the loss mask (text
    parts of ``loss_role``), all in code points of ``formatted``. ``parts`` gives a turn's
    content; by default the text column is its one text part."""
    parts = text_part(F.col(text)) if parts is None else parts
    role_cell = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), role_cell.alias("role"), visit(parts).alias("v"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    rows = rows.select("conv_id", "turn", "role", F.concat(head, F.col("v.body"), F.lit(END)).alias("rendered"),
                       F.length(head).cast("long").alias("head"), "v.attachments", "v.texts")
    rows = rows.withColumn("length", F.length("rendered").cast("long"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "rendered")
    run = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv_id", "role", "rendered", "length", "texts", "attachments", "head",
                       F.row_number().over(order).alias("at"),
                       F.coalesce(F.sum("length").over(run), F.lit(0).cast("long")).alias("start"))
    body = F.col("start") + F.col("head")
    spans = F.when(F.col("role") == loss_role, F.transform("texts", lambda s: F.struct(
        (body + s["start"]).alias("start"), s["length"].alias("length")))).otherwise(
        F.array().cast("array<struct<start:long,length:long>>"))
    placed = F.transform("attachments", lambda a: F.struct(
        a["type"].alias("type"), a["ref"].alias("ref"), (body + a["start"]).alias("start"), a["tokens"].alias("tokens")))
    rows = rows.select("conv_id", F.struct("at", "rendered", "role", "start", "length", spans.alias("loss"),
                                           placed.alias("attachments")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list("t")).alias("t"))
    out = out.withColumn("attachments", F.flatten("t.attachments"))
    return out.select(
        "conv_id", "n_turns", F.array_join("t.rendered", "").alias("formatted"),
        F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["start"].alias("start"), t["length"].alias("length"),
                                            t["loss"].alias("loss"))).alias("turns"),
        "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """The rendered turns of a formatted conversation, without their opening mark."""
    pieces = F.split(formatted, r"\[TURN\]", -1)
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def turn_role(piece: Column) -> Column:
    return unescape(F.substring_index(piece, SAYS, 1))


def turn_text(piece: Column) -> Column:
    return unescape(F.substring_index(F.substring_index(piece, SAYS, -1), END, 1))


def masked_text(formatted: Column, turns: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    mark = len(TURN)

    def under(piece: Column, t: Column) -> Column:
        return F.array_join(F.transform(t["loss"], lambda s: F.substr(
            piece, (s["start"] - t["start"] - mark + 1).cast("int"), s["length"].cast("int"))), "")

    return unescape(F.array_join(F.zip_with(read_turns(formatted), turns, under), ""))
