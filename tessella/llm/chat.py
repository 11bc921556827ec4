"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor walks the parts of every turn in order: text is escaped, an image, audio or document part
becomes a placeholder numbered within its turn, and its reference and expanded token count are
recorded. The template marks turns with control strings; the same strings inside texts and roles are
escaped reversibly, so that the turns can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"

# Control strings of common chat templates, and what stands for their first character.
CONTROLS = ["<|", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
ENTITIES = {"<": "&lt;", "[": "&lb;"}

# Tokens that one attachment expands to, by kind, times its units (tiles, seconds, pages).
EXPANSION = {"image": 256, "audio": 50, "document": 800}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(ENTITIES[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for plain, entity in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text"))


def _visit(parts: Column) -> Column:
    """The flattened body of a turn; texts that follow each other are joined before they are escaped, so that no control string forms at a border."""
    flat = F.transform(
        parts,
        lambda p, i: F.struct(
            (_kind(p) == "text").alias("plain"),
            F.when(_kind(p) == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.concat(F.lit("<|"), escape(_kind(p)), F.lit(":"), i.cast("string"), F.lit("|>"))).alias("body"),
        ),
    )
    return F.aggregate(
        flat,
        F.struct(F.lit("").alias("done"), F.lit("").alias("open")),
        lambda acc, x: F.struct(
            F.when(x["plain"], acc["done"]).otherwise(F.concat(acc["done"], escape(acc["open"]), x["body"])).alias("done"),
            F.when(x["plain"], F.concat(acc["open"], x["body"])).otherwise(F.lit("")).alias("open"),
        ),
        lambda acc: F.concat(acc["done"], escape(acc["open"])),
    )


def _attachments(parts: Column) -> Column:
    placed = F.transform(parts, lambda p, i: F.struct(i.alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens")))
    return F.filter(placed, lambda a: a["kind"] != "text")


def _expanded(part: Column) -> Column:
    each = F.lit(0)
    for kind, tokens in EXPANSION.items():
        each = F.when(_kind(part) == kind, tokens).otherwise(each)
    return (each * F.coalesce(part["units"], F.lit(1))).cast("long")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """``(conv_id, formatted, attachments)``: one row per conversation.

    ``parts_col`` is an array of ``struct(kind, text, ref, units)``; without it each row's text is one
    text part. ``attachments`` lists ``(turn, kind, ref, tokens, part)`` in order of turn and part.
    Null texts, roles and parts count as empty, a part without kind as text. Turns with equal number
    are ordered by role and body; repeated rows stay. Null ids form one conversation; a null turn
    comes first. An empty table gives an empty one; other columns are not read.
    """
    text_part = F.struct(F.lit("text").alias("kind"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))
    parts = F.array(text_part) if parts_col is None else F.coalesce(F.col(parts_col), F.array(text_part))
    each = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))
    shown = each.select("conv_id", F.struct("turn", "role", _visit(F.col("parts")).alias("body"), _attachments(F.col("parts")).alias("attachments")).alias("t"))
    whole = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _in_order).alias("t"))
    line = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY), t["body"], F.lit(END))
    record = lambda t: F.transform(t["attachments"], lambda a: F.struct(t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"), a["part"].alias("part")))
    return whole.select("conv_id", F.array_join(F.transform("t", line), "").alias("formatted"), F.flatten(F.transform("t", record)).alias("attachments"))


def _in_order(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for k in ("body", "role", "turn"):  # the last one decides first
        x, y = a[k], b[k]
        if k == "turn":
            low = -(1 << 63)
            x, y = F.coalesce(x, F.lit(low)), F.coalesce(y, F.lit(low))
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns)``: turns parsed from the text, unescaped; ``masked`` marks those under the loss mask.

    ``formatted`` is what ``format_chats`` returns. A null or empty text has no turns; repeated rows and null ids
    come out as they are, an empty table gives an empty one, and other columns are not read.
    """
    parse = lambda s: F.struct(
        unescape(F.substring_index(s, BODY, 1)).alias("role"),
        unescape(F.replace(F.substring_index(s, BODY, -1), F.lit(END), F.lit(""))).alias("text"),
        (F.substring_index(s, BODY, 1) == "assistant").alias("masked"),
    )
    return formatted.select("conv_id", "formatted", F.transform(_segments(), parse).alias("turns"))


def _segments() -> Column:
    return F.slice(F.split(F.coalesce("formatted", F.lit("")), r"<\|turn\|>"), 2, 1 << 30)


def mask_spans() -> Column:
    """Start and end (code points, end exclusive) of each assistant body in ``formatted``, in order."""
    sizes = F.transform(_segments(), lambda s: F.struct(F.char_length(s).alias("n"), F.char_length(F.substring_index(s, BODY, 1)).alias("role"), (F.substring_index(s, BODY, 1) == "assistant").alias("on")))
    walk = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + len(TURN) + s["n"]).alias("at"),
            F.when(s["on"], F.array_append(acc["spans"], F.struct((acc["at"] + len(TURN) + s["role"] + len(BODY)).alias("start"), (acc["at"] + len(TURN) + s["n"] - len(END)).alias("end")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return walk["spans"]


def masked_text() -> Column:
    """All text under the loss mask, cut out of ``formatted`` by the spans and unescaped, nothing between."""
    cut = lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))
    return F.array_join(F.transform(mask_spans(), cut), "")


def loss_mask(formatted: DataFrame) -> DataFrame:
    """``(conv_id, spans)``: the spans of ``mask_spans`` for each row of ``format_chats``; null or empty texts have none."""
    return formatted.select("conv_id", mask_spans().alias("spans"))
