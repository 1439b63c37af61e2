"""Chat formatting with typed content parts, in DataFrame functions only.

A turn has a role and content: a text, or a list of typed parts (text, image, audio, document). A visitor flattens
the parts in order: text is escaped, every other part becomes a placeholder ``<image 0/>``, numbered through the
conversation's turn, and its reference and expanded token count are recorded. A turn is then::

    <turn role>\\ncontent</turn>\\n

``&`` and ``<`` of roles and texts are written ``&amp;`` and ``&lt;``, line ends of roles ``&#10;``, so that no text can hold a control string and
every text comes back unchanged. The loss mask lists (start, length) in code points of what the assistant says.

Token counts: an image counts ceil(width / 14) * ceil(height / 14), audio 25 a second, a document 256 a page, a text
its words; unknown measures count 1.

Defined cases: null text is empty, null parts are the text alone, a null role is the empty role; turns sort by turn,
then role, then text as given, nulls first, then by their parts' content; repeated rows are repeated turns; a null conversation id is a conversation of its
own; an empty table gives an empty result; other columns are ignored. A conversation is one value of its own, so it
has to fit a row, as its formatted text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, named, text_of

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256
END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def part_tokens(part: Column) -> Column:
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return (
        F.when(part["type"] == "text", F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(WORD)))
        .when(part["type"] == "image", F.coalesce(image, F.lit(1)))
        .when(part["type"] == "audio", F.coalesce(F.ceil(part["seconds"] * AUDIO_RATE), F.lit(1)))
        .when(part["type"] == "document", F.coalesce(part["pages"] * PAGE_TOKENS, F.lit(1)))
        .otherwise(F.lit(1))
        .cast("long")
    )


def visit(parts: Column) -> tuple[Column, Column, Column]:
    """(content, attachments, tokens) of a list of parts."""
    is_text = lambda p: p["type"].eqNullSafe("text")
    other = F.filter(parts, lambda p: ~is_text(p))
    kind = lambda p: escape(F.coalesce(p["type"], F.lit("part")))
    slot = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i), lambda p: ~is_text(p))).cast("string")
    placeholder = lambda p, i: F.concat(F.lit("<"), kind(p), F.lit(" "), slot(i), F.lit("/>"))
    shown = F.array_join(F.transform(parts, lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p, i))), "")
    refs = F.transform(other, lambda p, i: F.struct(i.alias("slot"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    return shown, refs, F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + part_tokens(p))


def format_chat(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None
) -> DataFrame:
    """One row per conversation: id, formatted, loss_mask [(start, length)], attachments, n_tokens."""
    empty = F.lit(None).cast(PARTS)
    given = named(parts_col) if parts_col else empty
    said = text_of(text_col)
    alone = F.array(
        F.struct(
            F.lit("text").alias("type"), said.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    ).cast(PARTS)
    rows = turns.select(named(conv_col).alias("conv"), named(turn_col).alias("turn"), text_of(role_col).alias("role"), said.alias("text"), F.coalesce(given, alone).alias("parts"))
    content, refs, tokens = visit(F.col("parts"))
    rows = rows.select("conv", F.struct("turn", "role", "text", content.alias("content"), refs.alias("refs"), tokens.alias("tokens")).alias("t"))
    talks = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    head = lambda t: F.concat(F.lit("<turn "), escape_role(t["role"]), F.lit(">\n"))
    whole = F.transform("t", lambda t: F.concat(head(t), t["content"], F.lit(END)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + F.length(head(t))).cast("long").alias("start"), F.length(t["content"]).cast("long").alias("length"))
        end = acc["at"] + F.length(head(t)) + F.length(t["content"]) + len(END)
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return talks.select(
        F.col("conv").alias(conv_col),
        F.array_join(whole, "").alias("formatted"),
        F.aggregate("t", start, step, lambda acc: acc["spans"]).alias("loss_mask"),
        F.flatten(F.transform("t", lambda t, i: F.transform(t["refs"], lambda r: F.struct(i.alias("turn"), r["slot"].alias("slot"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"]).alias("n_tokens"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation, [(role, text)], placeholders left as they stand."""
    turns = F.filter(F.split(formatted, END), lambda x: x != "")
    pattern = r"(?s)^<turn ([^<]*?)>\n(.*)$"
    return F.transform(turns, lambda x: F.struct(unescape_role(F.regexp_extract(x, pattern, 1)).alias("role"), unescape(F.regexp_extract(x, pattern, 2)).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
