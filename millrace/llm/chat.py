"""Chat formatting: typed content parts, an escaping template, and a loss mask.

A message's content is an array of parts (``PART``). A visitor turns each into
text: text parts are escaped character by character, others become a placeholder
in their order, with an attachment record. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Type of one content part. ``kind`` is text, image, audio or document; sizes that don't apply are null.
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"

#: Marks of the template.
HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"

#: Tokens that a placeholder stands for: by image patch of so many pixels a side, by second, by page.
IMAGE_PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512


def text_part(text: Column) -> Column:
    """A content of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("uri"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


#: Characters that marks are made of, and what stands for them in texts and in roles. No replacement holds one of them
#: but the escape character itself, so that no mark can form inside a text, across parts or at their ends.
_TEXT = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
_ROLE = (("%", "%25"), (":", "%3A"), ("#", "%23"), ("<", "%3C"))


def escape(text: Column) -> Column:
    """A text without ``#`` and ``<``, in which every backslash begins a replacement; ``unescape`` brings the text back."""
    for mark, instead in _TEXT:
        text = F.replace(text, F.lit(mark), F.lit(instead))
    return text


def unescape(text: Column) -> Column:
    for mark, instead in reversed(_TEXT):
        text = F.replace(text, F.lit(instead), F.lit(mark))
    return text


def _role(role: Column) -> Column:
    for mark, instead in _ROLE:
        role = F.replace(role, F.lit(mark), F.lit(instead))
    return role


def _read_role(role: Column) -> Column:
    for mark, instead in reversed(_ROLE):
        role = F.replace(role, F.lit(instead), F.lit(mark))
    return role


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for text. A missing size counts as the least one."""
    at_least = lambda c, least: F.greatest(F.coalesce(c, F.lit(least)), F.lit(least))
    patches = lambda c: F.ceil(at_least(c, 1) / F.lit(IMAGE_PATCH))
    return (
        F.when(part["kind"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["kind"] == "audio", F.greatest(F.ceil(at_least(part["seconds"], 0.0) * AUDIO_TOKENS), F.lit(1)))
        .when(part["kind"] == "document", at_least(part["pages"], 1) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(part: Column) -> Column:
    """The text that stands for a part. A null part or one of an unknown kind stands for nothing."""
    known = part["kind"].isin("image", "audio", "document")
    return F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit("")))).when(known, F.concat(F.lit("<|"), part["kind"], F.lit("|>"))).otherwise(F.lit(""))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation of ``messages``, whose ``content`` is an array of ``PART``:

    ``conv``, ``n_turns``, ``formatted``, ``loss`` (spans of the text of roles in ``learn``: ``start`` in code points
    from 0, ``length``), ``attachments`` (``turn_no`` and ``part_no`` from 0, ``kind``, ``uri``, ``tokens``, in the
    order of their placeholders) and ``expanded`` (tokens of all placeholders).

    Turns go by ``turn`` (null first), then by role and content; repeated rows are turns of their own. Null content is
    empty and a null role is the empty one. A null ``conv`` is a conversation. An empty table gives an empty one. Extra
    columns are not read. A conversation is one row of the result and has to fit into one, as any string does.
    """
    parts = F.coalesce(F.col(content), F.array().cast(f"array<{PART}>"))
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), parts.alias("parts"))
    body = F.array_join(F.transform("parts", visit), "")
    head = F.concat(F.lit(HEAD), _role(F.col("role")), F.lit(MIDDLE))
    rows = rows.select("conv", "turn", "role", "parts", head.alias("head"), body.alias("body"))
    length = F.length("head") + F.length("body") + len(END)
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    rows = rows.withColumn("no", F.row_number().over(order) - 1).withColumn("end", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - len(END) - F.length("body")
    attached = F.filter(
        F.transform("parts", lambda p, i: F.struct(F.col("no").alias("turn_no"), i.alias("part_no"), p["kind"].alias("kind"), p["uri"].alias("uri"), expanded_tokens(p).alias("tokens"))),
        lambda a: a["kind"].isin("image", "audio", "document"),
    )
    rows = rows.select("conv", F.struct("no", F.concat("head", "body", F.lit(END)).alias("piece"), F.col("role").isin(*learn).alias("learn"), F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")).alias("span"), attached.alias("attached")).alias("t"))
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    attachments = F.flatten(F.transform("t", lambda t: t["attached"]))
    return turns.select(
        F.col("conv").alias(conv),
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["learn"]), lambda t: t["span"]).alias("loss"),
        attachments.alias("attachments"),
    ).withColumn("expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation; placeholders read as they stand."""
    pieces = F.filter(F.split(formatted, "\\Q" + END + "\\E"), lambda p: p != "")
    cut = lambda p: F.instr(p, MIDDLE)
    return F.transform(
        pieces,
        lambda p: F.struct(
            _read_role(F.substring(p, F.lit(len(HEAD) + 1), cut(p) - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(p, cut(p) + len(MIDDLE), F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under a loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
