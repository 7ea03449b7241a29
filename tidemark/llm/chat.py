"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document. A visitor turns each
part into its piece of the output: text is escaped, everything else becomes the
placeholder of its kind, in order, with its reference and the tokens it expands to kept
beside. A turn reads ``<|turn|>role<|body|>content<|end|>``.

Escaping is reversible: in texts and roles, a control string gets a backslash after its
first character, also if it has some already, so no text can hold a mark and taking one
backslash away restores it. Control strings are ``<|...|>`` and the ``<s>``, ``[INST]``
and ``<<SYS>>`` families. Texts between two placeholders are escaped together, as one text:
a control string that is spread over several parts is none the less one. A mark begins with
``<`` and ends with ``>``, with which no control string goes on or begins, so a text and
a mark beside it form none.

Defined results: NULL texts and roles are empty, NULL parts and parts of unknown kind add
nothing and part no texts, NULL lists are empty; rows without a conversation id form one conversation. Turns
go by number, NULL first; rows with one number go by role and content, and repeated rows
are turns of their own. Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import name

CONTROL = r"(\|[A-Za-z0-9_]*\|>|/?s>|/?SYS>>|/?INST\])"  # what follows the first character
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
KINDS = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH = 28  # pixels to an image token's side
AUDIO_TOKENS = 12.5  # a second
PAGE_TOKENS = 800
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def text_part(text: Column) -> Column:
    """A list with one text part."""
    fields = [F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref")]
    sizes = [("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")]
    return F.array(F.struct(*fields, *[F.lit(None).cast(t).alias(n) for n, t in sizes]))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder stands for; 0 where its size is not known."""
    image = F.ceil(part["width"] / F.lit(PATCH)) * F.ceil(part["height"] / F.lit(PATCH))
    tokens = (
        F.when(part["kind"] == "image", image)
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS))
        .when(part["kind"] == "document", part["pages"].cast("bigint") * PAGE_TOKENS)
    )
    return F.coalesce(tokens, F.lit(0)).cast("bigint")


# Stand for an attachment while texts are escaped; where a text holds one itself it is spelt otherwise until then.
SPOT, SPELT = "\ue000", "\ue001"


def visit(part: Column) -> Column:
    """A part's piece before escaping: its text, or the spot of its attachment."""
    text = F.replace(F.coalesce(part["text"], F.lit("")), F.lit(SPELT), F.lit(f"{SPELT}b"))
    text = F.replace(text, F.lit(SPOT), F.lit(f"{SPELT}a"))
    return F.when(part["kind"] == "text", text).when(part["kind"].isin(*KINDS), SPOT).otherwise("")


def runs(parts: Column) -> Column:
    """The escaped texts before, between and after the attachments: one more than there are attachments."""
    joined = F.split(escaped(F.array_join(F.transform(parts, visit), "")), SPOT, -1)
    restored = lambda t: F.replace(F.replace(t, F.lit(f"{SPELT}a"), F.lit(SPOT)), F.lit(f"{SPELT}b"), F.lit(SPELT))
    return F.transform(joined, restored)


def attachments_of(parts: Column) -> Column:
    attached = F.filter(parts, lambda p: F.coalesce(p["kind"].isin(*KINDS), F.lit(False)))
    return F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))


def formatted(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts",
    loss_role: str = LOSS_ROLE,
) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, formatted, loss_mask, attachments, attachment_tokens.

    ``loss_mask`` lists (start, length) in characters of ``formatted`` of each text of
    ``loss_role``, texts without an attachment between them as one; ``attachments`` lists (turn, kind, ref, tokens) in the placeholders' order.
    """
    role = F.coalesce(name(role_col), F.lit(""))
    rows = turns.select(
        name(conv_col).alias("conv_id"),
        name(turn_col).alias("turn"),
        role.alias("role"),
        F.coalesce(name(parts_col), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    rows = rows.select("conv_id", "turn", "role", runs(F.col("parts")).alias("runs"), attachments_of(F.col("parts")).alias("marks"))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY))
    mark = lambda m: F.coalesce(F.concat(F.lit("<|"), m["kind"], F.lit("|>")), F.lit(""))
    pieces = F.zip_with("runs", "marks", lambda r, m: F.struct(r.alias("text"), mark(m).alias("mark")))
    rows = rows.withColumn("pieces", pieces).withColumn("head", head)
    rows = rows.withColumn("content", F.array_join(F.transform("pieces", lambda p: F.concat(p["text"], p["mark"])), ""))
    rows = rows.withColumn("string", F.concat("head", "content", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn(
        "start",
        F.coalesce(F.sum(F.length("string")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"),
    )
    # Where each text starts: the lengths up to there, added up once.
    sizes = F.transform("pieces", lambda p: F.struct(F.length(p["text"]).alias("text"), F.length(p["mark"]).alias("mark")))
    nothing = F.array().cast("array<struct<start:bigint,length:bigint>>")
    spans = F.aggregate(
        sizes,
        F.struct(F.col("start").cast("bigint").alias("at"), nothing.alias("spans")),
        lambda done, p: F.struct(
            (done["at"] + p["text"] + p["mark"]).alias("at"),
            F.when(p["text"] > 0, F.concat(done["spans"], F.array(F.struct(done["at"].alias("start"), p["text"].cast("bigint").alias("length")))))
            .otherwise(done["spans"]).alias("spans"),
        ),
        lambda done: done["spans"],
    )
    masked = F.when(F.col("role") == loss_role, spans)
    attached = F.transform(
        "marks", lambda p: F.struct(F.col("at").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))
    )
    whole = rows.withColumn("loss", F.coalesce(masked, nothing)).withColumn("attached", attached).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "string", "loss", "attached"))).alias("turns")
    )
    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return whole.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["string"]), "").alias("formatted"),
        F.flatten(F.transform("turns", lambda t: t["loss"])).alias("loss_mask"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(text: Column) -> Column:
    """Back from the formatted text: an array of (role, content), contents unescaped."""
    chunks = F.filter(F.split(text, r"<\|turn\|>"), lambda c: c != "")
    return F.transform(
        chunks,
        lambda c: F.struct(
            unescaped(F.substring_index(c, BODY, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(c, BODY, -1), END, 1)).alias("content"),
        ),
    )


def under_mask(text: Column, mask: Column) -> Column:
    """The texts under a loss mask, unescaped, one after the other."""
    return F.array_join(
        F.transform(mask, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
