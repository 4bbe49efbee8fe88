"""Chat formatting of typed content parts, with DataFrame functions only.

A turn's content is a list of parts (type, text, ref, tokens). Text parts are escaped;
image, audio and document parts become one placeholder each, in order, and are recorded
as attachments with the tokens they expand to. Backslashes and the opening of control
strings are escaped, so no text can end a turn, and reading back restores every text.

Defined cases: null text and null role count as empty; a null or empty content is an empty
turn; an unknown part type is a generic attachment; a null turn number sorts first; turns
with equal numbers follow role, then text; a null conversation id is a conversation; an empty table gives no
rows. Other columns are passed over. One conversation is one string, so it has to fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, CLOSE, BEGIN, END = "<|", "|>", "<|im_start|>", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
CONTENT = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
#: Tokens that a placeholder stands for when the part does not say.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}


def _escape(text: Column, newline: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(OPEN), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if newline else out


def _unescape(text: Column) -> Column:
    """Undo ``_escape``: doubled backslashes are taken first, from the left."""
    plain = F.transform(
        F.split(text, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    )
    return F.array_join(plain, "\\")


def text_content(text: str | Column = "text") -> Column:
    """The content of a turn that is plain text."""
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    part = F.struct(F.lit("text").alias("type"), value.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))
    return F.array(part).cast(CONTENT)


def _visit(part: Column) -> Column:
    """What a part shows in the formatted text."""
    kind = part["type"]
    shown = F.when(kind.isNull() | (kind == "text"), _escape(F.coalesce(part["text"], F.lit(""))))
    for name, mark in PLACEHOLDERS.items():
        shown = shown.when(kind == name, F.lit(mark))
    return shown.otherwise(F.lit(OTHER))


def _expanded(part: Column) -> Column:
    default = F.lit(0).cast("bigint")
    for name, n in DEFAULT_TOKENS.items():
        default = F.when(part["type"] == name, F.lit(n).cast("bigint")).otherwise(default)
    return F.coalesce(part["tokens"], default)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """One row per conversation.

    ``formatted``: the text. ``loss_spans``: (turn, start, length, within) of every assistant
    body, in code points of ``formatted`` and of the turn's rendering. ``attachments``:
    (turn, part, type, ref, tokens) in reading order. ``expanded_tokens``: their tokens.
    """
    parts = F.filter(F.coalesce(F.col(content).cast(CONTENT), F.array().cast(CONTENT)), lambda p: p.isNotNull())
    speaker = F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), speaker.alias("role"), parts.alias("parts"))
    rows = rows.withColumn("head", F.concat(F.lit(BEGIN), _escape(F.col("role"), newline=True), F.lit("\n")))
    rows = rows.withColumn("body", F.array_join(F.transform("parts", _visit), ""))
    attached = F.filter(
        F.transform("parts", lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens"))),
        lambda a: a["type"].isNotNull() & (a["type"] != "text"),
    )
    rows = rows.select("conv", "turn", "role", "body", F.concat("head", "body", F.lit(END)).alias("shown"), F.length("head").alias("within"), attached.alias("attached"))
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    placed = rows.withColumn("at", F.row_number().over(order) - 1).withColumn(
        "start", F.coalesce(F.sum(F.length("shown").cast("bigint")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    )
    one = F.struct("at", "shown", "start", "within", F.length("body").alias("length"), (F.col("role") == "assistant").alias("learn"), "attached")
    whole = placed.groupBy("conv").agg(F.sort_array(F.collect_list(one)).alias("t"))
    learnt = F.filter("t", lambda x: x["learn"])
    spans = F.transform(
        learnt, lambda x: F.struct(x["at"].alias("turn"), (x["start"] + x["within"]).alias("start"), x["length"].alias("length"), x["within"].alias("within"))
    )
    things = F.flatten(F.transform("t", lambda x: F.transform(x["attached"], lambda a: F.struct(x["at"].alias("turn"), a["part"], a["type"], a["ref"], a["tokens"]))))
    out = whole.select(
        F.col("conv").alias(conv),
        F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.col("t.shown"), "").alias("formatted"),
        spans.alias("loss_spans"),
        things.alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: str | Column = "formatted") -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    value = F.col(formatted) if isinstance(formatted, str) else formatted
    shown = F.filter(F.split(value, r"<\|im_end\|>\n", -1), lambda x: x != "")

    def parse(x: Column) -> Column:
        inner = F.substring(x, len(BEGIN) + 1, 2**31 - 1)
        speaker = F.substring_index(inner, "\n", 1)
        rest = F.substr(inner, F.length(speaker) + 2)
        return F.struct(_unescape(speaker).alias("role"), _unescape(rest).alias("text"))

    return F.transform(shown, parse)


def read_loss_text(formatted: str | Column = "formatted", spans: str | Column = "loss_spans") -> Column:
    """All text under the loss mask, unescaped; each span is cut from its turn, so the work is linear."""
    value = F.col(formatted) if isinstance(formatted, str) else formatted
    masks = F.col(spans) if isinstance(spans, str) else spans
    shown = F.split(value, r"<\|im_end\|>\n", -1)
    cut = F.transform(masks, lambda s: _unescape(F.substr(F.get(shown, s["turn"]), s["within"] + 1, s["length"])))
    return F.array_join(cut, "")
