r"""Chat formatting with DataFrame functions only.

A conversation's turns become one string.  Each turn is

    ``### `` role ``\n`` content ``</turn>\n``

and control strings inside a role or a content are written with a backslash and
one digit: ``\0`` for a backslash, ``\1`` for ``</turn>``, ``\2`` for ``### ``
and, in roles, ``\3`` for a line feed.  So no text holds a control string, and
as each backslash starts such a pair, the way back is exact.

Content can be typed parts.  A visitor over the parts keeps text, and writes
``<image:i>``, ``<audio:i>`` or ``<document:i>`` for the i-th attachment of the
conversation (from 0), records its reference, and counts the tokens that the
placeholder expands to.  A part of any other type is written ``<other:i>`` and
its text, if it has one; its own type and reference are recorded, with no tokens.
A part without type is text.  Text that looks like a placeholder is no
attachment: ``<`` before ``image:``, ``audio:``, ``document:`` or ``other:`` is
written ``\4``.
Attachments are numbered over the whole conversation at once: the visitor writes
``\5``, which no escaped text holds, in each placeholder, and the string is split
there and joined with the numbers, so work is linear in turns and parts.

The loss mask of a conversation is an array of spans, one for each assistant
turn: the turn's index, and where in that turn's piece of the formatted string
the content starts and how long it is, in code points.

Defined results: turns are ordered by turn, and repeated turn numbers by role and
content; a null text is empty; a null role is an empty role; a null turn comes
first; rows without conversation id form one conversation of their own; an empty
table gives no conversation; other columns are dropped.  A conversation is one
row in the end, so it is as large as its texts; before, each task gathers its own
turns (partial aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
#: Expansion of an attachment. Image: one token for each patch; audio: tokens for each second; document: tokens for each page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512
_KINDS = ("image", "audio", "document")
_PLACES = (*_KINDS, "other")


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit(CLOSE), F.lit("\\1")), F.lit(OPEN), F.lit("\\2"))
    if role:
        return F.replace(out, F.lit("\n"), F.lit("\\3"))
    for kind in _PLACES:
        out = F.replace(out, F.lit(f"<{kind}:"), F.lit(f"\\4{kind}:"))
    return out


def unescape(text: Column) -> Column:
    """Replacements hold no backslash but the last, so none makes a new pair."""
    for code, what in (("\\4", "<"), ("\\3", "\n"), ("\\2", OPEN), ("\\1", CLOSE), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(what))
    return text


def text_part(text: Column) -> Column:
    """A content of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("width"), none.cast("long").alias("height"), none.cast("double").alias("seconds"), none.cast("long").alias("pages")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"] == "text", F.lit(True))


def _attachments(parts: Column) -> Column:
    return F.filter(F.coalesce(parts, F.array().cast(_PARTS)), lambda p: ~_is_text(p))


_PARTS = "array<struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>"


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder stands for; unknown sizes count as one patch, second or page."""
    size = lambda name: F.greatest(F.coalesce(part[name], F.lit(1)), F.lit(1))
    return (
        F.when(part["type"] == "image", F.ceil(size("width") / PATCH) * F.ceil(size("height") / PATCH))
        .when(part["type"] == "audio", F.ceil(size("seconds") * AUDIO_RATE))
        .when(part["type"] == "document", size("pages") * PAGE_TOKENS).otherwise(F.lit(0)).cast("long")
    )


def _visit(parts: Column) -> Column:
    """A turn's parts as one string, with ``\\5`` for the number of an attachment."""
    said = lambda p: escape(F.coalesce(p["text"], F.lit("")))
    place = lambda kind: F.concat(F.lit("<"), kind, F.lit(":\\5>"))
    written = F.transform(parts, lambda p: F.when(_is_text(p), said(p)).when(p["type"].isin(*_KINDS), place(p["type"])).otherwise(F.concat(place(F.lit("other")), said(p))))
    return F.array_join(written, "")


def _numbered(text: Column) -> Column:
    pieces = F.split(text, r"\\5")
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i + 1 < F.size(pieces), F.concat(p, i.cast("string"))).otherwise(p)), "")


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, loss_spans, attachments (index, type, ref, tokens), attachment_tokens."""
    cells = df.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts).cast(_PARTS), F.array().cast(_PARTS)).alias("parts")).alias("cell"))
    turns = cells.groupBy("conv_id").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    raw = F.array_join(F.transform("cells", lambda c: F.concat(F.lit(OPEN), escape(c["role"], role=True), F.lit("\n"), _visit(c["parts"]), F.lit(CLOSE + "\n"))), "")
    written = turns.select("conv_id", "cells", _numbered(raw).alias("formatted")).withColumn("pieces", F.split("formatted", CLOSE + "\n"))
    found = F.flatten(F.transform("cells", lambda c: _attachments(c["parts"])))
    listed = F.transform(found, lambda p, i: F.struct(i.alias("index"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))

    def span(cell: Column, i: Column) -> Column:
        piece = F.get(F.col("pieces"), i)
        start = F.locate("\n", piece)  # a head holds no line feed
        return F.struct(i.cast("long").alias("turn"), start.cast("long").alias("start"), (F.length(piece) - start).cast("long").alias("length"), cell["role"].alias("role"))

    mask = F.filter(F.transform("cells", span), lambda m: m["role"] == "assistant")
    out = written.select("conv_id", F.size("cells").cast("long").alias("n_turns"), "formatted", F.transform(mask, lambda m: F.struct(m["turn"], m["start"], m["length"])).alias("loss_spans"), listed.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, CLOSE + "\n"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, "\n", 1).substr(F.lit(len(OPEN) + 1), F.length(p))).alias("role"),
        unescape(p.substr(F.locate("\n", p) + 1, F.length(p))).alias("text"),
    ))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; linear in the string, as each span names its turn."""
    written = F.split(formatted, CLOSE + "\n")
    return F.array_join(F.transform(spans, lambda s: unescape(F.get(written, s["turn"].cast("int")).substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = format_conversations(rows.unionByName(own).withColumn("parts", text_part(F.coalesce("text", F.lit("")))))
    read = out.select("conv_id", "n_turns", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
whole AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(13 + length(replace(replace(replace(replace(role, '\', '\0'), '</turn>', '\1'), '### ', '\2'), chr(10), '\3'))
           + length(replace(replace(replace(replace(replace(replace(replace(text, '\', '\0'), '</turn>', '\1'), '### ', '\2'),
               '<image:', '\4image:'), '<audio:', '\4audio:'), '<document:', '\4document:'), '<other:', '\4other:')))::BIGINT AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM whole
"""
