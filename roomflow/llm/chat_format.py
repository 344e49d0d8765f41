"""Chat formatting: conversations to one training text each, with a loss mask.

Relational and native throughout: the turns of a conversation are collected as
structs and sorted, adjacent turns of one role become one block (array
functions), and the block texts are concatenated.

Template (fixed values below): ``<|turn|>role<|text|>part<|part|>part<|end|>\\n``
per block; a block of merged turns keeps one ``part`` per turn, so the original
turns can be read back. Inside roles and texts ``\\`` becomes ``\\\\`` and
``<|`` becomes ``<\\|``: no control string can appear there, and
:func:`unescape` is exact.

Defined results: null text and null role are the empty string; a null turn
sorts first; equal turn numbers are ordered by role, then text; repeated rows
are turns of their own; rows with a null conv_id form one conversation; empty
texts keep their turn (and an empty loss span); an empty table gives an empty
table; other columns are ignored. The turns of one conversation meet in one
row, since that row is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums, text_or_empty

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    """Inverse of :func:`escape`: only an escaped ``<|`` has a single backslash
    between its characters, so it is undone before the doubled ones."""
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _literal(mark: str) -> str:
    return mark.replace("|", "\\|")


def _merge(turns: Column) -> Column:
    """Sorted turn structs to blocks ``(role, parts)`` of adjacent equal roles."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
        F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return let(starts, lambda s: F.zip_with(
        s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(n)),
        lambda a, b: F.struct(
            F.get(turns, a)["role"].alias("role"),
            F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("parts"))))


def _block_text(b: Column) -> Column:
    return F.concat(F.lit(TURN), b["role"], F.lit(TEXT), F.array_join(b["parts"], PART), F.lit(END))


def _loss_spans(blocks: Column, loss_role: str) -> Column:
    """Byte spans of the loss role's parts in the formatted text, in order."""
    mark = len(PART)  # all marks have the same number of bytes
    pieces = F.flatten(F.transform(blocks, lambda b, k: F.transform(b["parts"], lambda p, j: F.struct(
        F.when(j > 0, F.lit(mark)).otherwise(
            F.when(k > 0, F.lit(3 * mark)).otherwise(F.lit(2 * mark)) + F.octet_length(b["role"])
        ).cast("bigint").alias("lead"),
        F.octet_length(p).cast("bigint").alias("size"),
        (b["role"] == F.lit(loss_role)).alias("loss")))))
    return let(pieces, lambda ps: let(
        prefix_sums(F.transform(ps, lambda p: p["lead"] + p["size"])),
        lambda ends: F.transform(
            F.filter(F.zip_with(ps, ends, lambda p, e: F.struct(
                (e - p["size"]).alias("start"), e.alias("end"), p["loss"].alias("loss"))),
                lambda z: z["loss"]),
            lambda z: F.struct(z["start"], z["end"]))))


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: the text of each conversation and the
    spans (byte offsets in its UTF-8, end exclusive) that training loss covers,
    one per turn of ``loss_role``, without marks."""
    rows = conversations.select(
        F.col("conv_id"),
        F.struct(F.col("turn").alias("turn"), text_or_empty("role").alias("role"),
                 text_or_empty("text").alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    escaped = F.transform("turns", lambda t: F.struct(
        escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    parts = let(escaped, lambda ts: let(_merge(ts), lambda bs: F.struct(
        F.array_join(F.transform(bs, _block_text), "").alias("formatted"),
        _loss_spans(bs, loss_role).alias("loss_spans"))))
    return turns.select("conv_id", parts.alias("f")).select("conv_id", "f.formatted", "f.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The original ``(role, text)`` turns of a formatted text, in order."""
    blocks = F.split(formatted, _literal(TURN))

    def turns(b: Column) -> Column:
        return let(F.split(F.substring_index(b, END, 1), _literal(TEXT)), lambda h: F.transform(
            F.split(F.get(h, 1), _literal(PART)),
            lambda p: F.struct(unescape(F.get(h, 0)).alias("role"), unescape(p).alias("text"))))

    return let(blocks, lambda bs: F.flatten(F.transform(F.slice(bs, F.lit(2), F.size(bs)), turns)))


def read_loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return let(formatted.cast("binary"), lambda b: F.array_join(F.transform(
        loss_spans, lambda s: unescape(F.substring(
            b, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"))), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what is read back from :func:`format_conversations`."""
    back = formatted.select(
        "conv_id", read_turns(F.col("formatted")).alias("turns"),
        read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
