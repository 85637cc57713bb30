"""Conversations as marked-up texts with a loss mask, and back: Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings. A block is OPEN role MID turn (NEXT turn)* CLOSE; it holds the adjacent turns of one role.
OPEN, MID, NEXT, CLOSE = "<s>[INST]", "[/INST]", "[NEXT]", "</s>"
#: Any control string, with backslashes after its first character: escaping adds one, reading back takes one away.
_ESCAPABLE = r"([<\[])(\\*)(/?s>|/?INST\]|NEXT\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|NEXT\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPABLE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def merge_turns(turns: Column) -> Column:
    """Sorted turns as blocks (role, texts), each the adjacent turns of one role."""
    heads = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def block(head: Column, number: Column, heads: Column) -> Column:
        length = F.coalesce(F.get(heads, number + 1), F.size(turns)) - head
        return F.struct(F.get(turns, head)["role"].alias("role"),
                        F.transform(F.slice(turns, head + 1, length), lambda t: t["text"]).alias("texts"))

    return F.aggregate(F.array(heads), F.array().cast("array<struct<role:string,texts:array<string>>>"),
                       lambda _, found: F.transform(found, lambda head, number: block(head, number, found)))


def block_text(block: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(block["role"]), F.lit(MID), F.array_join(F.transform(block["texts"], escape), NEXT), F.lit(CLOSE))


def format_conversations(rows: DataFrame, keep_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: one marked-up text per conversation.

    A conversation's turns are sorted by turn (then role and text), adjacent turns of one role share a block, and blocks
    are concatenated. loss_spans are the places (start, end; code points of `formatted`, end exclusive) of the texts of
    `keep_role`, one per turn, so that headers and separators stay outside the loss.
    A conversation is one row of the result, so its turns meet in one task; turns are only ever gathered by conversation.

    Null text, role: empty. Null turns come first. Null conv_id: a conversation of its own. Repeated rows are repeated
    turns. An empty table gives no rows. Other columns are not read.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    said = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("said"))
    turns = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    blocks = turns.select("conv_id", merge_turns(F.col("turns")).alias("blocks"))
    formatted = blocks.select("conv_id", "blocks", F.transform("blocks", block_text).alias("parts"))
    # Places of a block's texts follow from the lengths before them: a running sum over pieces, in one pass.
    place = "struct<at:long,spans:array<struct<start:long,end:long>>>"

    def walk(state: Column, block: Column) -> Column:
        first = state["at"] + len(OPEN) + F.length(escape(block["role"])) + len(MID)
        inner = F.aggregate(F.transform(block["texts"], escape), F.struct(first.cast("long").alias("at"), state["spans"].alias("spans")).cast(place),
                            lambda s, t: F.struct((s["at"] + F.length(t) + len(NEXT)).cast("long").alias("at"), F.when(
                                block["role"] == keep_role, F.concat(s["spans"], F.array(F.struct(
                                    s["at"].alias("start"), (s["at"] + F.length(t)).cast("long").alias("end"))))).otherwise(s["spans"]).alias("spans")).cast(place))
        return F.struct((inner["at"] - len(NEXT) + len(CLOSE)).cast("long").alias("at"), inner["spans"].alias("spans")).cast(place)

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    return formatted.select("conv_id", F.array_join("parts", "").alias("formatted"),
                            F.aggregate("blocks", none.cast(place), walk)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a marked-up text."""
    def turns(block: Column) -> Column:
        halves = F.split(block, r"\[/INST\]", -1)
        return F.transform(F.split(halves[1], r"\[NEXT\]", -1), lambda t: F.struct(
            unescape(halves[0]).alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, r"</s>(?:<s>\[INST\]|$)", -1), lambda b: b != "")
    opened = F.transform(blocks, lambda b: F.regexp_replace(b, r"^<s>\[INST\]", ""))
    return F.flatten(F.transform(opened, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
