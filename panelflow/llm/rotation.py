"""Chat samples by perspective rotation: every participant becomes the assistant once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Speakers that stay what they are and get no sample of their own.
NEUTRAL = ("system",)


def _plain(c: Column) -> Column:
    """Text that cannot be taken for a template mark."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, width: int = 256, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The whole dialogue for each participant of each conversation, in one row or several.

    ``text`` is the dialogue with that participant as assistant and the others as named users; ``mask``
    lists ``start:end`` code points of what the assistant says, end mark included, joined by commas.

    Conversations are cut every ``width`` turn numbers into ``block`` and, where numbers repeat, every
    ``width`` rows into ``piece``, so no group is larger than ``width`` rows, whatever a conversation's
    length; a usual one is block 0, piece 0. Every participant of the conversation gets a row for every piece,
    also for those they are silent in: joined in order of block and piece, the texts of a participant are
    the whole dialogue. ``mask`` counts from the start of its row's text. Turns are ordered by number, role
    and text, nulls first. A null conversation id is an id like any other, a null text is empty, a turn
    without a role is shown as ``unknown`` and has no sample. Conversations with neutral speakers only give
    no row.
    """
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("t"), F.col(f"`{role}`").alias("r"), F.col(f"`{text}`").alias("x"))
    rows = rows.withColumn("block", F.floor(F.coalesce("t", F.lit(0)) / width))
    place = F.row_number().over(W.partitionBy("conv_id", "block").orderBy("t", "r", "x"))
    rows = rows.withColumn("piece", F.floor((place - 1) / width))
    pieces = rows.groupBy("conv_id", "block", "piece").agg(F.sort_array(F.collect_list(F.struct("t", "r", "x"))).alias("turns"))
    speakers = rows.filter(F.col("r").isNotNull() & ~F.col("r").isin(*NEUTRAL)).select(F.col("conv_id").alias("c"), F.col("r").alias("assistant")).distinct()
    # Speakers meet the keys of pieces first, so turns are never dealt by their conversation alone.
    keys = pieces.select("conv_id", F.col("block").alias("b"), F.col("piece").alias("p"))
    cast = keys.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).select("c", "b", "p", "assistant")
    views = pieces.join(cast, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("piece") == F.col("p")))

    def shown(s: Column) -> Column:
        own = F.coalesce(s["r"] == F.col("assistant"), F.lit(False))
        head = F.when(own, "assistant").when(s["r"].isin(*NEUTRAL), s["r"]).otherwise(F.concat(F.lit("user name="), _plain(F.coalesce(s["r"], F.lit("unknown")))))
        return F.struct(F.concat(F.lit(START), head, F.lit("\n")).alias("head"), F.concat(_plain(s["x"]), F.lit(END)).alias("body"), own.alias("own"))

    views = views.withColumn("shown", F.transform("turns", shown))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("chars"))

    def step(a: Column, s: Column) -> Column:
        first = a["at"] + F.length(s["head"])
        last = first + F.length(s["body"])
        spans = F.when(s["own"], F.concat(a["spans"], F.array(F.concat_ws(":", first, last)))).otherwise(a["spans"])
        return F.struct((last + 1).alias("at"), spans.alias("spans"), (a["chars"] + F.when(s["own"], last - first).otherwise(0)).alias("chars"))

    views = views.withColumn("mask", F.aggregate("shown", none, step))
    return views.select(
        "conv_id", "block", "piece", "assistant", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("shown", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("text"),
        F.array_join("mask.spans", ",").alias("mask"), F.col("mask.chars").cast("long").alias("mask_chars"),
    )
