"""Shards by fixed virtual slots.

Records are hashed into a fixed number of slots. Only slots, never records, are placed on shards: bytes
are summed per slot, and a small slot-to-shard map with a version says where each slot is. Rebalancing
edits the map: overfull shards release their smallest slots, and these go to the emptiest shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

N_SLOTS = 4096


def slot_of(id_col: str, crc_col: str, n_slots: int = N_SLOTS) -> Column:
    """Slot of a record. Both the id and the text take part, so that rows which share an id (or have none) spread."""
    return F.pmod(F.xxhash64(F.col(id_col), F.col(crc_col)), F.lit(n_slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot``: what placement needs; texts are not shuffled.

    Size is the bytes of the text (none for null) plus 1. The checksum of a null text is that of the empty one.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", slot_of("doc_id", "text_crc32", n_slots))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot: at most as many rows as there are slots."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def first_map(sizes: DataFrame, n_shards: int) -> DataFrame:
    """Version 1: slots dealt out in turn."""
    shard = F.pmod(F.col("virtual_slot"), F.lit(n_shards)).cast("int")
    return sizes.select(F.lit(1).alias("version"), "virtual_slot", shard.alias("shard"), "bytes", "n_rows")


def rebalance(slot_map: DataFrame, n_shards: int, fill: float = 0.98) -> DataFrame:
    """Next version of the map, with a column ``moved``.

    Each shard keeps its largest slots up to ``fill`` of the mean, at least one; the others are released and
    placed, largest first, on the shard that is emptiest at that time. Shards beyond ``n_shards`` (after a
    shrink) release all. The map has one row per slot, so the fold over released slots is of fixed size.
    """
    mine = W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    target = F.sum("bytes").over(W.partitionBy()) * (fill / n_shards)
    ranked = slot_map.withColumns({"before": F.sum("bytes").over(mine) - F.col("bytes"), "target": target})
    stays = (F.col("shard") < n_shards) & ((F.col("before") == 0) | (F.col("before") + F.col("bytes") <= F.col("target")))
    ranked = ranked.withColumn("stays", stays)
    loads = ranked.groupBy().agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)) for s in range(n_shards)]).alias("loads"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("minus"), "virtual_slot")))).alias("released"),
    )

    def place(state: Column, item: Column) -> Column:
        shard = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        grown = F.transform(state["loads"], lambda x, i: F.when(i == shard, x - item["minus"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.concat(state["shards"], F.array(shard)).alias("shards"))

    empty = F.struct(F.col("loads"), F.array().cast("array<int>").alias("shards"))
    placed = loads.select("released", F.aggregate("released", empty, place)["shards"].alias("shards"))
    placed = placed.select(F.explode(F.arrays_zip("released", "shards")).alias("x")).select(F.col("x.released.virtual_slot").alias("virtual_slot"), F.col("x.shards").alias("to_shard"))
    shard = F.coalesce("to_shard", "shard")
    joined = ranked.join(F.broadcast(placed), "virtual_slot", "left")
    return joined.select((F.col("version") + 1).alias("version"), "virtual_slot", shard.alias("shard"), "bytes", "n_rows", (shard != F.col("shard")).alias("moved"))


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of every record and its place there, gapless from 0 (by slot, then id, checksum and size).

    Places are counted inside slots and shifted by the rows of the slots before; no shard meets in one
    task. The map has a row per slot, which is the bound for broadcasting it.
    """
    ahead = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(ahead), F.lit(0)).alias("first"))
    inside = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("first") + F.col("inside")).drop("first", "inside")
