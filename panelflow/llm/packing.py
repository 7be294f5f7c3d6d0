"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

A document longer than a sequence is cut into full pieces and a rest. Pieces are packed in groups: each
goes where the sum of the squared numbers of open sequences per residual gap becomes smallest. What a group
leaves open is packed again with what other groups left, as far as it can still be joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import as_texts, byte_slices
from panelflow.llm.tokens import encoder, with_end
from panelflow.plans.staging import stage

#: Pieces that one task packs; more groups are made for more pieces.
GROUP = 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: whole documents, or cuts of ``size`` tokens of longer ones."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in byte_slices(batch, 1, 8_000_000):
                ids, offsets = with_end(*coder.encode(as_texts(part.column(1))), end_id)
                lengths = np.diff(offsets)
                count = -(-lengths // size)
                doc = np.repeat(np.arange(len(lengths)), count)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = number * size
                length = np.minimum(size, lengths[doc] - start)
                first, data = offsets[:-1][doc] + start, ids.astype("<u4")
                crc = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(first.tolist(), length.tolist())]
                arrays = [part.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, _PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> np.ndarray:
    """Sequence of each piece, numbered from 0.

    Longest first. Putting a piece of length a into a gap g changes the sum of squares by 1 - 2 N(g) for the
    gap that goes and by 1 + 2 N(g - a) for the one that comes; full sequences are not counted. A new
    sequence counts as the gap ``size``, and is opened only if no open one can take the piece. Ties go to
    the smallest gap.
    """
    order = np.argsort(-lengths, kind="stable")
    open_ = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    gain, out, made = -2 * open_, np.zeros(len(lengths), np.int64), 0
    for i, a in zip(order.tolist(), lengths[order].tolist()):
        change = gain[a:size].copy()
        change[1:] -= gain[1 : size - a]
        change[1:] += 2
        change[open_[a:size] == 0] = np.iinfo(np.int64).max
        g = a + int(change.argmin()) if len(change) and open_[a:size].any() else size
        if g == size:
            bin_, made = made, made + 1
        else:
            bin_ = stacks[g].pop()
            open_[g] -= 1
            gain[g] += 2
        rest = g - a
        if rest:
            stacks[rest].append(bin_)
            open_[rest] += 1
            gain[rest] -= 2
        out[i] = bin_
    return out


def pack(made: DataFrame, size: int = 2048, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged pieces.

    Full pieces are sequences of their own. The others are spread over groups by a hash of the row, and each
    group is packed by one task that holds lengths and ids only. A group leaves at most one sequence that is
    half full or less, and fuller ones cannot be joined with each other. So the next round sees these few
    below 99 % as single items again, with as many of the emptiest others that could take one, until one
    group has taken all of them: then no two sequences below 99 % fit into one. Repeated rows are packed as
    often as they occur; an empty table gives an empty one.
    """
    rows = stage(made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = rows.filter(F.col("length") >= size).withColumns({"sequence_id": F.col("row") * 2 + 1, "offset": F.lit(0).cast("long")})
    items = rows.filter(F.col("length") < size).select(F.col("row").alias("item"), "length")
    # Where each piece is now: in the item ``inside``, ``offset`` tokens from its start.
    where, n = items.select(F.col("item").alias("row"), F.col("item").alias("inside"), F.lit(0).cast("long").alias("offset")), items.count()
    while n:
        groups = max(1, -(-n // group))
        packed = stage(_round(items, size, groups), "packed")
        moved = packed.select(F.col("item").alias("inside"), "bin", "at")
        where = where.join(moved, "inside", "left").select("row", F.coalesce("bin", "inside").alias("inside"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))
        if groups == 1:
            break
        items = packed.groupBy("bin").agg(F.sum("length").alias("length")).filter(F.col("length") < size * 0.99).withColumnRenamed("bin", "item")
        items = stage(items, "open")
        half = items.filter(F.col("length") * 2 <= size)
        few, least = half.agg(F.count(F.lit(1)), F.min("length")).first()
        if not few:
            break
        # Each of the few takes up one other at most, so more than the emptiest ``few`` are never needed.
        others = items.filter((F.col("length") * 2 > size) & (F.col("length") <= size - least)).orderBy("length", "item").limit(few)
        items = stage(half.unionByName(others), "left")
        left = items.count()
        # Groups of a few pieces may not get fewer; others do.
        group, n = (group if left < n else 2 * group), left
    placed = rows.join(where, "row").withColumn("sequence_id", F.col("inside") * 2)
    columns = [*made.columns, "sequence_id", "offset"]
    return full.select(columns).unionByName(placed.select(columns))


def _round(items: DataFrame, size: int, groups: int) -> DataFrame:
    """``item, length, bin, at``; a bin is named after its first item."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        pdf["bin"] = sum_of_squares(pdf["length"].to_numpy(), size)
        pdf["at"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
        pdf["bin"] = pdf.groupby("bin")["item"].transform("first")
        return pdf[["item", "length", "bin", "at"]]

    key = F.pmod(F.xxhash64("item"), F.lit(groups))
    return items.withColumn("g", key).groupBy("g").applyInPandas(one, "item long, length long, bin long, at long")
