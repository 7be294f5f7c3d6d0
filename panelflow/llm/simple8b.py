"""Token ids in word-aligned blocks: Simple-8b.

Every 64-bit word has a 4-bit selector and up to 60 payload bits, which hold 1 to 60 ids of equal width. A
block has about ``BLOCK`` ids of whole documents (more if one document is longer) with the place of every document in
it, so that blocks are read on their own. Ids that need over 60 bits cannot occur; selector 15 is an escape:
its payload counts raw 64-bit words that follow. A file set is a folder of Parquet files whose rows are
blocks, in ascending document order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelflow.llm.common import as_texts, byte_slices
from panelflow.llm.tokens import encoder, with_end

#: ``(ids in a word, bits of each)`` for selectors 0 to 13; fixed values of the format.
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
BLOCK = 1 << 16
_U = np.uint64


def encode(values: np.ndarray) -> np.ndarray:
    """Words for non-negative 64-bit values.

    Greedy: a word takes as many values as fit, the fullest layout first. Whether a layout fits at a place
    is worked out for all places at once; then the places are chained. A last word that is not full is padded
    with zeros, so the reader has to know the number of values.
    """
    if values.dtype != np.uint32:
        values = values.astype(_U)
    n = len(values)
    if not n:
        return np.zeros(0, _U)
    large = values >= 1 << 60
    if large.any():
        return _with_escapes(values, large)
    # The fullest layout of every value by its width, then the widest of the next 1, 2, 4, .. values at every place;
    # other numbers are made of these.
    kind = np.zeros(n + 63, np.uint8)
    for _, width in LAYOUT[:-1]:
        kind[:n] += values >= 1 << width
    widest, size = {1: kind}, 1
    while size < 32:
        widest[2 * size] = np.maximum(widest[size][:-size], widest[size][size:])
        size *= 2
    # What fits a layout fits all those behind it.
    choice = np.zeros(n, np.uint8)
    for s, (count, _) in enumerate(LAYOUT[:-1]):
        half = 1 << (count.bit_length() - 1)
        choice += np.maximum(widest[half][:n], widest[half][count - half : count - half + n]) > s
    # Chained four words at a time (240 values at most); the three places between are filled in.
    place = np.arange(n)
    after = np.append(np.minimum(place + np.array([c for c, _ in LAYOUT])[choice], n), n)
    fourth = after[after]
    fourth = fourth[fourth]
    fours, at, steps = [], 0, (fourth[:n] - place).astype(np.uint8).tobytes()
    while at < n:
        fours.append(at)
        at += steps[at]
    chain = [np.array(fours)]
    for _ in range(3):
        chain.append(after[chain[-1]])
    starts = np.stack(chain, 1).ravel()
    starts = starts[starts < n]
    chosen = choice[starts]
    words = chosen.astype(_U) << _U(60)
    padded = np.r_[values.astype(_U), np.zeros(60, _U)]
    for s, (count, width) in enumerate(LAYOUT):
        own = np.flatnonzero(chosen == s)
        if len(own):
            made, first = words[own], starts[own]
            for j in range(count):
                made |= padded[first + j] << _U(j * width)
            words[own] = made
    return words


def _with_escapes(values: np.ndarray, large: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(large.astype(np.int8))) + 1
    out = []
    for run, escaped in zip(np.split(values, edges), np.split(large, edges)):
        if escaped[0]:
            out += [np.array([(ESCAPE << 60) + len(run)], _U), run]
        else:
            words = encode(run)
            # A padded word inside the stream would add values: its tail goes into single words.
            last = LAYOUT[int(words[-1] >> _U(60))][0]
            rest = len(run) - int(sum(LAYOUT[int(s)][0] for s in words[:-1] >> _U(60)))
            if rest < last:
                single = (_U(len(LAYOUT) - 1) << _U(60)) | run[len(run) - rest :]
                words = np.r_[words[:-1], single]
            out.append(words)
    return np.concatenate(out)


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of a run of words."""
    words = words.astype(_U)
    selector = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[at]:
            raw[at + 1 : at + 1 + int(words[at] & _U((1 << 60) - 1))] = True
    counts = np.array([c for c, _ in LAYOUT] + [0, 0])[selector]
    counts[raw] = 1
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, _U)
    first = ends - counts
    for s, (count, width) in enumerate(LAYOUT):
        own = np.flatnonzero((selector == s) & ~raw)
        held, place = words[own], first[own]
        for j in range(count if len(own) else 0):
            out[place + j] = (held >> _U(j * width)) & _U((1 << width) - 1)
    out[first[raw]] = words[raw]
    return out[:n]


_SCHEMA = "part int, block long, doc_ids array<long>, lengths array<long>, n_ids long, words binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write blocks to ``path`` in ascending order of ids.

    Rows are dealt to ranges of (id, hash of the text), so repeated or null ids (which come first) do not
    meet in one task; inside a range they are sorted. A null text has the end id only. An empty table
    gives an empty folder of files. A lost task writes its file anew: Spark commits it once.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, coder = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            for piece in byte_slices(batch, 1, 8_000_000):
                ids, offsets = with_end(*coder.encode(as_texts(piece.column(1))), end_id)
                names = piece.column(0).to_pylist()
                cuts = np.r_[np.flatnonzero(np.diff(offsets[:-1] // BLOCK)) + 1, len(names)]
                first, made = 0, []
                for last in cuts.tolist():
                    own = ids[offsets[first] : offsets[last]]
                    made.append((part, block, names[first:last], np.diff(offsets[first : last + 1]).tolist(), len(own), encode(own).astype("<u8").tobytes()))
                    first, block = last, block + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    dealt.mapInArrow(run, _SCHEMA).write.parquet(path)


def read(blocks: DataFrame) -> DataFrame:
    """``part, block, place, doc_id, n_tokens, ids`` of every document out of a folder of blocks."""
    return _documents(blocks, lambda ids, ends: [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])], "ids array<long>", pa.list_(pa.int64()))


def summary(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the decoded blocks.

    Starts are running sums inside a block, shifted by the blocks before in the same file and by the files
    before; the only unpartitioned window has one row per file.
    """

    def crc(ids: np.ndarray, ends: np.ndarray) -> list[int]:
        data, ends = ids.astype("<u4"), ends.tolist()
        return [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    docs = _documents(blocks, crc, "ids_crc32 long", pa.int64())
    by_block = blocks.select("part", "block", "n_ids")
    by_part = by_block.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = by_block.withColumn("inside", inside).join(by_part.select("part", before.alias("before")), "part").select("part", "block", (F.col("inside") + F.col("before")).alias("first"))
    return docs.join(firsts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def _documents(blocks: DataFrame, fn, field: str, kind: pa.DataType) -> DataFrame:
    """``fn`` on the decoded ids of every block; ``place`` is where a document starts in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, names, lengths, n, words in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                ends = np.r_[0, np.cumsum(lengths)].astype(np.int64)
                got = fn(decode(np.frombuffer(words, "<u8"), n), ends)
                count = len(names)
                arrays = [pa.array([part] * count, pa.int32()), pa.array([block] * count, pa.int64()), pa.array(ends[:-1]), pa.array(names, pa.int64()), pa.array(lengths, pa.int64()), pa.array(got, kind)]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", "place", "doc_id", "n_tokens", field.split()[0]])

    columns = ["part", "block", "doc_ids", "lengths", "n_ids", "words"]
    return blocks.select(*columns).mapInArrow(run, f"part int, block long, place long, doc_id long, n_tokens long, {field}")
