"""Near-duplicates by SimHash and deletion-variant signatures.

Fingerprints of 64 bits that differ in at most two bits are linked. Cut into two segments, one of the segments
then differs in at most one bit. So every fingerprint is indexed under each segment with each of its bits
wiped out, an equality join on these variants brings candidates together, and the whole fingerprints decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.llm.common import IS_SPACE, map_texts, stage_and_free, text_bytes, word_bounds
from panelflow.llm.components import components
from panelflow.plans.staging import stage

SHINGLE, SEED = 3, 42
BITS, SEGMENT, DISTANCE = 64, 32, 2
#: Fingerprints that are compared with each other in one place. Never less than 2048, to which bits alone bound a bucket.
BUCKET = 2048
#: Bytes of a text that are hashed at once.
PIECE = 4_000_000

#: Bytes with A to Z in lower case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One bit of a byte in each byte of a word: sums of up to 255 of these count all eight bits at once.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def _shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """XXH64 of all shingles of lower-cased texts, in steps: hashes and the text of each. Shorter texts have none."""
    from xxhash import xxh64_intdigest as xxh64

    starts, ends = word_bounds(raw, offsets)
    # Single spaces between the words of a text: the byte behind a word stays.
    keep = ~IS_SPACE[raw]
    keep[ends[ends < len(raw)]] = True
    lengths = ends - starts
    data = raw[keep].copy()
    data[IS_SPACE[data]] = 32
    moved = np.cumsum(keep)[starts] - 1
    data = data.tobytes()
    text = np.searchsorted(offsets, starts, "right") - 1
    last = len(starts) - size + 1
    first = np.flatnonzero(text[:last] == text[size - 1 :]) if last > 0 else np.zeros(0, np.int64)
    for i in range(0, len(first), 100_000):
        own = first[i : i + 100_000]
        stop = own + size - 1
        at = zip(moved[own].tolist(), (moved[stop] + lengths[stop]).tolist())
        yield np.fromiter((xxh64(data[a:b], SEED) for a, b in at), np.uint64, len(own)), text[own]


def _bit_counts(hashes: np.ndarray, text: np.ndarray, ones: np.ndarray, total: np.ndarray) -> None:
    """Add how often each bit is set, by text (in ascending order), to ``ones`` and the number of hashes to ``total``."""
    if not len(hashes):
        return
    new = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.r_[new, len(text)])
    # Runs of a text in pieces of at most 255.
    pieces = -(-count // 255)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(new, pieces) + 255 * (np.arange(pieces.sum()) - first)
    names, own = text[new], np.cumsum(pieces) - pieces
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for j in range(8):
        sums = np.add.reduceat(_COUNTERS[octets[:, j]], start).view(np.uint8).reshape(-1, 8)
        ones[names, 8 * j : 8 * j + 8] += np.add.reduceat(sums.astype(np.int64), own, axis=0)
    total[names] += count


def _long_text(raw: np.ndarray, size: int, ones: np.ndarray, total: np.ndarray) -> None:
    """The same for one text in pieces that end at white space, each with the last words of the one before."""
    carried, at = b"", 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw):
            spaces = np.flatnonzero(IS_SPACE[raw[end : end + PIECE]])
            end = end + int(spaces[0]) if len(spaces) else min(end + PIECE, len(raw))
            if len(spaces):
                break
        piece = carried + raw[at:end].tobytes()
        one, own = np.zeros((1, BITS), np.int64), np.zeros(1, np.int64)
        for hashes, text in _shingle_hashes(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]), size):
            _bit_counts(hashes, text, one, own)
        ones += one[0]
        total += own
        carried = b"".join(w + b" " for w in piece.rsplit(None, size)[-size + 1 :]) if size > 1 else b""
        at = end


def fingerprint_values(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints of whole texts: a bit is set if it is in over half of the hashes of shingles."""
    from xxhash import xxh64_intdigest as xxh64

    raw, offsets = text_bytes(texts)
    raw = _LOWER[raw]
    n = len(offsets) - 1
    ones, total = np.zeros((n, BITS), np.int64), np.zeros(n, np.int64)
    if n == 1 and len(raw) > PIECE:
        _long_text(raw, size, ones[0], total)
    else:
        for hashes, text in _shingle_hashes(raw, offsets, size):
            _bit_counts(hashes, text, ones, total)
    for i in np.flatnonzero(total == 0).tolist():
        if words := raw[offsets[i] : offsets[i + 1]].tobytes().split():
            value = np.array([xxh64(b" ".join(words), SEED)], np.uint64)
            _bit_counts(value, np.array([i]), ones, total)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, value`` for every row; ``value`` holds the 64 bits of the fingerprint (zero for texts without words)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    field = T.StructField("value", T.LongType())
    return map_texts(rows, "text", [field], lambda texts: {"value": pa.array(fingerprint_values(texts, size).view(np.int64))}, ["doc_id"])


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Fingerprints at ``DISTANCE`` or fewer differing bits are linked, and ``component_id`` is the smallest id that
    links reach (null if all ids there are null). Equal texts, repeated rows, and all texts without words (null,
    empty, blank) share a fingerprint, so they are counted once in the search. Long texts are hashed in pieces.
    Other columns are left out. An empty table gives an empty one.
    """
    marked = stage(fingerprints(docs, id_col, text_col, size), "fingerprints")
    values = stage_and_free(marked.groupBy("value").agg(F.min("doc_id").alias("first_id")), "values")
    roots = components(links(values.select("value"), bucket)).withColumnRenamed("node", "value")
    rooted = values.join(roots, "value", "left").withColumn("root", F.coalesce("root", "value"))
    classes = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = stage_and_free(rooted.join(classes, "root").select("value", "component_id"), "known")
    return marked.join(known, "value").select("doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")


def links(values: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``u, v``: edges between linked values that connect what links connect, from a table of distinct ``value``.

    Each value is indexed under 64 variants. A bucket whose segment is frequent is refined by more equal bits:
    of three parts of the other segment one agrees, as two bits differ at most. After three refinements the
    bits left allow 2048 values at most, so no bucket is unbounded and no pair is lost.
    """
    at = values.select("value", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("slot"))
    level = at.withColumn("key", _segment("value", F.col("slot")).bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, slot % {SEGMENT})"))))
    # Sizes of buckets are bounded by the counts of whole segments: two rows a value instead of 64.
    whole = values.select(F.explode(F.array(F.lit(0), F.lit(SEGMENT))).alias("first"), "value")
    whole = whole.groupBy("first", _segment("value", F.col("first")).alias("own")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket // 2)
    hot = whole.select(F.explode(F.sequence(F.col("first"), F.col("first") + SEGMENT - 1)).alias("slot"), "own")
    hot = hot.select("slot", F.col("own").bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, slot % {SEGMENT})"))).alias("key")).distinct()
    hot, found, path = stage(hot, "hot"), [], []
    level = level.select("slot", "key", "value")
    for depth in range(4):
        if hot.isEmpty():
            found.append(stage_and_free(_compare(level), "links"))
            break
        marks = hot.withColumn("hot", F.lit(True))
        split = level.join(marks, ["slot", "key"], "left")
        found.append(stage_and_free(_compare(split.filter("hot is null").drop("hot")), "links"))
        masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in _masks(depth, p)]) for p in range(3**depth)])
        refined = split.filter("hot").withColumn("path", F.col("path") if path else F.lit(0)).withColumn("part", F.explode(F.array(*map(F.lit, range(3)))))
        other = _segment("value", F.col("slot"), other=True)
        own = F.element_at(F.element_at(masks, F.col("path") + 1), F.col("part") + 1)
        refined = refined.select("slot", F.xxhash64("key", "part", other.bitwiseAND(own)).alias("key"), "value", (F.col("path") * 3 + F.col("part")).alias("path"))
        level, path = stage_and_free(refined, "refined"), ["path"]
        if depth == 2:
            found.append(stage_and_free(_compare(level), "links"))
            break
        hot = stage_and_free(level.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("slot", "key"), "hot")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def _segment(value: str, slot: Column, other: bool = False) -> Column:
    """The segment in which bit ``slot`` lies (or the other one), as a number."""
    low = F.col(value).bitwiseAND(F.lit((1 << SEGMENT) - 1))
    high = F.shiftrightunsigned(F.col(value), SEGMENT)
    return F.when((slot < SEGMENT) != F.lit(other), low).otherwise(high)


def _masks(depth: int, path: int) -> list[int]:
    """Three parts of the bits that the choices of ``path`` have left over."""
    free, choices = list(range(SEGMENT)), []
    for _ in range(depth):
        choices.insert(0, path % 3)
        path //= 3
    for c in choices:
        free = [b for i, b in enumerate(free) if i % 3 != c]
    return [sum(1 << b for i, b in enumerate(free) if i % 3 == c) for c in range(3)]


def _compare(level: DataFrame) -> DataFrame:
    near = level.repartition("slot", "key").sortWithinPartitions("slot", "key", "value").select("slot", "key", "value")
    return near.mapInArrow(_verify, "u long, v long")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges inside every bucket; buckets come behind each other. The open one is carried to the next batch."""
    held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in batches:
        held = [np.r_[a, batch.column(i).to_numpy()] for i, a in enumerate(held)]
        slot, key, value = held
        new = np.flatnonzero((key[1:] != key[:-1]) | (slot[1:] != slot[:-1]))
        if len(new):
            last = int(new[-1]) + 1
            yield _edges(slot[:last], key[:last], value[:last])
            held = [a[last:] for a in held]
    yield _edges(*held)


def _edges(slot: np.ndarray, key: np.ndarray, value: np.ndarray, small: int = 8) -> pa.RecordBatch:
    """Equal segments are compared under their first variant only; under the others, the two sides of the wiped bit."""
    n = len(value)
    bounds = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (slot[1:] != slot[:-1]), True][: n + 1]) if n else np.zeros(1, np.int64)
    size = np.diff(bounds)
    value = value.view(np.uint64)
    found = [np.zeros((0, 2), np.uint64)]
    left = np.repeat(bounds[1:], size) - np.arange(n) if n else np.zeros(0, np.int64)
    few = np.repeat((size > 1) & (size <= small), size)
    for d in range(1, small):
        i = np.flatnonzero(few & (left > d))
        found.append(_linked(slot[i], value[i], value[i + d]))
    for b in np.flatnonzero(size > small).tolist():
        own = value[bounds[b] : bounds[b + 1]]
        found.append(_forest(int(slot[bounds[b]]), own))
    u, v = np.concatenate(found).view(np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(u.copy()), pa.array(v.copy())], names=["u", "v"])


def _linked(slot: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a ^ b
    wiped = (differ >> slot.astype(np.uint64)) & np.uint64(1) == 1
    good = (np.bitwise_count(differ) <= DISTANCE) & (wiped | (slot % SEGMENT == 0))
    return np.stack([a[good], b[good]], 1)


def _forest(slot: int, value: np.ndarray) -> np.ndarray:
    """Edges from every linked value of a bucket to the smallest one it is connected to there."""
    wiped = np.uint64(1) << np.uint64(slot)
    label = np.arange(len(value))
    while True:
        lower = label.copy()
        for i in range(0, len(value), 512):
            differ = value[i : i + 512, None] ^ value[None, :]
            near = np.bitwise_count(differ) <= DISTANCE
            if slot % SEGMENT:
                near &= differ & wiped != 0
            lower[i : i + 512] = np.minimum(lower[i : i + 512], np.where(near, label[None, :], len(value)).min(axis=1))
        if (lower == label).all():
            break
        label = lower
    own = np.flatnonzero(label != np.arange(len(value)))
    return np.stack([value[own], value[label[own]]], 1)
