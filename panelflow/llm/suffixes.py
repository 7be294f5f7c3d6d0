"""Removal of long repeated byte strings by hash-compared suffix sorting.

A window of ``LENGTH`` bytes is represented by its anchor, the k-gram in it with the smallest hash, so equal
windows have equal anchors at equal places. Anchors that occur once are done with. Where an anchor's whole
surroundings (all windows it represents) occur twice, all these windows are repeated. The other
surroundings of an anchor are shipped to one task, which sorts the suffixes that start in them: prefix
hashes and binary search give the common extension of two suffixes, a mergesort on top gives the order, and
neighbours that agree in ``LENGTH`` bytes are verified byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.llm.common import PrefixHash, PrimeHash, as_texts, map_texts, mixed, ragged, stage_and_free, text_bytes

LENGTH = 200
#: Bytes of an anchor.
GRAM = 50
#: Distinct surroundings of one anchor that a task sorts; beyond that, their windows are counted by hash.
GROUP = 4096
#: Anchors that the combiner holds before it passes counts on; surroundings sorted at once.
_COMBINE, _CHUNK = 2_000_000, 6_000
_C1, _C2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))


def anchors(raw: np.ndarray, offsets: np.ndarray, hashes: PrefixHash, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first and last window start, place of the anchor, and its hash."""
    size = np.diff(offsets)
    starts = ragged(offsets[:-1], np.maximum(size - length + 1, 0))
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64)
    at = np.arange(len(raw) - gram + 1)
    key = mixed(hashes.of(at, at + gram))
    # The upper half of the hash decides, then the leftmost place.
    least = (key & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: width - span], least[span - width :])
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    place = place[first]
    return np.searchsorted(offsets, starts[first], "right") - 1, starts[first], starts[last], place, key[place]


_SCAN = [
    T.StructField("n_bytes", T.LongType()), T.StructField("whole_sha256", T.StringType()),
    *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("at", "anchor", "around")),
]


def _scan(texts: pa.Array, length: int, gram: int) -> dict[str, pa.Array]:
    raw, offsets = text_bytes(texts)
    hashes = PrefixHash(raw)
    doc, first, last, place, key = anchors(raw, offsets, hashes, length, gram)
    around = mixed(PrimeHash(raw).of(first, last + length) + (last - first).astype(np.uint64) * _C1 + (place - first).astype(np.uint64) * _C2)
    at = ((place - offsets[doc]) << 16) | ((place - first) << 8) | (place - last)
    ends = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
    lists = {n: pa.ListArray.from_arrays(ends, pa.array(v)) for n, v in (("at", at), ("anchor", key.view(np.int64)), ("around", around.view(np.int64)))}
    data = memoryview(raw)
    sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return lists | {"n_bytes": pa.array(np.diff(offsets)), "whole_sha256": pa.array(sha)}


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (anchor, around) and their smallest row, combined before the shuffle."""
    held: list[np.ndarray] = []
    n = 0

    def counts() -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        times = np.diff(np.r_[new, len(rows)])
        arrays = [rows[new, 0], rows[new, 1], times, rows[new, 2]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in arrays], names=["anchor", "around", "times", "row"])

    for batch in batches:
        anchor, around = (batch.column(i).flatten().to_numpy() for i in (1, 2))
        row = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
        held.append(np.stack([anchor, around, row], 1))
        n += len(row)
        if n >= _COMBINE:
            yield counts()
            held, n = [], 0
    if n:
        yield counts()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Removed is each byte of a string of ``length`` bytes that also starts anywhere else, in the same text or
    in another; a null text is empty. Copies and repeated rows count as other texts, so of two equal texts
    of at least ``length`` bytes nothing is left. An empty table gives an empty one. ``length - gram`` is at
    most 255.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("text_key", text_key("text"))
    scanned = map_texts(rows, "text", _SCAN, lambda texts: _scan(texts, length, gram), ["doc_id", "text_key"])
    scanned = stage_and_free(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")

    counts = scanned.select("row", "anchor", "around").mapInArrow(_combine, "anchor long, around long, times long, row long")
    counts = counts.repartition("anchor").groupBy("anchor", "around").agg(F.sum("times").alias("times"), F.min("row").alias("first_row"))
    counts = counts.selectExpr("*", "count(*) over (partition by anchor) as kinds").filter("kinds > 1 or times > 1")

    met = scanned.select("row", F.explode(F.arrays_zip("at", "anchor", "around")).alias("x")).select("row", "x.*").join(counts, ["anchor", "around"])
    to_sort = (F.col("kinds") > 1) & ((F.col("times") == 1) | (F.col("row") == F.col("first_row")))
    marks = F.struct("at", "anchor", "around", (F.col("times") > 1).alias("sure"), to_sort.alias("sort"), "kinds")
    firsts = scanned.groupBy("text_key").agg(F.min("row").alias("row"))
    met = met.select("row", marks.alias("mark")).groupBy("row").agg(F.collect_list("mark").alias("marks")).join(firsts, "row").drop("row")
    # Written before the texts move, so that the anchors' shuffle files are gone by then.
    met = stage_and_free(met, "marks")
    pending = stage_and_free(rows.select("text_key", "text").dropDuplicates(["text_key"]).join(met, "text_key"), "pending")

    around = pending.filter(F.exists("marks", lambda m: m["sort"])).mapInArrow(lambda b: _surroundings(b, length, group, False), _AROUND)
    runs = around.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _sorted_runs(b, length), "text_key binary, first long, last long")
    if not pending.filter(F.exists("marks", lambda m: m["kinds"] > group)).isEmpty():
        hot = pending.filter(F.exists("marks", lambda m: m["sort"] & (m["kinds"] > group)))
        hot = stage_and_free(hot.mapInArrow(lambda b: _surroundings(b, length, group, True), "text_key binary, first long, w1 long, w2 long"), "windows")
        twice = hot.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        runs = runs.unionByName(hot.join(twice, ["w1", "w2"]).select("text_key", "first", F.col("first").alias("last")))
    runs = runs.groupBy("text_key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    done = pending.select("text_key", "text", F.transform(F.filter("marks", lambda m: m["sure"]), lambda m: m["at"]).alias("sure")).join(runs, "text_key", "left")
    done = done.mapInArrow(lambda b: _remove(b, length), "text_key binary, n_removed long, n_spans long, kept_sha256 string")
    known = scanned.select("doc_id", "text_key", "n_bytes", "whole_sha256").join(done, "text_key", "left")
    zero = F.lit(0).cast("long")
    return known.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


_AROUND = "anchor long, text_key binary, first long, before int, windows int, bytes binary"


def _surroundings(batches: Iterator[pa.RecordBatch], length: int, group: int, hot: bool) -> Iterator[pa.RecordBatch]:
    """The bytes around anchors that are to be sorted or, of very frequent anchors, the hashes of their windows."""
    names = ["text_key", "first", "w1", "w2"] if hot else ["anchor", "text_key", "first", "before", "windows", "bytes"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()] if hot else [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        for key, text, marks in zip(*[batch.column(i) for i in range(3)]):
            key, raw, seen, out = key.as_py(), text.as_py().encode(), set(), []
            data = np.frombuffer(raw, np.uint8)
            hashes = PrimeHash(data) if hot else None
            others = PrefixHash(data) if hot else None
            for m in marks.as_py():
                if not m["sort"] or (m["kinds"] > group) != hot or (m["anchor"], m["around"]) in seen:
                    continue
                seen.add((m["anchor"], m["around"]))
                place, before, after = m["at"] >> 16, m["at"] >> 8 & 255, m["at"] & 255
                first, last = place - before, place - after
                if hot:
                    s = np.arange(first, last + 1)
                    whole, other = hashes.of(s, s + length), others.of(s, s + length)
                    out += zip([key] * len(s), s.tolist(), mixed(whole).view(np.int64).tolist(), mixed(other).view(np.int64).tolist())
                else:
                    out.append((m["anchor"], key, first, before, last - first + 1, raw[first : last + length]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _sorted_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows. Rows come by anchor; those of one anchor are never taken apart."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows < _CHUNK:
            continue
        anchor = rest.column(0).to_numpy()
        cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        if len(cuts):
            yield from _sort_table(rest.slice(0, int(cuts[-1])), length)
            rest = rest.slice(int(cuts[-1])).combine_chunks()
    if rest is not None and rest.num_rows:
        yield from _sort_table(rest, length)


def _sort_table(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    anchor = table.column(0).to_numpy()
    ends = np.r_[np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)]
    first = 0
    while first < len(anchor):
        last = int(ends[max(np.searchsorted(ends, first + _CHUNK, "right") - 1, np.searchsorted(ends, first, "right"))])
        part = table.slice(first, last - first)
        keys, start, before, windows = (part.column(i).to_pylist() if i == 1 else part.column(i).to_numpy() for i in range(1, 5))
        raw, offsets = text_bytes(part.column(5).combine_chunks().cast(pa.large_binary()))
        row, low, high = repeated_windows(raw, offsets[:-1], anchor[first:last], before, windows, length)
        arrays = [pa.array([keys[i] for i in row.tolist()], pa.binary()), pa.array(start[row] + low), pa.array(start[row] + high)]
        yield pa.RecordBatch.from_arrays(arrays, names=["text_key", "first", "last"])
        first = last


def repeated_windows(raw: np.ndarray, starts: np.ndarray, group: np.ndarray, before: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs ``(row, first, last)`` of windows that occur in the surroundings of two rows of a group.

    Suffixes can agree only at equal distance from the anchor, so each group is sorted once per distance,
    all groups and distances at the same time.
    """
    row = np.repeat(np.arange(len(starts)), windows)
    step = ragged(np.zeros(len(windows), np.int64), windows.astype(np.int64))
    order = np.lexsort((row, before[row] - step, group[row]))
    row, step = row[order], step[order]
    distance = before[row] - step
    new = np.r_[True, (distance[1:] != distance[:-1]) | (group[row[1:]] != group[row[:-1]])][: len(row)]
    segment = np.cumsum(new) - 1
    size = np.bincount(segment)[segment] if len(segment) else segment
    row, step, segment = (x[size > 1] for x in (row, step, segment))
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, none, none
    suffixes = SuffixOrder(raw, length)
    place = starts[row] + step
    ranked = suffixes.sort(place, segment)
    same = np.flatnonzero(segment[1:] == segment[:-1])
    same = same[suffixes.extension(place[ranked[same]], place[ranked[same + 1]]) == length]
    same = same[suffixes.verified(place[ranked[same]], place[ranked[same + 1]])]
    hit = np.zeros(len(row), bool)
    hit[ranked[same]] = hit[ranked[same + 1]] = True
    row, step = row[hit], step[hit]
    order = np.lexsort((step, row))
    row, step = row[order], step[order]
    edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)][: len(row)])
    return row[edge], step[edge], step[np.r_[edge[1:], len(row)][: len(edge)] - 1]


class SuffixOrder:
    """Order of suffixes by their first ``length`` bytes, from prefix hashes."""

    def __init__(self, raw: np.ndarray, length: int):
        self.raw, self.length, self.hashes = raw, length, PrefixHash(raw)
        self.steps = [1 << i for i in range(length.bit_length() - 1, -1, -1)]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix, at most ``length``: a binary search over hashes of prefixes."""
        sums, down = self.hashes.sums, self.hashes.down
        base_a, base_b, down_a, down_b = sums[a], sums[b], down[a], down[b]
        common = np.zeros(len(a), np.int64)
        for step in self.steps:
            upto = common + step
            fits = upto <= self.length
            upto = np.where(fits, upto, common)
            equal = (sums[a + upto] - base_a) * down_a == (sums[b + upto] - base_b) * down_b
            common = np.where(equal & fits, upto, common)
        return common

    def below(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b (or is equal to it where that counts)."""
        common = self.extension(a, b)
        whole = common == self.length
        shift = np.where(whole, 0, common)
        return np.where(whole, or_equal, self.raw[a + shift] < self.raw[b + shift])

    def sort(self, place: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Indices of ``place`` in suffix order inside every segment, by a bottom-up mergesort of all segments at once.

        Each element of a run finds its rank in the neighbouring run by binary search.
        """
        n = len(place)
        start = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        size = np.diff(np.r_[start, n])
        first, count = np.repeat(start, size), np.repeat(size, size)
        local = np.arange(n) - first
        order, run = np.arange(n), 1
        while run < size.max():
            mine = local // run
            other = mine ^ 1
            low = np.minimum(other * run, count)
            high = np.minimum(low + run, count)
            base = low.copy()
            right = mine % 2 == 1
            todo = np.flatnonzero(low < high)
            while len(todo):
                middle = (low[todo] + high[todo]) // 2
                less = self.below(place[order[first[todo] + middle]], place[order[todo]], right[todo])
                low[todo] = np.where(less, middle + 1, low[todo])
                high[todo] = np.where(less, high[todo], middle)
                todo = todo[low[todo] < high[todo]]
            target = first + (mine - mine % 2) * run + (local - mine * run) + (low - base)
            merged = np.empty(n, np.int64)
            merged[target] = order
            order, run = merged, 2 * run
        return order

    def verified(self, a: np.ndarray, b: np.ndarray, rows: int = 20_000) -> np.ndarray:
        """Whether the bytes really agree."""
        out, step = np.zeros(len(a), bool), np.arange(self.length)
        for i in range(0, len(a), rows):
            out[i : i + rows] = (self.raw[a[i : i + rows, None] + step] == self.raw[b[i : i + rows, None] + step]).all(axis=1)
        return out


def _remove(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes and spans covered by repeated windows, and the hash of the rest."""
    for batch in batches:
        removed, spans, sha = [], [], []
        for text, sure, runs in zip(as_texts(batch.column(1)), batch.column(2), batch.column(3)):
            raw = text.as_py().encode()
            at = np.array(sure.as_py() or [], np.int64)
            place = at >> 16
            first, last = [place - (at >> 8 & 255)], [place - (at & 255)]
            if runs.is_valid:
                first.append(np.array([r["first"] for r in runs.as_py()]))
                last.append(np.array([r["last"] for r in runs.as_py()]))
            steps = np.zeros(len(raw) + 1, np.int64)
            np.add.at(steps, np.concatenate(first), 1)
            np.add.at(steps, np.concatenate(last) + length, -1)
            gone = np.cumsum(steps[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
            sha.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["text_key", "n_removed", "n_spans", "kept_sha256"])
