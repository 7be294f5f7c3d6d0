"""Benchmark decontamination by the q-gram lemma.

Every window of ``m`` characters of a benchmark item is a pattern. A stretch of a document that is within
``e`` edits of a pattern shares at least ``m + 1 - q (e + 1)`` character q-grams with it, and these lie on at
most ``e + 1`` neighbouring diagonals. So the q-grams of whole items are indexed, shared ones are counted in
overlapping bands of diagonals by sliding windows, windows that reach the bound are kept, and a banded
alignment decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.llm.common import BASE, map_texts, mixed, other_columns, ragged
from panelflow.plans.staging import stage

#: Characters of a q-gram; of a pattern; allowed edits for each character of a pattern.
Q, LENGTH, RATE = 10, 80, 0.05
#: Items shorter than this after normalisation prove nothing and are left out.
SHORTEST = 30
#: Characters of benchmark text that one pass over the documents holds in memory.
BLOCK_CHARS = 4_000_000
_FILTER_BITS = 22
#: Stands between texts; no character has this code.
_GAP = 0xFFFFFFFF


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at every place, mixed so that any bits can be used."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    # Doubling: a hash of 2n characters is made of two of n.
    run, size, factor = codes.astype(np.uint64), 1, int(BASE)
    out, done = None, 0
    while True:
        if q & size:
            out = run.copy() if out is None else out[: len(out) - size] * np.uint64(factor) + run[done:]
            done += size
        if 2 * size > q:
            return mixed(out)
        run = run[:-size] * np.uint64(factor) + run[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)


@dataclass
class Patterns:
    """q-gram index of a block of items; a few arrays that every task gets."""

    item: list[int]
    codes: list[np.ndarray]
    sizes: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    pattern: np.ndarray
    place: np.ndarray
    seen: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, str]], q: int, length: int, rate: float, shortest: int) -> Patterns:
        items, codes = [], []
        for item, text in rows:
            whole = _codes(normal(text or ""))
            if len(whole) >= shortest:
                items.append(item)
                codes.append(whole)
        # Characters of a window: ``length``, or the whole item.
        sizes = np.minimum(np.array([len(c) for c in codes], np.int64), length)
        # The lemma says nothing where the bound is below one shared q-gram: fewer edits are allowed then.
        edits = np.minimum((sizes * rate).astype(np.int64), (sizes - q) // q)
        grams = [_grams(c, q) for c in codes]
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        pattern = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, np.int64)
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls(items, codes, sizes, edits, sizes + 1 - q * (edits + 1), keys[order], pattern, place, seen)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a document place and an index row with the same q-gram."""
        at = np.flatnonzero(self.seen[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, grams[at], "left"), np.searchsorted(self.keys, grams[at], "right")
        count = hi - lo
        ends = np.cumsum(count)
        rows = np.repeat(lo - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.repeat(at, count), rows

    def find(self, texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, pattern, edits)`` of the regions of normalised texts that meet the budget, some of them more than once.

        ``pattern`` is the number of the item. The fewest edits of any window are among those of a region.
        """
        none = np.zeros(0, np.int64)
        if not len(self.keys):
            return none, none, none
        # Texts lie behind each other with gaps that no window within the budget can cross.
        budget = int(self.edits.max())
        width, gap = 4 * budget + 2, 6 * budget + 6 + int(self.sizes.max())
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = _codes(("\0" * gap).join(["", *texts, ""])).copy()
        starts = gap + np.cumsum(np.r_[0, sizes[:-1] + gap])
        edge = np.zeros(len(codes) + 1, np.int8)
        edge[starts] += 1
        edge[starts + sizes] -= 1
        codes[np.cumsum(edge[:-1], dtype=np.int8) == 0] = _GAP
        at, rows = self.hits(_grams(codes, q))
        pattern, place = self.pattern[rows], self.place[rows]
        # Bands are twice as wide as they are apart, so e + 1 neighbouring diagonals lie in one of them.
        longest = max(map(len, self.codes))
        shift = longest + 2 * (budget + 1)
        band = (at - place + shift) // (self.edits[pattern] + 1)
        key = np.r_[(pattern << 40) + band, (pattern << 40) + band - 1]
        # A q-gram of the item counts once in a band, however often the document repeats it there.
        order = np.lexsort((np.r_[place, place], key))
        key, place = key[order], np.r_[place, place][order]
        new = np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])][: len(key)]
        key, place = key[new], place[new]
        key, first, shared = self._windows(key, place, longest + 2 * int(self.sizes.max()), q)
        pattern = key >> 40
        low = (key & ((1 << 40) - 1)) * (self.edits[pattern] + 1) - self.edits[pattern] - shift + first
        # A missing q-gram needs an edit, and an edit spoils q of them at most.
        fewest = -(-(self.sizes[pattern] - q + 1 - shared) // q)
        edits = np.full(len(key), budget + 1)
        # First the best window of each band, then those that could need fewer edits than that.
        order = np.lexsort((-shared, key))
        head = np.r_[True, key[order][1:] != key[order][:-1]][: len(key)]
        best = order[head]
        edits[best] = self._distances(pattern[best], first[best], codes, low[best], width)
        bound = np.minimum(edits[best], self.edits[pattern[best]] + 1)[np.cumsum(head) - 1]
        rest = order[~head & (fewest[order] < bound)]
        edits[rest] = self._distances(pattern[rest], first[rest], codes, low[rest], width)
        good = edits <= self.edits[pattern]
        return np.searchsorted(starts, low[good] + width, "right") - 1, pattern[good], edits[good]

    def _windows(self, key: np.ndarray, place: np.ndarray, stride: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(key, first, shared)``: windows with enough shared q-grams, from distinct sorted bands and places in the item.

        The first hit of such a window starts one as good, but for the item's end; so the windows are those hits
        and the starts up to the hit before.
        """
        pattern = key >> 40
        at = np.cumsum(np.r_[0, key[1:] != key[:-1]][: len(key)]) * stride + place
        reach = self.sizes[pattern] - q
        last = np.array([len(c) for c in self.codes])[pattern] - self.sizes[pattern]
        enough = np.searchsorted(at, at + reach, "right") - np.arange(len(at)) >= self.least[pattern]
        before = np.r_[-1, np.where(key[1:] == key[:-1], place[:-1], -1)][: len(key)]
        low, high = np.maximum(before + 1, place - reach), np.minimum(place, last)
        low = np.maximum(low, 0)
        hit = np.flatnonzero(enough & (low <= high))
        count = high[hit] - low[hit] + 1
        first = ragged(low[hit], count)
        hit = np.repeat(hit, count)
        shared = np.searchsorted(at, at[hit] - place[hit] + first + reach[hit], "right") - hit
        good = shared >= self.least[pattern[hit]]
        return key[hit][good], first[good], shared[good]

    def _distances(self, pattern: np.ndarray, first: np.ndarray, text: np.ndarray, low: np.ndarray, width: int, at_once: int = 20_000) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(pattern), at_once):
            windows = [self.codes[p][f : f + self.sizes[p]] for p, f in zip(pattern[i : i + at_once].tolist(), first[i : i + at_once].tolist())]
            out.append(banded_distances(windows, text, low[i : i + at_once], width))
        return np.concatenate(out)


def banded_distances(patterns: list[np.ndarray], text: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Fewest edits between each pattern and any stretch of ``text`` on its ``width`` diagonals from ``low``, all patterns at once.

    Row i of a table holds the cells (i, i + diagonal). The stretch may start and end anywhere in the band.
    """
    if not patterns:
        return np.zeros(0, np.int64)
    sizes = np.array([len(p) for p in patterns])
    padded = np.zeros((len(patterns), sizes.max()), np.uint32)
    for row, p in zip(padded, patterns):
        row[: len(p)] = p
    steps = np.arange(width)
    column = low[:, None] + steps
    cost = np.zeros(column.shape, np.int64)
    out = np.zeros(len(patterns), np.int64)
    for i in range(sizes.max()):
        # On going down a row, the cell above moves one to the right, and the diagonal one stays.
        next_ = cost + (text[column + i] != padded[:, i, None])
        next_[:, :-1] = np.minimum(next_[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(next_ - steps, axis=1) + steps
        done = sizes == i + 1
        out[done] = cost[done].min(axis=1)
    return out


FIELDS = [
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("fewest_edits", T.LongType()),
]


def mark(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    q: int = Q, length: int = LENGTH, rate: float = RATE, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """For every document: ``contaminated``, the number and ids of matched items, and the fewest edits of a match (null without).

    A document is contaminated if a stretch of it is within ``rate`` edits a character of a pattern, a
    stretch of ``length`` characters of an item (or the whole item, if shorter); both in lower case with
    single spaces. The benchmark is measured first and goes to the tasks in blocks of bounded size, one pass
    over the documents for each; results of several passes are merged by row. Null and empty texts are
    clean; null, empty and too short items are left out, and so are items without an id.
    """
    keep = [c for c in keep if c in other_columns(docs, {f.name for f in FIELDS})]
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).filter("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_chars))
    if blocks == 1:
        return _pass(docs, items, keep, text_col, q, length, rate, shortest)
    rows = docs
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        carried = keep + (["__items__", "__edits__"] if b else [])
        made = _pass(rows, part, [*carried, text_col] if text_col not in carried else carried, text_col, q, length, rate, shortest)
        before = F.col("__items__") if b else F.array().cast("array<long>")
        edits = F.least("fewest_edits", "__edits__") if b else F.col("fewest_edits")
        rows = stage(made.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text_col])], F.array_union(before, "items").alias("__items__"), edits.alias("__edits__")), "marked")
    found = F.array_sort("__items__")
    return rows.select(*[f"`{c}`" for c in keep], (F.size(found) > 0).alias("contaminated"), F.size(found).cast("long").alias("n_items"), found.alias("items"), F.col("__edits__").alias("fewest_edits"))


def _pass(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str, q: int, length: int, rate: float, shortest: int) -> DataFrame:
    rows = [(r["item"], r["text"]) for r in items.collect()]  # at most ``block_chars`` characters
    index = docs.sparkSession.sparkContext.broadcast(Patterns.build(rows, q, length, rate, shortest))

    def measure(texts: pa.Array) -> dict[str, pa.Array]:
        patterns = index.value
        items: list[set[int]] = [set() for _ in range(len(texts))]
        fewest: list[int | None] = [None] * len(texts)
        for text, pattern, edits in zip(*(x.tolist() for x in patterns.find([normal(t) for t in texts.to_pylist()], q))):
            items[text].add(patterns.item[pattern])
            fewest[text] = edits if fewest[text] is None else min(edits, fewest[text])
        return {
            "contaminated": pa.array([bool(x) for x in items], pa.bool_()), "n_items": pa.array([len(x) for x in items], pa.int64()),
            "items": pa.array([sorted(x) for x in items], pa.list_(pa.int64())), "fewest_edits": pa.array(fewest, pa.int64()),
        }

    return map_texts(docs, text_col, FIELDS, measure, keep)
