"""Spelling variants by reduced-alphabet generation.

Letters are hashed to eight symbols. Words that differ by one edit have reduced forms that are equal or differ
by one edit. So the full one-edit neighbourhood of every distinct reduced word is generated and joined with the
reduced vocabulary, and the original strings of the words behind both decide. A word takes its most frequent
near word as form if that is at least twice as frequent, and forms are followed to the end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import BASE, as_texts, byte_slices, mixed, stage_and_free
from panelflow.plans.staging import stage

#: Letters of words, in lower case only for A to Z.
LETTERS = [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
SYMBOLS = 8
SHORTEST, LEAST = 5, 3
#: One occurrence in so many loses a letter; a form is so many times as frequent.
LOSES, RATIO = 97, 2
#: Words with the same reduced form that one side of a tile holds.
TILE = 256
#: Letters whose neighbourhoods are generated at once.
STEP = 1 << 16

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")


def _count(texts: pa.Array, ids: list[int | None]) -> Counter[str]:
    total: Counter[str] = Counter()
    for text, doc_id in zip(texts, ids):
        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for run, n in Counter(_RUN.findall(text.as_py())).items():
            # Bytes are lower-cased from A to Z only.
            low = run.encode().lower()
            h, run = zlib.crc32(low, start), low.decode()
            if h % LOSES == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < SHORTEST:
                    continue
            total[run] += n
    return total


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``word, n``: words of at least five letters that occur at least ``least`` times in all texts, with their number.

    Counts are combined within slices of text, then within tasks, then shuffled. A null id has no digits.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, 8_000_000):
                found = _count(as_texts(part.column(1)), part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _prefixes(symbols: np.ndarray, before: np.uint64, power: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hash of everything before each symbol (one more than symbols) and the weight of each place."""
    weights = np.full(len(symbols) + 1, BASE)
    weights[0] = power
    weights = np.multiply.accumulate(weights)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols.astype(np.uint64) * weights[:-1], out=sums[1:])
    return sums + before, weights


def neighbours(word: bytes, symbols: int = SYMBOLS) -> Iterator[np.ndarray]:
    """Hashes of a reduced word and of all words one edit away from it, each word once; the first is its own.

    A deletion inside a run of equal symbols is taken at its start, and a symbol is inserted only where no
    equal one stands before it, so no word comes twice. Long words come in steps.
    """
    code = np.frombuffer(word, np.uint8) - np.uint8(ord("a") - 1)
    inverse, one = np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64(1)
    starts = range(0, len(code), STEP)
    # The states before each step, then the whole word.
    states = [(np.uint64(0), one)]
    for i in starts:
        sums, weights = _prefixes(code[i : i + STEP], *states[-1])
        states.append((sums[-1], weights[-1]))
    whole, end = states[-1]
    n = np.uint64(len(code))
    yield mixed(np.array([whole + n]))
    letters = np.arange(1, symbols + 1, dtype=np.uint64)
    for i, state in zip(starts, states):
        own = code[i : i + STEP]
        sums, weights = _prefixes(own, *state)
        before = np.r_[code[i - 1] if i else np.uint8(0), own[:-1]]
        first = own != before
        deleted = sums[:-1] + (whole - sums[1:]) * inverse + n - one
        change = letters[None, :] - own[:, None].astype(np.uint64)
        replaced = whole + change * weights[:-1, None] + n
        inserted = sums[:-1, None] + letters[None, :] * weights[:-1, None] + (whole - sums[:-1, None]) * BASE + n + one
        yield mixed(np.concatenate([deleted[first], replaced[change != 0], inserted[letters[None, :] != before[:, None]]]))
    last = code[-1] if len(code) else 0
    yield mixed((whole + letters * end + n + one)[letters != last])


def _neighbourhoods(codes: np.ndarray, offsets: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many short words at once: their own hashes, then hashes and word numbers of all neighbours."""
    lengths = np.diff(offsets)
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(codes)) - offsets[word]
    inverse, one = np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64(1)
    table = np.full(int(lengths.max(initial=0)) + 2, BASE)
    table[0] = 1
    table = np.multiply.accumulate(table)
    weight = table[place]
    value = codes.astype(np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(value * weight, out=sums[1:])
    whole = sums[offsets[1:]] - sums[offsets[:-1]]
    n = lengths.astype(np.uint64)
    before_sum = sums[:-1] - sums[offsets[:-1]][word]
    rest = whole[word] - before_sum
    before = np.r_[np.uint8(0), codes[:-1]][: len(codes)]
    before[place == 0] = 0
    letters = np.arange(1, symbols + 1, dtype=np.uint64)[None, :]
    first = codes != before
    deleted = before_sum + (rest - value * weight) * inverse + n[word] - one
    change = letters - value[:, None]
    replaced = (whole + n)[word][:, None] + change * weight[:, None]
    inserted = (before_sum + n[word] + one)[:, None] + letters * weight[:, None] + (rest * BASE)[:, None]
    last = np.where(lengths > 0, codes[np.maximum(offsets[1:] - 1, 0)] if len(codes) else 0, 0)
    added = (whole + n + one)[:, None] + letters * table[lengths][:, None]
    parts = [(deleted, first), (replaced, change != 0), (inserted, letters != before[:, None]), (added, letters != last[:, None])]
    owners = [word, np.repeat(word[:, None], symbols, 1), np.repeat(word[:, None], symbols, 1), np.repeat(np.arange(len(lengths))[:, None], symbols, 1)]
    hashes = np.concatenate([h[good] for h, good in parts])
    return mixed(whole + n), mixed(hashes), np.concatenate([w[good] for w, (_, good) in zip(owners, parts)])


def _generate(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    """``reduced, size`` -> ``rid, near, size``: each reduced word with the neighbours whose hash is not below its own."""

    def rows(rid: np.ndarray, near: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        # The neighbourhood of the other word holds the pairs left out here.
        good = near.view(np.int64) >= rid.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rid[good].view(np.int64)), pa.array(near[good].view(np.int64)), pa.array(size[good])], names=["rid", "near", "size"])

    for batch in batches:
        for part in byte_slices(batch, 0, STEP):
            sizes = part.column(1).to_numpy()
            words = [w.encode() for w in part.column(0).to_pylist()]
            if len(words) == 1:
                made = neighbours(words[0], symbols)
                own = next(made)
                yield rows(own, own, sizes)
                for near in made:
                    yield rows(np.repeat(own, len(near)), near, np.repeat(sizes, len(near)))
                continue
            offsets = np.cumsum([0, *map(len, words)])
            own, near, word = _neighbourhoods(np.frombuffer(b"".join(words), np.uint8) - np.uint8(ord("a") - 1), offsets, symbols)
            yield rows(np.r_[own, own[word]], np.r_[own, near], np.r_[sizes, sizes[word]])


def _own_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [next(neighbours(w.encode())) for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(own).view(np.int64) if own else [], pa.int64())], names=["reduced", "size", "rid"])


def near_words(words: DataFrame, symbols: int = SYMBOLS, tile: int = TILE) -> DataFrame:
    """``a, a_n, b, b_n``: every two words of ``word, n`` that differ by one inserted, deleted or replaced letter, both ways round.

    Words with the same reduced form are one row until the end. If there are many, they are cut into parts of
    about ``tile`` words, and two parts meet at a time.
    """
    letters = "".join(map(chr, LETTERS))
    reduced = F.translate("word", letters, "".join(chr(ord("a") + c % symbols) for c in LETTERS))
    rows = words.withColumn("reduced", reduced)
    forms = rows.groupBy("reduced").agg(F.count(F.lit(1)).alias("size")).mapInArrow(_own_hashes, "reduced string, size long, rid long")
    forms = stage_and_free(forms, "reduced")
    parts = lambda size: F.ceil(F.col(size) / tile).cast("int")
    members = rows.join(forms, "reduced").select("rid", F.pmod(F.xxhash64("word"), parts("size")).cast("int").alias("part"), "word", "n")
    members = stage_and_free(members, "members")

    made = forms.select("reduced", "size").mapInArrow(lambda b: _generate(b, symbols), "rid long, near long, size long")
    others = forms.select(F.col("rid").alias("near"), F.col("size").alias("near_size"))
    pairs = stage_and_free(made.join(others, "near"), "pairs")
    tiles = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), parts("size") - 1))).withColumn("near_part", F.explode(F.sequence(F.lit(0), parts("near_size") - 1)))
    tiles = tiles.select("rid", "part", "near", "near_part")
    left = tiles.join(members, ["rid", "part"]).select("near", "near_part", F.col("word").alias("a"), F.col("n").alias("a_n"), (F.col("rid") == F.col("near")).alias("same"))
    right = members.select(F.col("rid").alias("near"), F.col("part").alias("near_part"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    found = left.join(right, ["near", "near_part"]).filter("levenshtein(a, b, 1) = 1 and (not same or a < b)").select("a", "a_n", "b", "b_n")
    # Reduced words whose hashes collide may bring a pair twice.
    found = stage_and_free(found.distinct(), "near")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, symbols: int = SYMBOLS, tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary.

    ``form`` is the near word of largest ``n`` (of equals the first in code-point order) if it is at least twice
    as frequent, else null; ``root`` is where forms lead (the word itself without one); ``form_n`` is the form's
    ``n``. Null and empty texts have no words; long texts and long words are whole; repeated rows count again;
    other columns are left out. An empty table gives an empty one.
    """
    words = stage_and_free(vocabulary(docs, id_col, text_col, least), "words")
    best = F.min(F.struct((-F.col("b_n")).alias("rank"), F.col("b").alias("form")))
    near = near_words(words, symbols, tile).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    good = -F.col("best.rank") >= RATIO * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.rank")).alias("form_n")
    )
    formed = stage_and_free(formed, "formed")
    ends = _roots(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """Follow ``word, root`` to the end by doubling. Frequencies double at each step, so few rounds are needed."""
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        joined = stage(joined, "roots")
        if joined.filter("moved").isEmpty():
            return joined.select("word", "root")
        steps = joined.select("word", "root")
