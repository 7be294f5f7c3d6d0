"""Similarity join on word n-grams: banded MinHash with exact verification.

Each text has one key for each of many trees, the hash of a prefix of MinHash values. The length of that prefix is
worked out once, from the threshold and the target recall; signatures are not sorted and no length follows the
data, so this is the fixed-band form of an LSH forest. Whoever shares a key is compared exactly, in tiles of bounded
size, and each pair is counted in a single node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.llm.common import BASE, PrimeHash, fresh, map_texts, mixed, other_columns, text_bytes, word_bounds
from panelflow.llm.components import components
from panelflow.plans.staging import stage

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 32, 8, 0.9999
#: Texts, and their n-grams in all, of one block of a tile.
TILE, TILE_GRAMS = 512, 2_000_000
_FACTORS = np.random.default_rng(21).integers(1, 2**31, (TREES * DEPTH * 4,), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def prefix_length(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which two texts of the threshold similarity meet in some tree with the target recall."""
    for n in range(depth, 1, -1):
        if 1 - (1 - similarity**n) ** trees >= recall:
            return n
    return 1


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word n-grams of every text in ascending order, and their offsets. A shorter text is one n-gram."""
    raw, offsets = text_bytes(texts)
    starts, ends = word_bounds(raw, offsets)
    cuts = np.searchsorted(starts, offsets)
    n_words, n = np.diff(cuts), len(texts)
    word = mixed(PrimeHash(raw).of(starts, ends) + (ends - starts).astype(np.uint64))
    gram = np.r_[word, np.zeros(words - 1, np.uint64)]
    padded = gram
    for k in range(1, words):
        gram = gram[: len(word)] * BASE + padded[k : k + len(word)]
    doc = np.repeat(np.arange(n), n_words)
    left = cuts[1:][doc] - np.arange(len(word))
    keep = left >= words
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    for d in short.tolist():
        value = np.uint64(n_words[d])
        for w in word[cuts[d] : cuts[d + 1]]:
            value = mixed(np.array([value]) * BASE + w)[0]
        gram[cuts[d]], keep[cuts[d]] = value, True
    gram, doc = mixed(gram[: len(word)])[keep], doc[keep]
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])][: len(gram)]
    gram, doc = gram[new], doc[new]
    return gram, np.searchsorted(doc, np.arange(n + 1))


_SIGNATURE = [
    T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("n_grams", T.LongType()), T.StructField("prefixes", T.ArrayType(T.LongType())),
]


def signatures(docs: DataFrame, keep: list[str], text_col: str, words: int, trees: int, length: int) -> DataFrame:
    """Of every text: an id of its set of n-grams, the size of the set, and the hashed prefix in each tree."""
    factors = _FACTORS[: trees * length].reshape(trees, length)

    def measure(texts: pa.Array) -> dict[str, pa.Array]:
        gram, offsets = shingles(texts, words)
        n, size = len(texts), np.diff(offsets)
        full = np.flatnonzero(size > 0)
        ids = np.zeros((n, 2), np.uint64)
        prefix = np.zeros((n, trees), np.uint64)
        if len(full):
            first = offsets[:-1][full]
            ids[full, 0] = np.add.reduceat(mixed(gram), first)
            ids[full, 1] = np.add.reduceat(mixed(gram ^ BASE), first)
            short = (gram >> np.uint64(32)).astype(np.uint32)
            for t in range(trees):
                value = np.full(len(full), np.uint64(t + 1))
                for f in factors[t]:
                    value = mixed(value * BASE + np.minimum.reduceat(short * f, first))
                prefix[full, t] = value
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * trees), pa.array(prefix.view(np.int64).ravel()))
        return {"set_a": pa.array(ids[:, 0].copy().view(np.int64)), "set_b": pa.array(ids[:, 1].copy().view(np.int64)), "n_grams": pa.array(size), "prefixes": flat}

    return map_texts(docs, text_col, _SIGNATURE, measure, keep)


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, tile: int = TILE,
) -> DataFrame:
    """``doc_id, class_id, n_links, n_grams, text_key, root`` for every row.

    Two rows are linked if the Jaccard similarity of their sets of ``words``-grams is at least
    ``similarity``; ``n_links`` counts the linked rows of a row, and a class is what links connect.
    ``class_id`` is the smallest id in the class (null if it has none), ``root`` its smallest set. Texts of
    under ``words`` words are one n-gram; two texts without any word count as equal. Null texts are empty.
    Repeated rows are copies of each other. Copies are counted, never paired. An empty table gives an empty
    one.
    """
    length = prefix_length(similarity, trees, depth, recall)
    rows = _rows(docs, id_col, text_col)
    signed = stage(signatures(rows, ["doc_id", "text_key"], "text", words, trees, length), "signed")
    sets = signed.groupBy("set_a", "set_b").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.first("n_grams").alias("n_grams"), F.first("prefixes").alias("prefixes")
    )
    sets = stage(sets, "sets")
    found = stage(_compare(_met(sets), rows, words, similarity, tile), "found")
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    roots = components(found.select(pair("set_a", "set_b").alias("u"), pair("root_a", "root_b").alias("v")))
    roots = roots.select(F.col("node.a").alias("set_a"), F.col("node.b").alias("set_b"), "root")
    links = found.groupBy("set_a", "set_b").agg(F.sum("links").alias("links"))
    known = sets.select("set_a", "set_b", "copies", "first_id").join(links, ["set_a", "set_b"], "left").join(roots, ["set_a", "set_b"], "left")
    known = stage(known.withColumn("root", F.coalesce("root", pair("set_a", "set_b"))), "known")
    classes = known.groupBy("root").agg(F.min("first_id").alias("class_id"))
    known = known.join(classes, "root").select("set_a", "set_b", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.drop("prefixes").join(known, ["set_a", "set_b"]).select("doc_id", "class_id", "n_links", "n_grams", "text_key", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each class, with all its columns: that with the smallest id (nulls last), then the smallest text key.

    Of rows that agree in id and text any one stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("x")
    chosen = join(docs, id_col, text_col, **settings).groupBy("root").agg(first).select(F.col("x.doc_id").alias("__id__"), F.col("x.text_key").alias("__key__"))
    key, name = fresh(docs, "__key__"), fresh(docs, "__id__")
    chosen = chosen.withColumnsRenamed({"__key__": key, "__id__": name})
    keyed = docs.withColumn(key, text_key(text_col))
    same = (keyed[key] == chosen[key]) & keyed[f"`{id_col}`"].cast("long").eqNullSafe(chosen[name])
    return keyed.join(chosen, same, "left_semi").dropDuplicates([key]).drop(key)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.withColumn("text_key", text_key("text"))


def _met(sets: DataFrame) -> DataFrame:
    """Of every set that meets another: its text's key, size and copies, and the ``nodes`` where it has company.

    Nodes with the same company are one: they agree in the number of sets, the sum of their sizes and the
    XOR of their hashes. So a pair that meets in twenty trees is compared once.
    """
    at = sets.filter("n_grams > 0").select("set_a", "set_b", "n_grams", F.explode("prefixes").alias("node"))
    nodes = at.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"), F.bit_xor(F.xxhash64("set_a", "set_b")).alias("who")).filter("n > 1")
    nodes = nodes.groupBy("who", "n", "grams").agg(F.min("node").alias("node"))
    mine = at.select("set_a", "set_b", "node").join(nodes.select("node", "n", "grams"), "node")
    mine = mine.groupBy("set_a", "set_b").agg(F.sort_array(F.collect_list(F.struct("node", "n", "grams"))).alias("nodes"))
    return mine.join(sets.select("set_a", "set_b", "copies", "text_key"), ["set_a", "set_b"])


_FOUND = "set_a long, set_b long, links long, root_a long, root_b long"


def _compare(met: DataFrame, rows: DataFrame, words: int, similarity: float, tile: int) -> DataFrame:
    """Exact comparison of the sets in each node: linked copies of every set, and a smaller set it is connected to."""
    texts = rows.select("text_key", "text").dropDuplicates(["text_key"]).join(met, "text_key").drop("text_key")
    keep = ["set_a", "set_b", "copies", "nodes"]

    def grams(texts: pa.Array) -> dict[str, pa.Array]:
        gram, offsets = shingles(texts, words)
        return {"grams": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(gram.view(np.int64)))}

    sets = map_texts(texts, "text", [T.StructField("grams", T.ArrayType(T.LongType()))], grams, keep)
    # A large node is cut into blocks, and every pair of blocks is a tile.
    sets = sets.withColumn("names", F.transform("nodes", lambda x: x["node"])).withColumn("x", F.explode("nodes")).drop("nodes")
    blocks = F.greatest(F.ceil(F.col("x.n") / tile), F.ceil(F.col("x.grams") / TILE_GRAMS)).cast("int")
    sets = sets.select("set_a", "set_b", "copies", "names", "grams", F.col("x.node").alias("node"), blocks.alias("blocks"))
    sets = sets.withColumn("block", F.pmod(F.xxhash64("set_a", "set_b"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = sets.select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_a", "set_b", "copies", "names", "grams")
    return tiles.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(lambda batches: _verify(batches, similarity), _FOUND)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal (node, i, j), which come behind each other."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = [table.column(i).to_numpy() for i in range(3)]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        first = 0
        for last in cuts.tolist():
            yield table.slice(first, last - first)
            first = last
        rest = table.slice(first)
    if rest is not None and rest.num_rows:
        yield rest


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    names = ["set_a", "set_b", "links", "root_a", "root_b"]
    out: list[np.ndarray] = []
    for run in _runs(batches):
        if (rows := _tile(run, similarity)) is not None:
            out.append(rows)
        if len(out) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], names=names)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _tile(run: pa.Table, similarity: float) -> np.ndarray | None:
    n = run.num_rows
    node, i, j = (run.column(c)[0].as_py() for c in range(3))
    block, a, b, copies = (run.column(c).to_numpy() for c in range(3, 7))
    gram, size = _lists(run.column(8))
    shared = _common(gram, size)
    linked = shared >= similarity * (size[:, None] + size - shared) - 1e-9
    if i != j:
        linked &= block[:, None] != block
    np.fill_diagonal(linked, False)
    if not linked.any():
        return None
    # A pair belongs to the first node in which it meets.
    names, count = _lists(run.column(7))
    before = names < node
    count = np.bincount(np.repeat(np.arange(n), count)[before], minlength=n)
    linked &= _common(names[before], count) == 0
    if not linked.any():
        return None
    order = np.lexsort((b, a))
    lower, label = order.argsort(), None
    while label is None or (lower != label).any():
        label = lower
        lower = np.minimum(label, np.where(linked, label, n).min(axis=1))
    root = order[label]
    own = np.flatnonzero(linked.any(axis=1))
    return np.stack([a, b, linked @ copies, a[root], b[root]], 1)[own]


def _common(values: np.ndarray, size: np.ndarray, width: int = 4096) -> np.ndarray:
    """Number of common values of each two lists of distinct values, from products of 0/1 matrices."""
    n = len(size)
    out = np.zeros((n, n), np.int64)
    if not len(values):
        return out
    row = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    column = np.cumsum(np.r_[0, values[1:] != values[:-1]])
    often = np.bincount(column)[column] > 1
    column, row = column[often], row[often]
    if not len(column):
        return out
    column = np.cumsum(np.r_[0, column[1:] != column[:-1]])
    for first in range(0, int(column[-1]) + 1, width):
        own = slice(*np.searchsorted(column, [first, first + width]))
        hits = np.zeros((n, width), np.float32)
        hits[row[own], column[own] - first] = 1
        out += (hits @ hits.T).astype(np.int64)
    return out
