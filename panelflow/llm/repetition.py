"""Quality rules by repetition coverage.

A text is cut into words and lines. Rolling hashes of word n-grams of several lengths, all in numpy over
a slice of many texts at once, mark the n-grams that occur more than once in their own text; what counts
is the share of word characters that such n-grams or repeated lines cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelflow.llm.common import BASE, PrimeHash, map_texts, mixed, other_columns, sums_between, text_bytes, word_bounds

#: Largest share of word characters inside repeated n-grams, by words in the n-gram.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of word characters inside lines that repeat (first included).
LINE_LIMIT = 0.50
#: Largest number of symbols for each word.
SYMBOL_LIMIT = 0.10
SYMBOLS = b"#*$%&|<>"

FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("line_coverage", T.DoubleType()),
    *(T.StructField(f"coverage_{n}", T.DoubleType()) for n in NGRAM_LIMITS),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
]


def judge(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts, coverages and the verdict ``kept`` for every row.

    ``keep`` names the columns to carry (all by default); a column with the name of a result is replaced.
    A null or empty text has no words and fails the base rule. Repeated rows are judged alone, so each of
    them gets the same verdict. An empty table gives an empty table.
    """
    names = {f.name for f in FIELDS}
    carried = other_columns(docs if keep is None else docs.select(*[f"`{c}`" for c in keep]), names)
    return map_texts(docs, text_col, FIELDS, _measure, carried)


def _measure(texts: pa.Array) -> dict[str, pa.Array]:
    raw, offsets = text_bytes(texts)
    n = len(texts)
    hashes = PrimeHash(raw)
    letters = (raw & 0xC0) != 0x80
    starts, ends = word_bounds(raw, offsets)
    cuts = np.searchsorted(starts, offsets)
    n_words = np.diff(cuts)
    doc = np.repeat(np.arange(n), n_words)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(letters, out=chars[1:])
    word_len = chars[ends] - chars[starts]
    word_chars = sums_between(word_len, cuts)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    gram = mixed(hashes.of(starts, ends) + (ends - starts).astype(np.uint64))
    words, salt = gram, mixed(np.arange(1, n + 1, dtype=np.uint64))[doc]
    out: dict[str, np.ndarray] = {}
    n_repeat = np.zeros(n, np.int64)
    for k in range(2, max(NGRAM_LIMITS) + 1):
        gram = gram[:-1] * BASE + words[k - 1 :]
        if k not in NGRAM_LIMITS:
            continue
        whole = doc[: len(gram)] == doc[k - 1 :] if len(gram) else np.zeros(0, bool)
        inside = _covered(_repeated(mixed(gram) ^ salt[: len(gram)], whole), k, len(words))
        if k == 5:
            n_repeat = sums_between(inside, cuts)
        out[f"coverage_{k}"] = sums_between(word_len * inside, cuts) / np.maximum(word_chars, 1)

    dup_lines, line_chars = _lines(raw, offsets, hashes, starts, word_len)
    out["line_coverage"] = line_chars / np.maximum(word_chars, 1)
    n_symbols = sums_between(symbol[raw], offsets)
    base_failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    bad = out["line_coverage"] > LINE_LIMIT
    for k, limit in NGRAM_LIMITS.items():
        bad |= out[f"coverage_{k}"] > limit
    bad |= n_symbols > SYMBOL_LIMIT * n_words
    out |= {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat}
    out |= {"base_failed": base_failed, "kept": ~(base_failed | bad)}
    return {k: pa.array(v) for k, v in out.items()}


def _repeated(keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Which valid keys occur at least twice. Most texts have none, so only values are sorted."""
    ordered = np.sort(keys[valid])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return valid & (twice[at] == keys)


def _covered(marks: np.ndarray, k: int, n: int) -> np.ndarray:
    """Words inside any marked window of ``k`` words."""
    steps = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return np.cumsum(steps[:-1]) > 0


def _lines(raw: np.ndarray, offsets: np.ndarray, hashes: PrimeHash, starts: np.ndarray, word_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word that equal an earlier line; characters of words in repeated lines."""
    breaks = np.flatnonzero(raw == 10)
    n = len(offsets) - 1
    doc = np.r_[np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]
    first = np.r_[offsets[:-1], breaks + 1]
    order = np.lexsort((first, doc))
    doc, first = doc[order], first[order]
    last = np.r_[first[1:] - 1, len(raw)]
    final = np.r_[doc[1:] != doc[:-1], True][: len(doc)]
    last[final] = offsets[1:][doc[final]]
    at = np.searchsorted(starts, first), np.searchsorted(starts, last)
    filled = at[1] > at[0]
    doc, first, last, lo, hi = doc[filled], first[filled], last[filled], at[0][filled], at[1][filled]
    key = mixed(hashes.of(first, last) + (last - first).astype(np.uint64)) ^ mixed(doc.astype(np.uint64) + np.uint64(1))
    _, index, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = times[index] > 1
    earliest = np.full(len(times), len(key))
    np.minimum.at(earliest, index, np.arange(len(key)))
    later = np.arange(len(key)) > earliest[index]
    total = np.zeros(len(word_len) + 1, np.int64)
    np.cumsum(word_len, out=total[1:])
    return np.bincount(doc[later], minlength=n), np.bincount(doc[repeated], (total[hi] - total[lo])[repeated], minlength=n)
