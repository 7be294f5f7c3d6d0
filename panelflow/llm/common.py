"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelflow.plans import staging

#: Odd, and twice an odd number away from 1: the polynomial hash loses a single bit.
BASE = np.uint64(0xD6E8FEB86659FD93)
#: One random 64-bit value for each byte.
BYTE_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
#: Separators of words: space and the five ASCII controls from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def other_columns(df: DataFrame, produced: set[str]) -> list[str]:
    """Columns of ``df`` that an operator carries through: all but those it writes itself."""
    made = {c.lower() for c in produced}
    return [c for c in df.columns if c.lower() not in made]


def map_texts(
    df: DataFrame, text_col: str, fields: list[T.StructField], fn: Callable[[pa.Array], dict[str, pa.Array]], keep: list[str], limit: int = 2_000_000
) -> DataFrame:
    """Add columns that ``fn`` derives from whole texts to the columns in ``keep``.

    ``fn`` gets the texts (null as empty) in slices of about ``limit`` bytes, each at least one row, so
    memory is bounded by that and by the longest text. It returns one array per field.
    """
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names = [f.name for f in fields]
    sent = [f"`{c}`" for c in keep]
    # A kept text is sent once.
    at = keep.index(text_col) if text_col in keep and df.schema[text_col].dataType == T.StringType() else len(keep)
    if at == len(keep):
        sent.append(f"cast(`{text_col}` as string) as `__text__`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, at, limit):
                made = fn(as_texts(part.column(at)))
                arrays = [part.column(i) for i in range(len(keep))] + [made[n] for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names=keep + names)

    return df.selectExpr(*sent).mapInArrow(run, schema)


def stage_and_free(df: DataFrame, label: str) -> DataFrame:
    """``stage``, after which the shuffle files of the job are removed at once instead of when the driver collects garbage.

    ``df`` should not be run again: it would have to shuffle anew.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return staging.stage(df, label)
    finally:
        conf.set(key, before)


def as_texts(col: pa.Array) -> pa.Array:
    return col.cast(pa.large_string()).fill_null("")


def byte_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that each part has about ``limit`` bytes of a text column."""
    if not batch.num_rows:
        return
    ends = text_bytes(as_texts(batch.column(column)))[1][1:]
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else ends[0] * 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind each other, and the offsets of the texts (one more than texts)."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start .. start + length - 1`` of every run, behind each other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``BASE`` and of its inverse modulo 2**64, kept between calls up to 4M."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(size, BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 4_000_000:
            return up[:n], down[:n]
        _powers["up"], _powers["down"] = up, down
    return _powers["up"][:n], _powers["down"][:n]


class PrefixHash:
    """Polynomial hashes of any substring of ``raw`` from prefix sums: equal strings, equal hashes."""

    def __init__(self, raw: np.ndarray, values: np.ndarray = BYTE_VALUES):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


_PRIME = np.uint64((1 << 31) - 1)
#: Two bases and two values of every byte modulo the prime.
_PRIME_BASES = [int(x) for x in np.random.default_rng(22).integers(1 << 20, (1 << 31) - 1, 2)]
_PRIME_VALUES = np.random.default_rng(23).integers(1, (1 << 31) - 1, (2, 256), dtype=np.uint64)
_prime_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """The same modulo the prime, below 2**33."""
    return (x & _PRIME) + (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(x))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _reduced(out * np.uint64(pow(base, len(out), int(_PRIME))))])
    return out[:n]


class PrimeHash:
    """62-bit hashes of any substring of ``raw``: two polynomials with different bases modulo 2**31 - 1.

    Unlike hashes modulo a power of two, these have no long strings that collide under every base.
    """

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        self.sums, self.down = [], []
        for i, base in enumerate(_PRIME_BASES):
            kept = _prime_powers.get(i)
            if kept is None or len(kept[0]) < n:
                size = max(n, 1 << 16)
                kept = _powers_of(base, size), _powers_of(pow(base, -1, int(_PRIME)), size)
                if size <= 4_000_000:
                    _prime_powers[i] = kept
            up, down = kept
            sums = np.zeros(n, np.uint64)
            # Terms below 2**33: the sum of two billion of them fits.
            np.cumsum(_folded(_PRIME_VALUES[i][raw] * up[: n - 1]), out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = (_reduced(_reduced(s[ends] - s[starts]) * d[starts]) for s, d in zip(self.sums, self.down))
        return a << np.uint64(31) | b


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sums_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each ``[offsets[i], offsets[i + 1])``; empty ranges give 0."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a word never crosses the border of two texts."""
    word = ~IS_SPACE[raw]
    start, end = word.copy(), word.copy()
    if len(raw):
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        filled = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][filled], offsets[1:][filled] - 1
        start[first], end[last] = word[first], word[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1
