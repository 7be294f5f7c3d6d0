"""Fill-in-the-middle on seekable compressed texts.

A text is kept as independent zstandard frames, with the code points and the compressed bytes up to the end
of each frame. To cut a text, only the frames at the cuts are decoded; digests and rewritten texts are
streams of frames in order. So a task holds one text in compressed form and a few frames, never a second
whole copy.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.llm.common import map_texts, text_bytes

#: Bytes of text in a frame; a frame ends at a whole code point.
FRAME = 1 << 17
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percentage of texts that stay plain, and of the others that put the suffix first.
PLAIN_SHARE, SPM_SHARE = 10, 20

_FRAMES = [
    T.StructField("unit_ends", T.ArrayType(T.LongType(), False)),
    T.StructField("byte_ends", T.ArrayType(T.LongType(), False)),
    T.StructField("frames", T.BinaryType()),
]


def _units(data: bytes) -> int:
    """Code points that start in ``data``."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


class Writer:
    """Collects pieces of whole code points and compresses a frame whenever one is full."""

    def __init__(self, frame: int = FRAME):
        self.frame, self.packer = frame, zstandard.ZstdCompressor(level=3)
        self.rest, self.out = bytearray(), bytearray()
        self.unit_ends: list[int] = []
        self.byte_ends: list[int] = []

    def add(self, piece: bytes | memoryview) -> None:
        for at in range(0, len(piece), self.frame):
            self.rest += piece[at : at + self.frame]
            while len(self.rest) >= self.frame + 4:
                end = self.frame
                while self.rest[end] & 0xC0 == 0x80:
                    end -= 1
                self._close(end)

    def _close(self, end: int) -> None:
        data = bytes(self.rest[:end])
        del self.rest[:end]
        self.out += self.packer.compress(data)
        self.unit_ends.append(_units(data) + (self.unit_ends[-1] if self.unit_ends else 0))
        self.byte_ends.append(len(self.out))

    def done(self) -> tuple[list[int], list[int], bytes]:
        if self.rest:
            self._close(len(self.rest))
        return self.unit_ends, self.byte_ends, bytes(self.out)


class Reader:
    """Random access by code points to a text in frames."""

    def __init__(self, unit_ends: list[int], byte_ends: list[int], frames: bytes | memoryview):
        self.unit_ends, self.byte_ends, self.frames = unit_ends, byte_ends, memoryview(frames)
        self.unpacker, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def __len__(self) -> int:
        return self.unit_ends[-1] if self.unit_ends else 0

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            own = self.frames[self.byte_ends[i - 1] if i else 0 : self.byte_ends[i]]
            self.last = i, self.unpacker.decompress(own)
        return self.last[1]

    def read(self, start: int, end: int) -> Iterator[bytes]:
        """UTF-8 of the code points from ``start`` to before ``end``, frame by frame."""
        i = bisect_right(self.unit_ends, start)
        while start < end:
            first, last = self.unit_ends[i - 1] if i else 0, self.unit_ends[i]
            data = self.frame(i)
            if start > first or end < last:
                data = data.decode()[start - first : end - first].encode()
            yield data
            start, i = last, i + 1

    def find(self, marks: list[bytes]) -> dict[bytes, int]:
        """Code points before the first occurrence of each mark (of ASCII, equally long) that is in the text."""
        found: dict[bytes, int] = {}
        size, tail, before = len(marks[0]), b"", 0
        for i in range(len(self.unit_ends)):
            data = tail + self.frame(i)
            for mark in marks:
                if mark not in found and (at := data.find(mark)) >= 0:
                    found[mark] = before + _units(data[:at])
            tail = data[max(0, len(data) - size + 1) :]
            before = self.unit_ends[i] - _units(tail)
        return found


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> DataFrame:
    """``doc_id, marked, unit_ends, byte_ends, frames`` for every row: the text (null as empty) in frames.

    ``marked`` tells whether the text holds one of the three marks. An empty text has no frame. Long texts
    have many frames; repeated rows are stored alone; null ids stay null; other columns are left out. An empty
    table gives an empty one.
    """
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))

    def pack(texts: pa.Array) -> dict[str, pa.Array]:
        raw, offsets = text_bytes(texts)
        made = []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            writer = Writer(frame)
            writer.add(raw[lo:hi].data)
            made.append(writer.done())
        return {"marked": pc.match_substring_regex(texts, "<[PSM]>"), **_columns(made)}

    return map_texts(rows, "text", [T.StructField("marked", T.BooleanType()), *_FRAMES], pack, ["doc_id"])


def _columns(made: list[tuple[list[int], list[int], bytes]]) -> dict[str, pa.Array]:
    units, ends, blobs = zip(*made) if made else ((), (), ())
    return {"unit_ends": pa.array(units, pa.list_(pa.int64())), "byte_ends": pa.array(ends, pa.list_(pa.int64())), "frames": pa.array(blobs, pa.binary())}


def plan(doc_id: int | None, n: int, marked: bool) -> tuple[str, int | None, int | None]:
    """Form, end of the prefix and end of the middle of a text of ``n`` code points, drawn from the id (null as no digits)."""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    if not n or marked or h3 % 100 >= 100 - PLAIN_SHARE:
        return "plain", None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < SPM_SHARE else "psm"), a, b


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(n)[i].as_py() for n in names)


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows whose last field is binary, in batches of about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 200
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_LONGS = pa.list_(pa.int64())
_REWRITTEN = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("unit_ends", _LONGS), ("byte_ends", _LONGS), ("frames", pa.binary())]
)
_REWRITTEN_SQL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, unit_ends array<long>, byte_ends array<long>, frames binary"


def rearrange(stored: DataFrame, frame: int = FRAME) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` and the rewritten text in frames, for every stored row.

    Plain: the text itself, with null for the two lengths. Prefix first: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle.
    Suffix first: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. Texts that are empty or hold a mark stay plain.
    Rows with equal ids are cut at places that differ only by their lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(map(one, _rows(batches, ["doc_id", "marked", "unit_ends", "byte_ends", "frames"])), _REWRITTEN)

    def one(row: tuple) -> tuple:
        doc_id, marked, *framed = row
        text = Reader(*framed)
        n = len(text)
        form, a, b = plan(doc_id, n, marked)
        if form == "plain":
            return doc_id, n, form, None, None, *framed
        prefix, middle, suffix = (0, a), (a, b), (b, n)
        order = [(PREFIX, prefix), (SUFFIX, suffix)] if form == "psm" else [(SUFFIX, suffix), (PREFIX, prefix)]
        writer = Writer(frame)
        for mark, part in [*order, (MIDDLE, middle)]:
            writer.add(mark)
            for piece in text.read(*part):
                writer.add(piece)
        return doc_id, n, form, a, b - a, *writer.done()

    return stored.mapInArrow(run, _REWRITTEN_SQL)


def original(form: str, text: Reader) -> Iterator[bytes]:
    """The text before rewriting, as a stream of UTF-8 pieces, from the rewritten one and its form alone."""
    if form == "plain":
        return text.read(0, len(text))
    at = text.find([PREFIX, SUFFIX, MIDDLE])
    size = len(PREFIX)
    bounds = sorted([*at.values(), len(text)])
    parts = {mark: (first + size, bounds[bounds.index(first) + 1]) for mark, first in at.items()}
    return (piece for mark in (PREFIX, MIDDLE, SUFFIX) for piece in text.read(*parts[mark]))


def texts(framed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The whole text of every row of frames, as a column ``text`` beside those in ``keep``."""
    keep = ["doc_id"] if keep is None else keep
    schema = T.StructType([*(framed.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                reader = Reader(*(batch.column(n)[i].as_py() for n in ("unit_ends", "byte_ends", "frames")))
                text = b"".join(reader.read(0, len(reader))).decode()
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, 1) for n in keep), pa.array([text], pa.string())], names=[*keep, "text"])

    return framed.select(*keep, "unit_ends", "byte_ends", "frames").mapInArrow(run, schema)


def restore(rewritten: DataFrame) -> DataFrame:
    """``doc_id, unit_ends, byte_ends, frames``: the texts that ``rearrange`` was given, in frames."""

    def one(row: tuple) -> tuple:
        doc_id, form, *framed = row
        writer = Writer()
        for piece in original(form, Reader(*framed)):
            writer.add(piece)
        return doc_id, *writer.done()

    schema = pa.schema([_REWRITTEN.field(n) for n in ("doc_id", "unit_ends", "byte_ends", "frames")])
    names = ["doc_id", "form", "unit_ends", "byte_ends", "frames"]
    return rewritten.select(*names).mapInArrow(lambda b: _batches(map(one, _rows(b, names)), schema), "doc_id long, unit_ends array<long>, byte_ends array<long>, frames binary")


def digests(rewritten: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every rewritten text."""

    def sha256(pieces: Iterator[bytes]) -> str:
        digest = hashlib.sha256()
        for piece in pieces:
            digest.update(piece)
        return digest.hexdigest()

    def measure(form: str, text: Reader) -> tuple[str, str]:
        return sha256(text.read(0, len(text))), sha256(original(form, text))

    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [measure(form, Reader(*framed)) for form, *framed in _rows(iter([batch]), ["form", "unit_ends", "byte_ends", "frames"])]
            out, back = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.string()), pa.array(back, pa.string())], names=[*kept, "output_sha256", "restored_sha256"])

    fields = [rewritten.schema[n] for n in kept] + [T.StructField(n, T.StringType()) for n in ("output_sha256", "restored_sha256")]
    return rewritten.select(*[F.col(n) for n in [*kept, "unit_ends", "byte_ends", "frames"]]).mapInArrow(run, T.StructType(fields))
