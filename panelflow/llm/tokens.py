"""Token ids of whole texts, with every distinct word encoded once.

The vocabulary's pieces never cross white space, so the ids of a text are the ids of its words behind each
other. Words are found and numbered in Arrow; a cache of word stems lives as long as the Python worker.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelflow.llm.common import ragged, text_bytes

#: Stems the cache of one worker holds before it starts anew.
CACHE_WORDS = 500_000
#: Marks that end a word without being part of its last piece, if a letter stands before them. Special tokens have ``<|>``.
_MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
_MARK = f"[{re.escape(_MARKS)}]"
#: Words that may be lower-cased before the library sees them: no normal form and no special token depends on it.
_LETTERS = rf"^[A-Za-zÀ-ÖØ-öø-ÿ]+{_MARK}*$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file whose pieces are split at white space (checked on loading)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        #: For lower-case letters in normal form, which the full path leaves as they are and in one piece. It gets the
        #: letters of their bytes, a word a line.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        #: The letter of every byte: most have their own, the others take the letters above them in turn.
        letters = np.array(sorted(map(ord, pre_tokenizers.ByteLevel.alphabet())), np.uint32)
        self.letters = np.arange(256, dtype=np.uint32)
        self.letters[np.setdiff1d(self.letters, letters)] = letters[letters > 255]
        self.letters[ord("\n")] = ord("\n")
        #: Ids of pieces that end a word.
        vocab = self.whole.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        sample = "The qüick, brown\n fox's\tden."
        joined = [i for w in sample.split() for i in self._ids(self.whole, [w])[0]]
        if self._ids(self.whole, [sample])[0] != joined:
            raise ValueError(f"{path}: pieces cross white space")
        for tail in [*_MARKS, _MARKS]:
            parts = self._ids(self.whole, ["fox", tail, f"fox{tail}"])
            if parts[0] + parts[1] != parts[2]:
                raise ValueError(f"{path}: {tail} is not a piece of its own")
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    @staticmethod
    def _ids(tokenizer, words: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _in_letters(self, text: str) -> str:
        return self.letters[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")

    def _many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words and the number of each word's. Many words are one text; pieces that end a word part them again."""
        texts = [self._in_letters("\n".join(words[i : i + 50])) for i in range(0, len(words), 50)]
        ids = _flat(self._ids(self.plain, texts))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            made = self._ids(self.plain, [self._in_letters(w) for w in words])
            return _flat(made), np.array([len(x) for x in made], np.int64)
        return ids, np.diff(np.r_[0, ends])

    def _known(self, stems: pa.Array) -> np.ndarray:
        """Cache places of distinct stems; unknown ones are encoded first."""
        if len(self.places) > CACHE_WORDS:
            self._forget()
        words, known = stems.to_numpy(zero_copy_only=False).tolist(), self.places
        places = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(places < 0)
        if len(new):
            names = [words[i] for i in new.tolist()]
            plain = np.array([w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w) for w in names])
            fast, slow = [w for w, p in zip(names, plain.tolist()) if p], [w for w, p in zip(names, plain.tolist()) if not p]
            ids, lengths = self._many(fast)
            made = self._ids(self.whole, slow)
            self.ids = np.r_[self.ids, ids, _flat(made)]
            self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(np.r_[lengths, np.array([len(x) for x in made], np.int64)])]
            places[np.r_[new[plain], new[~plain]]] = np.arange(len(known), len(known) + len(new))
            known.update(zip(fast + slow, range(len(known), len(known) + len(new))))
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (large strings without nulls), and the offsets of each text in them."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        low = pc.if_else(pc.match_substring_regex(coded.dictionary, _LETTERS), pc.utf8_lower(coded.dictionary), coded.dictionary)
        distinct = _parted(low).dictionary_encode()
        # Each distinct word is its stem and its tail; then each word of a text is a distinct word.
        pair = self._known(distinct.dictionary)[distinct.indices.to_numpy()]
        pair_len = self.ends[pair + 1] - self.ends[pair]
        pool = self.ids[ragged(self.ends[pair], pair_len)]
        word_len = pair_len.reshape(-1, 2).sum(1)
        word_start = np.cumsum(word_len) - word_len
        index = coded.indices.to_numpy()
        lengths = word_len[index]
        ids = pool[ragged(word_start[index], lengths)]
        ends = np.r_[0, np.cumsum(lengths)]
        return ids, ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]


def _flat(made: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(made), np.uint32)


@cache
def _stays_letter(char: str) -> bool:
    """Whether a letter still ends in one in normal form and lower case; a mark there would join the marks behind it."""
    return char.isalpha() and unicodedata.normalize("NFC", char).lower()[-1].isalpha()


def _parted(words: pa.Array) -> pa.Array:
    """Stem and tail of every word by turns, over the same bytes; a tail may be empty."""
    raw, ends = text_bytes(words)
    start, end = ends[:-1], ends[1:]
    cut = start + pc.binary_length(pc.ascii_rtrim(words, _MARKS)).to_numpy()
    before = np.append(raw, np.uint8(0))[cut - 1]
    letter = (before | 32) - np.uint8(ord("a")) < 26
    wide = np.flatnonzero((before >= 128) & (start < cut) & (cut < end))
    letter[wide] = [_stays_letter(w.rstrip(_MARKS)[-1]) for w in words.take(pa.array(wide)).to_numpy(zero_copy_only=False).tolist()]
    offsets = np.zeros(2 * len(words) + 1, np.int64)
    offsets[2::2], offsets[1::2] = end, np.where(letter & (start < cut), cut, end)
    return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(offsets), pa.py_buffer(raw))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind every text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)
