"""Ids by the tokenizers library, remembered per chunk of text.

A text is cut only where the tokenizer's own pre-tokenisation cuts whatever follows, so the ids of the
chunks, joined, are the ids of the text; the library encodes each distinct chunk once per worker. Cuts are found
on the bytes of a whole Arrow column, and its chunks are one more Arrow column over the same bytes, so nothing is
done per word but for the distinct ones. Texts with characters on which regular-expression engines differ go to the
library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltstone.llm.kernels import buffer

#: ASCII letters and letters of Latin-1.
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")

#: Classes of bytes. Punctuation is that of ASCII but for the apostrophe, which can begin a contraction.
_OTHER, _LETTER, _MARK, _BLANK = range(4)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _MARK
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
#: Bytes that stand in every odd character: controls, and first bytes of its UTF-8 form; and the first of "<|".
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F, 0x3C, 0xC2, 0xCD, 0xD8, 0xE1, 0xE2, 0xE3, 0xEF, 0xF3]] = True
#: Control, format and unassigned characters, spaces beyond ASCII, and the mark that begins special tokens.
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0͏؜ᅟᅠ ឴឵᠋-᠏ -‏ -  -⁯　ㅤ︀-️﻿ﾠ￰-￿\U000e0000-\U000e0fff]|<\\|")

#: Chunks remembered at most, some 50 bytes each; the memory is emptied then, which changes no result.
REMEMBERED = 1_500_000
#: Bytes of a chunk that fit in two 64-bit numbers beside its length.
SHORT = 15
#: The low bytes of a 64-bit number, by how many.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_encoders: dict[str, "Encoder"] = {}


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of all texts begin; they cover the texts without gaps.

    Chunks begin with every text; between letters and punctuation of a run of nothing else; before a run of blanks and
    before its last blank, if a word follows; and before a word, unless the blank before it is a space, which belongs to it.
    """
    n = len(raw)
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin = np.zeros(n + 1, bool)
    begin[heads] = True
    begin[n] = True
    blank = kind == _BLANK
    after = np.zeros(n, bool)
    after[1:] = blank[:-1]
    after &= ~begin[:-1]
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~blank[1:] & ~begin[1:-1]
    cut = begin[:-1] | (blank & (~after | before_word))
    spaced = np.zeros(n, bool)
    spaced[1:] = raw[:-1] == 0x20
    cut |= ~blank & after & ~spaced
    # Letters and punctuation part where their whole run is plain: its number of other bytes is nil.
    turn = np.flatnonzero(~blank[1:] & ~blank[:-1] & (kind[1:] != kind[:-1]) & ~begin[1:-1]) + 1
    turn = turn[(kind[turn] != _OTHER) & (kind[turn - 1] != _OTHER)]
    if len(turn):
        others = np.flatnonzero(kind == _OTHER)
        edge = np.flatnonzero(blank | begin[:-1])
        run = np.searchsorted(edge, turn, "right")
        low, high = np.append(edge, n)[run - 1], np.append(edge, n)[run]
        low[run == 0] = 0
        cut[turn[np.searchsorted(others, low) == np.searchsorted(others, high)]] = True
    found = np.flatnonzero(cut)
    odd = _odd_texts(raw, offsets)
    if len(odd):
        # A text that the library gets whole is one chunk.
        text = np.searchsorted(offsets, found, "right") - 1
        found = found[~np.isin(text, odd) | (found == offsets[text])]
    return found


def _odd_texts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    suspect = np.unique(np.searchsorted(offsets, np.flatnonzero(_SUSPECT[raw]), "right") - 1)
    whole = memoryview(raw)
    return np.array([t for t in suspect.tolist() if _ODD.search(str(whole[offsets[t] : offsets[t + 1]], "utf-8"))], np.int64)


class ShortChunks:
    """Numbers of chunks of 1 to SHORT bytes. The key is the chunk itself, not a hash of it: its bytes and its length.

    An open table: a key stands at its slot or at the next free ones after it.
    """

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.number = np.zeros(1 << bits, np.int32)

    @staticmethod
    def keys(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.append(raw, np.zeros(16, np.uint8))
        eight = np.ndarray(len(raw) + 8, "<u8", padded, 0, (1,))
        low = eight[begin] & _LOW[np.minimum(size, 8)]
        high = eight[np.minimum(begin + 8, len(raw))] & _LOW[np.maximum(size - 8, 0)]
        return low, high | size.astype(np.uint64) << np.uint64(56)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 where there is none."""
        at = self._slot(low, high)
        there = self.high[at]
        hit = (there == high) & (self.low[at] == low)
        out = np.where(hit, self.number[at], -1).astype(np.int64)
        todo = np.flatnonzero(~hit & (there != 0))
        at[todo] = at[todo] + 1 & (1 << self.bits) - 1
        while len(todo):
            slot, there = at[todo], self.high[at[todo]]
            hit = (there == high[todo]) & (self.low[slot] == low[todo])
            out[todo[hit]] = self.number[slot[hit]]
            todo = todo[~hit & (there != 0)]
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
        return out

    def add(self, low: np.ndarray, high: np.ndarray, first: int) -> None:
        """Number distinct keys that are not there from first on."""
        if 4 * (self.n + len(low)) > 3 << self.bits:
            bits = (4 * (self.n + len(low)) // 3).bit_length()
            held = np.flatnonzero(self.high)
            old = self.low[held], self.high[held], self.number[held]
            self.__init__(bits)
            self._put(*old)
        self._put(low, high, np.arange(first, first + len(low), dtype=np.int32))

    def _put(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        at, todo = self._slot(low, high), np.arange(len(low))
        while len(todo):
            free = todo[self.high[at[todo]] == 0]
            # Of several keys for one slot the last stays; the others look on.
            self.low[at[free]], self.high[at[free]], self.number[at[free]] = low[free], high[free], number[free]
            todo = todo[(self.low[at[todo]] != low[todo]) | (self.high[at[todo]] != high[todo])]
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
        self.n += len(low)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tok = Tokenizer.from_file(path)
        self._word = not isinstance(self._tok.pre_tokenizer, pre_tokenizers.ByteLevel)
        # For a chunk of letters: it is one pre-token already, normalisation only lowers its case, and what stands for its
        # bytes is known.
        self._letters = Tokenizer.from_file(path)
        self._letters.normalizer = self._letters.pre_tokenizer = None
        self._letters.model._resize_cache(0)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in [" ", *filter(_LETTERS.fullmatch, map(chr, range(0x80, 0x100)))]})
        self._blank = self._bytes[32]
        self._forget()

    def _forget(self) -> None:
        self._n = 0
        self._short = ShortChunks()
        self._long: dict[str, int] = {}
        self._flat = np.zeros(1 << 16, np.uint32)
        self._first = np.zeros(1 << 16, np.int64)

    def _learn(self, new: list[str]) -> None:
        plain = [_LETTERS.fullmatch(c) is not None for c in new]
        letters = [c for c, x in zip(new, plain, strict=True) if x]
        if self._word:
            letters = [c.lstrip(" ").lower() for c in letters]
        letters = [c.replace(" ", self._blank) if c.isascii() else c.translate(self._bytes) for c in letters]
        simple = iter(self._letters.encode_batch_fast(letters, add_special_tokens=False))
        other = iter(self._tok.encode_batch_fast([c for c, x in zip(new, plain, strict=True) if not x], add_special_tokens=False))
        ids = [next(simple if x else other).ids for x in plain]
        n, lengths = self._n, np.fromiter(map(len, ids), np.int64, len(ids))
        ends = self._first[n] + np.cumsum(lengths)
        while len(self._first) <= n + len(new):
            self._first = np.concatenate([self._first, np.zeros_like(self._first)])
        while len(self._flat) < ends[-1]:
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._first[n] : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        self._first[n + 1 : n + 1 + len(new)] = ends
        self._n += len(new)

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of every chunk of all texts, and the n + 1 places where the texts' begin."""
        raw, offsets = buffer(texts)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        begin = cuts(raw, offsets)
        ends = np.append(begin, len(raw))
        size = np.diff(ends)
        if self._n > REMEMBERED:
            self._forget()
        low, high = self._short.keys(raw, begin, np.minimum(size, SHORT))
        place = self._short.find(low, high)
        long = np.flatnonzero(size > SHORT)
        place[long] = 0
        if len(missed := np.flatnonzero(place < 0)):
            order = missed[np.lexsort((low[missed], high[missed]))]
            new = np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))
            n, one, whole = self._n, order[new], memoryview(raw)
            self._learn([str(whole[a:b], "utf-8") for a, b in zip(begin[one].tolist(), ends[one + 1].tolist(), strict=True)])
            self._short.add(low[one], high[one], n)
            place[order] = n + np.cumsum(new) - 1
        if len(long):
            chunks = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(raw)).take(pa.array(long)).dictionary_encode()
            known = chunks.dictionary.to_pylist()
            found = np.fromiter(map(self._long.get, known, repeat(-1)), np.int64, len(known))
            if len(gaps := np.flatnonzero(found < 0)):
                new, n = [known[i] for i in gaps], self._n
                self._learn(new)
                self._long.update(zip(new, range(n, n + len(new)), strict=True))
                found[gaps] = np.arange(n, n + len(gaps))
            place[long] = found[chunks.indices.to_numpy()]
        return place, np.searchsorted(begin, offsets)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        at, first = self._places(texts)
        total = np.concatenate([[0], np.cumsum(self._first[at + 1] - self._first[at])])
        return total[first[1:]] - total[first[:-1]]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 places where the texts begin.

        end_id, if given, follows the ids of every text. A null is an empty text.
        """
        at, first = self._places(texts)
        lengths = self._first[at + 1] - self._first[at]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self._flat[np.repeat(self._first[at] - total[:-1], lengths) + np.arange(total[-1])]
        begin = total[first]
        if end_id is None:
            return ids, begin
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        text = np.repeat(np.arange(len(texts)), np.diff(begin))
        out[np.arange(len(ids)) + text] = ids
        return out, begin + np.arange(len(texts) + 1)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: pa.Array, most: int = 4_000_000):
    """Runs of the texts of so many bytes at most (or one longer text), as (first, last + 1)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end
