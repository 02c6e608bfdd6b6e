"""Vectorised text kernels over Arrow string columns: words and 64-bit hashes without a loop per word.

A word is a run of UTF-8 bytes other than the ASCII blanks 0x20 and 0x09 to 0x0D. Hashes of byte ranges
are differences of one running sum over the buffer, so a word, a line or an n-gram costs the same.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_byte_code = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


_libc = ctypes.CDLL(None)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which then gives freed memory back to the system: workers wait for other tasks and would hold it meanwhile."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Exponents whose powers a worker keeps; those of larger buffers are computed each time, so a long text leaves no tables behind.
KEPT_POWERS = 1 << 22


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for the exponents 0 to n at least."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    made = []
    for b in (_BASE, _INV):
        steps = np.full(min(2 * n, KEPT_POWERS) if n < KEPT_POWERS else n + 1, b, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps, out=steps))
    if n < KEPT_POWERS:
        _powers[:] = made
    return made[0], made[1]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and the n + 1 offsets into them; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z, and nothing else, in lower case."""
    return _lower[raw]


def row_slices(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have so many bytes at most; a longer text is alone."""
    _, offsets = buffer(batch.column(text))
    a = 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1)
        yield batch.slice(a, z - a)
        a = z


class RangeHash:
    """Hashes of ranges of a sequence of 64-bit codes; equal ranges have equal hashes wherever they stand."""

    def __init__(self, codes: np.ndarray):
        up, self._down = _tables(len(codes))
        self._sum = np.empty(len(codes) + 1, np.uint64)
        self._sum[0] = 0
        np.cumsum(codes * up[: len(codes)], out=self._sum[1:])

    @classmethod
    def of_bytes(cls, raw: np.ndarray) -> RangeHash:
        return cls(_byte_code[raw])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """start, end: byte ranges of the words of all texts; first: n + 1 word numbers at which texts begin."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> Words:
    """Words of all texts; inside marks the bytes that belong to words, where these are not just what stands between blanks."""
    if inside is None:
        inside = ~_blank[raw]
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    begins = inside & ~before
    begins[heads] = inside[heads]
    after = np.empty(len(raw), bool)
    after[-1:] = True
    after[:-1] = ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(inside & after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def shingles(codes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words of every text, and where each text's begin (n + 1 numbers).

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(counts)), made)
    at = np.arange(out_first[-1]) - out_first[text] + first[text]
    have = np.minimum(counts[text], width)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        ok = have > k
        out[ok] = mix(out[ok] * _U(0xD6E8FEB86659FD93) + codes[at[ok] + k] + _U(k + 1))
    return out, out_first


def distinct_counts(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Within each text, its distinct values in ascending order and how often each occurs; new firsts."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return v[at], np.diff(np.append(at, len(v))), np.searchsorted(t[at], np.arange(len(first)))
