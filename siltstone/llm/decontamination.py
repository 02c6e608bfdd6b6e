"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact check of shingles.

A SimHash fingerprint of a run of words has 64 bits, the signs of the summed bits of its word pairs' hashes. Texts
are windowed at a ladder of lengths; every item has the fingerprints of its first and of its last words at the
longest step of the ladder that it holds, so a passage of the item meets a window of the same words. Windows start
at every `stride` words, a fraction of their length.

A multi-index finds all fingerprints within `RADIUS` bits: the 64 bits are four blocks of 16, and two fingerprints
that differ in RADIUS bits at most differ in a quarter of it at most in one block (pigeonhole). For each block and each
of its 65536 values there is the list of the items' fingerprints whose block is that close to the value, so a window
meets only the fingerprints of its four lists. A pair within the radius is then checked exactly: the weighted shingles
(runs of five words with their counts) of the item against those of the item-sized runs of words around the window, at
every offset.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.kernels import RangeHash, buffer, frugal, mix, shingles, words
from siltstone.llm.storage import set_aside, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
#: Steps of the ladder of window lengths: each at most so much longer than the one before.
LADDER = 4 / 3
#: A window starts every 1/STRIDES of its length.
STRIDES = 8
#: Items that are searched at once, which bounds what a worker holds (some 11 KB a fingerprint, of which an item has one
#: or two). More items are searched in further passes over the texts.
ITEMS_A_PASS = 8192
#: Bytes of the items of a pass, unless one item alone has more: they and what is made of them reach the driver and every worker.
BYTES_A_PASS = 16 << 20
#: Pairs of windows and fingerprints that are compared at once.
_PAIRS_AT_ONCE = 1 << 20
#: Words of texts that are fingerprinted at once: their running sums stay in a core's own cache.
_WORDS_AT_ONCE = 8192


def _bits(codes: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1."""
    return np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1)


def pair_codes(codes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; the last word stands alone."""
    follow = np.append(codes[1:], np.uint64(0))
    return mix(codes * np.uint64(0xD6E8FEB86659FD93) + follow)


def running(pairs: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of the 64 bits of the hashes, for differences over runs of `longest` pairs at most.

    Up to 255 pairs eight sums share a 64-bit number, a byte each: sums overflow into the next byte, but the difference of two
    such numbers is that of the run alone, whose sums fit.
    """
    bits = _bits(pairs)
    kind = np.uint64 if longest <= 255 else np.int32
    values = bits.view(np.uint64) if kind is np.uint64 else bits
    out = np.zeros((len(pairs) + 1, values.shape[1]), kind)
    np.cumsum(values, axis=0, dtype=kind, out=out[1:])
    return out


def fingerprints(codes: np.ndarray, sums: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the runs of `length` words at start: of their length - 1 pairs, or of a single word."""
    if length == 1:
        return mix(codes[start])
    n = length - 1
    ones = sums[start + n] - sums[start]
    if sums.dtype == np.uint64:
        ones = ones.view(np.uint8)
    return np.packbits(ones > n // 2, axis=1).view(np.uint64).ravel()


def _blocks(prints: np.ndarray) -> np.ndarray:
    return prints.view(np.uint16).reshape(-1, BLOCKS)


class MultiIndex:
    """Fingerprints by the values of their blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        near = [sum(1 << b for b in bits) for k in range(radius // BLOCKS + 1) for bits in itertools.combinations(range(BLOCK_BITS), k)]
        masks = np.array(near, np.uint16)
        number = np.arange(len(prints), dtype=np.uint16 if len(prints) < 1 << 16 else np.int32)
        #: Where the list of each block and value begins, and the fingerprints of all lists.
        sizes, lists = [], []
        for block in _blocks(prints).T:
            values = (block[:, None] ^ masks).ravel()
            sizes.append(np.bincount(values, minlength=1 << BLOCK_BITS))
            lists.append(np.repeat(number, len(masks))[np.argsort(values, kind="stable")])
        self.first, self.numbers = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(lists)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs within the radius: numbers of prints, and of the index's fingerprints, ordered by these."""
        at = (_blocks(prints) + np.arange(0, BLOCKS << BLOCK_BITS, 1 << BLOCK_BITS)).ravel()
        low = self.first[at]
        count = self.first[at + 1] - low
        upto = np.cumsum(count)
        a, found = 0, []
        while a < len(at):
            done = upto[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(upto, done + _PAIRS_AT_ONCE, "right")))
            part = count[a:z]
            left = np.repeat(np.arange(a, z) // BLOCKS, part)
            right = self.numbers[np.arange(len(left)) + np.repeat(low[a:z] - (upto[a:z] - part - done), part)]
            close = np.flatnonzero(np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius)
            found.append(right[close].astype(np.int64) * len(prints) + left[close])
            a = z
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs % max(1, len(prints)), pairs // max(1, len(prints))


#: A worker's multi-indexes of the benchmark that it searched last.
_made: dict[tuple[str, int], MultiIndex] = {}


class Index:
    """Items and, by window length, their fingerprints; each worker makes the multi-indexes of these for itself."""

    def __init__(self, item_ids: list[int | None], texts: list[str | None], radius: int = RADIUS):
        self.radius, self.name = radius, uuid.uuid4().hex
        raw, offsets = buffer(pa.array(texts, pa.string()))
        w = words(raw, offsets)
        codes = RangeHash.of_bytes(raw)(w.start, w.end)
        sizes = np.diff(w.first)
        self.codes = [codes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.item_ids = item_ids
        self.shingles = [Counter(shingles(c, np.array([0, len(c)]), SHINGLE)[0].tolist()) for c in self.codes]
        ladder, step = [], int(sizes[sizes > 0].min()) if (sizes > 0).any() else 0
        while step and step <= sizes.max():
            ladder.append(step)
            step = max(step + 1, int(step * LADDER))
        # length -> fingerprints, their items, and where in its item each begins
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rungs: dict[int, list[tuple[int, int]]] = {}
        #: Words of every item, and all items' shingles in ascending order with their items.
        self.sizes = sizes
        for k, n in enumerate(sizes.tolist()):
            if n:
                length = max(x for x in ladder if x <= n)
                rungs.setdefault(length, []).extend((k, at) for at in sorted({0, n - length}))
        pairs = [(np.fromiter(c, np.uint64, len(c)), np.full(len(c), k, np.int32)) for k, c in enumerate(self.shingles)]
        values, owners = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        order = np.argsort(values, kind="stable")
        self.shingle_values, self.shingle_items = values[order], owners[order]
        for length, places in rungs.items():
            prints = np.concatenate([fingerprints(self.codes[k], running(pair_codes(self.codes[k]), length), np.array([at]), length) for k, at in places])
            self.by_length[length] = (prints, np.array([k for k, _ in places]), np.array([at for _, at in places]))

    def _multi(self, length: int) -> MultiIndex:
        if (self.name, length) not in _made:
            for other in [k for k in _made if k[0] != self.name]:
                del _made[other]
            _made[self.name, length] = MultiIndex(self.by_length[length][0], self.radius)
        return _made[self.name, length]

    def candidates(self, length: int, prints: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """(numbers of the windows within the radius, item, place in the item) of every fingerprint of this length."""
        _, items, places = self.by_length[length]
        windows, own = self._multi(length).search(prints)
        cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield windows[a:b], int(items[own[a]]), int(places[own[a]])

    def short(self, sizes: np.ndarray, runs: np.ndarray, run_first: np.ndarray, similarity: float) -> list[tuple[int, int]]:
        """(text, item) where the text has fewer words than the item and can be similar all the same: it may hold no window of the item.

        It shares a shingle with the item then, and has at least similarity times as many. sizes: words of the texts;
        runs and run_first: their shingles.
        """
        few = np.flatnonzero(np.repeat(sizes < self.sizes.max(initial=0), np.diff(run_first)))
        low, high = np.searchsorted(self.shingle_values, runs[few]), np.searchsorted(self.shingle_values, runs[few], "right")
        hits = np.flatnonzero(high > low)
        texts = np.searchsorted(run_first, few[hits], "right") - 1
        found: set[tuple[int, int]] = set()
        for h, t in zip(hits.tolist(), texts.tolist(), strict=True):
            n = int(sizes[t])
            for item in self.shingle_items[low[h] : high[h]].tolist():
                most = max(1, int(self.sizes[item]) - SHINGLE + 1)
                if n < self.sizes[item] and max(1, n - SHINGLE + 1) >= similarity * most - 1e-9:
                    found.add((t, item))
        return sorted(found)

    def similarity(self, item: int, runs: list[int]) -> float:
        """Weighted Jaccard of the shingles of an item and of a run of words."""
        a = self.shingles[item]
        left = dict(a)
        both = 0
        for r in runs:
            if left.get(r, 0):
                left[r] -= 1
                both += 1
        return both / (a.total() + len(runs) - both) if a and runs else 0.0

    def best(self, item: int, codes: np.ndarray, text_runs: np.ndarray, starts: list[int], similarity: float) -> tuple[float, int]:
        """The best similarity of the item and an item-sized run of words that begins at one of starts, and where; (0, 0) below `similarity`.

        codes and text_runs: the words of the text and its shingles.
        """
        n, known = len(self.codes[item]), self.shingles[item]
        if n < SHINGLE:
            whole = lambda s: shingles(codes[s : s + n], np.array([0, min(n, len(codes) - s)]), SHINGLE)[0].tolist()
            value, at = max((self.similarity(item, whole(s)), -s) for s in starts)
            return (value, -at) if value >= similarity else (0.0, 0)
        low, size = starts[0], max(1, min(n, len(codes)) - SHINGLE + 1)
        runs = text_runs[low : starts[-1] + size].tolist()
        # Shingles of the run that the item has at all bound what the two have in common.
        held = np.concatenate([[0], np.cumsum([r in known for r in runs])])
        begin = np.array(starts) - low
        common = held[begin + size] - held[begin]
        bound = common / np.maximum(1, known.total() + size - common)
        best = (0.0, 0)
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < max(best[0], similarity) - 1e-12:
                break
            value = self.similarity(item, runs[begin[k] : begin[k] + size])
            if value >= similarity and (value, -starts[k]) > (best[0], -best[1]):
                best = (value, starts[k])
        return best


def matches(column: pa.Array, index: Index, similarity: float = SIMILARITY) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, words) for every text and item that are similar somewhere in the text."""
    raw, offsets = buffer(column)
    w = words(raw, offsets)
    codes = RangeHash.of_bytes(raw)(w.start, w.end)
    runs, run_first = shingles(codes, w.first, SHINGLE)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    tried: dict[tuple[int, int], set[int]] = {}
    reach = max(index.by_length, default=0)
    n_words = len(codes)
    # Runs of words overlap by the longest window, and windows never cross the end of a text.
    for a in range(0, n_words, _WORDS_AT_ONCE):
        part = codes[a : a + _WORDS_AT_ONCE + reach]
        sums = running(pair_codes(part), reach)
        for length in index.by_length:
            stride = max(1, length // STRIDES)
            start = np.arange(0, min(_WORDS_AT_ONCE, n_words - a), stride)
            text = np.searchsorted(w.first, start + a, "right") - 1
            # A window that would cross the end of its text starts earlier; a text shorter than an item is checked apart, below.
            room = w.first[text + 1] - a - length
            start = np.where(start <= room, start, room)
            ok = start >= np.maximum(0, w.first[text] - a)
            start, text = start[ok], text[ok]
            if not len(start):
                continue
            for near, item, at in index.candidates(length, fingerprints(part, sums, start, length)):
                for t in np.unique(text[near]).tolist():
                    own = codes[w.first[t] : w.first[t + 1]]
                    last = max(0, len(own) - len(index.codes[item]))
                    begins = start[near[text[near] == t]] + a - int(w.first[t]) - at
                    # Runs begin within a stride of what the windows say; each is checked once.
                    around = np.unique(np.clip(begins[:, None] + np.arange(-stride, stride + 1), 0, last)).tolist()
                    seen = tried.setdefault((t, item), set())
                    if fresh := [x for x in around if x not in seen]:
                        seen.update(fresh)
                        value, where = index.best(item, own, runs[run_first[t] : run_first[t + 1]], fresh, similarity)
                        old = best.get((t, item), (0.0, 0))
                        if value >= similarity and (value, -where) > (old[0], -old[1]):
                            best[t, item] = (value, where)
    for t, item in index.short(np.diff(w.first), runs, run_first, similarity):
        value, where = index.best(item, codes[w.first[t] : w.first[t + 1]], runs[run_first[t] : run_first[t + 1]], [0], similarity)
        if value >= similarity:
            best[t, item] = (value, where)
    for (t, item), (value, where) in sorted(best.items()):
        yield t, item, value, where, min(len(index.codes[item]), int(w.first[t + 1] - w.first[t]))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, items_a_pass: int = ITEMS_A_PASS, bytes_a_pass: int = BYTES_A_PASS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: documents that hold a passage similar to a benchmark item.

    docs: doc_id, text. benchmark: item_id, text. Items without words match nothing; items of fewer words than a
    shingle are one shingle. Null texts hold nothing; rows that stand twice give two rows; either table can be empty.
    Items come to the driver in passes of items_a_pass and bytes_a_pass at most (one longer item is a pass), so what it and a
    task hold of them is bounded; where there are more, the result of each pass is written before the next.
    """
    fields = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]
    kinds = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    ids = part.column(0).to_pylist()
                    found = [(ids[t], index.item_ids[i], v, s, n) for t, i, v, s, n in matches(part.column(1), index, similarity)]
                    columns = list(zip(*found, strict=True)) if found else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

        return rows.mapInArrow(frugal(run), kinds)

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().orderBy("item_id", "text")
    done, ids, texts, held = [], [], [], 0
    for item_id, text in items.toLocalIterator():
        size = len((text or "").encode())
        if ids and (len(ids) == items_a_pass or held + size > bytes_a_pass):
            done.append(written(search(Index(ids, texts)), "hits"))
            ids, texts, held = [], [], 0
        ids.append(item_id)
        texts.append(text)
        held += size
    return functools.reduce(DataFrame.unionByName, done, search(Index(ids, texts)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no benchmark item. Rows that share a contaminated id and text go together."""
    held, restored = set_aside(docs)
    # The row's own key stands in for its id during the search.
    keyed = held.withColumn("_mark", F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text")))
    bad = contaminated(keyed.select(F.col("_mark").alias("doc_id"), "text"), benchmark, similarity).select(F.col("doc_id").alias("_mark")).distinct()
    return restored(keyed.join(bad, "_mark", "left_anti"))
