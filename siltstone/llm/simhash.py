"""Near duplicates by SimHash fingerprints and a search by the generalised pigeonhole principle.

A fingerprint's bit is 1 if it is set in over half the 64-bit hashes of the text's runs of words, repeats included.
Fingerprints that differ in `radius` bits at most are linked; a document's component is named by its smallest doc_id.

Equal fingerprints are one node. The 64 bits are dealt into m parts so that bits which correlate over all fingerprints lie
together: what is skewed is then skewed in few parts. If a fingerprint gives its parts thresholds t_1 to t_m (-1: the part is
not looked at) whose sum is radius - m + 1, whatever lies within the radius differs in some part i in t_i bits at most. Each
fingerprint has thresholds of its own, those of least cost by dynamic programming over the parts: what a probe costs and how
many candidates it is to meet, estimated from counts of part values over all fingerprints. It probes all values of a part
within the part's threshold; who meets in a bucket (a part and its value) is verified on the whole fingerprint.

Small buckets give all their links, so a node has some SMALL in one at most. Larger ones give a spanning forest: a
fingerprint is compared only with those it is not yet connected to. The counts also bound every bucket from above, so the
buckets that can exceed BLOCK are dealt to blocks from the start, and probes go to each block: no pair is left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.kernels import buffer, frugal, lowered, mix, row_slices, words
from siltstone.llm.storage import written
from siltstone.operators.graph import components

SHINGLE, RADIUS, SEED = 4, 4, 42
BITS = 64
#: Buckets of so many rows give all their links; larger ones a spanning forest.
SMALL = 64
#: Fingerprints of a bucket that are searched at once.
BLOCK = 65_536
#: Bits of a part's value whose values are counted: m * 4096 numbers in all.
COUNTED = 12
#: A probe costs as much as so many candidates: it is a row that is shuffled and sorted.
PROBE = 16.0
_HASHES_AT_ONCE, _ROWS_AT_ONCE, _PAIRS_AT_ONCE = 1 << 16, 1 << 18, 1 << 21


# Fingerprints


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with the words of all texts joined by one space, and the number of the text, begin and end there of every run of words."""
    w = words(raw, offsets)
    size = w.end - w.start
    begin = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    number = np.repeat(np.arange(len(size)), size)
    joined[np.arange(len(number)) + number] = raw[np.arange(len(number)) + (w.start - (np.cumsum(size) - size))[number]]
    count = np.diff(w.first)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), made)
    at = np.arange(len(text)) - (np.cumsum(made) - made)[text] + w.first[text]
    last = at + np.minimum(count, width)[text] - 1
    return joined, text, np.stack([begin[at], begin[last] + size[last]])


def fingerprints(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """The unsigned 64-bit fingerprint of every text; 0 for a text without words."""
    import xxhash

    raw, offsets = buffer(texts)
    joined, text, (begin, end) = shingle_hashes(lowered(raw), offsets, width)
    data, digest = memoryview(joined), xxhash.xxh64_intdigest
    ones, total = np.zeros((len(texts), BITS), np.int64), np.bincount(text, minlength=len(texts))
    for a in range(0, len(text), _HASHES_AT_ONCE):
        z = min(a + _HASHES_AT_ONCE, len(text))
        h = np.fromiter((digest(data[x:y], SEED) for x, y in zip(begin[a:z].tolist(), end[a:z].tolist(), strict=True)), np.uint64, z - a)
        heads = np.flatnonzero(np.append(True, text[a + 1 : z] != text[a : z - 1]))
        ones[text[a:z][heads]] += np.add.reduceat(_bits(h), heads, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _bits(prints: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1, the lowest bit first."""
    return np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprinted(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """docs without text, with fp: the fingerprint as a signed number."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                fp = fingerprints(part.column("text"), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(fp)], names=[*names, "fp"])

    return docs.mapInArrow(frugal(run), docs.select(names).withColumn("fp", F.lit(0).cast("long")).schema)


# The plan of a search


def thresholds(cost: np.ndarray, total: int) -> np.ndarray:
    """Of each query the thresholds, from -1, of least cost, where threshold + 1 sum up to `total`. cost: (parts, total + 1, queries)."""
    parts, _, n = cost.shape
    best, chosen = cost[0].copy(), []
    for part in cost[1:]:
        new, pick = np.full((total + 1, n), np.inf), np.zeros((total + 1, n), np.int8)
        for spent in range(total + 1):
            for own in range(spent + 1):
                c = best[spent - own] + part[own]
                less = c < new[spent]
                new[spent][less], pick[spent][less] = c[less], own
        best = new
        chosen.append(pick)
    out, left, each = np.zeros((parts, n), np.int8), np.full(n, total), np.arange(n)
    for k in range(parts - 1, 0, -1):
        out[k] = chosen[k - 1][left, each]
        left = left - out[k]
    out[0] = left
    return out - 1


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def number_of_parts(n: int, radius: int) -> int:
    """The number of parts with which n evenly spread fingerprints cost least."""

    def cost(m: int) -> float:
        own = [[0.0, *(_ball(w, t) * (PROBE + n / 2**w) for t in range(radius + 1))] for w in _widths(m)]
        table = np.array(own)[:, :, None]
        return float(sum(table[k, t + 1, 0] for k, t in enumerate(thresholds(table, radius + 1)[:, 0])))

    return min(range(1, radius + 2), key=cost)


def _widths(m: int) -> list[int]:
    return [BITS // m + (k < BITS % m) for k in range(m)]


def correlated_parts(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits of m parts: each begins with the bit that correlates most with those that are left, and takes the nearest ones.

    together: how many of n fingerprints have both bits set.
    """
    share = together / max(1, n)
    p = np.diag(share)
    spread = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.abs(np.nan_to_num((share - np.outer(p, p)) / np.outer(spread, spread), posinf=0, neginf=0))
    left, out = list(range(BITS)), []
    for width in _widths(m):
        part = [max(left, key=lambda b: (near[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: (near[b, part].sum(), -b)))
            left.remove(part[-1])
        out.append(sorted(part))
    return out


def part_value(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(prints), np.uint64)
    for k, b in enumerate(bits):
        out |= (prints >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def _masks(width: int, flips: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), flips)], np.uint64)


class Plan:
    """Parts, what thresholds cost by the counted bits of a part's value, and into how many blocks a bucket is dealt."""

    def __init__(self, parts: list[list[int]], counts: np.ndarray, radius: int, block: int):
        self.parts, self.radius = parts, radius
        self.blocks = np.maximum(1, -(-counts // block)).astype(np.int64)
        slots = np.arange(1 << COUNTED, dtype=np.uint64)
        self.cost = np.zeros((len(parts), radius + 2, 1 << COUNTED))
        for k, bits in enumerate(parts):
            known = min(COUNTED, len(bits))
            rest = len(bits) - known
            # Fingerprints in slots that differ in just so many of the counted bits.
            at = [counts[k][(slots[:, None] ^ _masks(known, flips)).astype(np.int64)].sum(1) if flips <= known else 0 * counts[k] for flips in range(radius + 1)]
            for t in range(radius + 1):
                met = sum(at[flips] * (_ball(rest, t - flips) / 2**rest) for flips in range(t + 1))
                self.cost[k, t + 1] = PROBE * _ball(len(bits), t) + met

    def rows(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """bucket, block, kind, fingerprint: where each lies (kind 0, or 1 if it asks there too) and where else it asks (kind 2)."""
        values = np.stack([part_value(prints, bits) for bits in self.parts])
        slots = (values & np.uint64((1 << COUNTED) - 1)).astype(np.int64)
        chosen = thresholds(np.stack([c[:, s] for c, s in zip(self.cost, slots, strict=True)]), self.radius + 1)
        place = mix(prints)
        for k, bits in enumerate(self.parts):
            name = np.uint64(k << 58)
            many = self.blocks[k][slots[k]]
            own = (place % many.astype(np.uint64)).astype(np.int64)
            yield values[k] | name, own, (chosen[k] >= 0).astype(np.int8), prints
            for flips in range(min(self.radius, len(bits)) + 1):
                asks = np.flatnonzero(chosen[k] >= flips)
                masks = _masks(len(bits), flips)
                step = max(1, _ROWS_AT_ONCE // len(masks))
                for a in range(0, len(asks), step):
                    who = np.repeat(asks[a : a + step], len(masks))
                    value = (values[k][asks[a : a + step]][:, None] ^ masks).ravel()
                    many = self.blocks[k][(value & np.uint64((1 << COUNTED) - 1)).astype(np.int64)]
                    row = np.repeat(np.arange(len(who)), many)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    if not flips:  # where it lies it asks already
                        other = block != own[who[row]]
                        row, block = row[other], block[other]
                    yield value[row] | name, block, np.full(len(row), 2, np.int8), prints[who[row]]


def _counted(prints: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all fingerprints of `size` numbers that of(prints) gives for some: added up in each task, then over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += of(np.asarray(batch.column("fp")).view(np.uint64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    out = np.zeros(size, np.int64)
    for r in prints.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def plan(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK, parts: int | None = None) -> Plan:
    """The plan for distinct fingerprints (fp), from counts over all of them: 64 * 64 pairs of bits, then 4096 values a part."""

    def pairs(fp: np.ndarray) -> np.ndarray:
        bits = _bits(fp).astype(np.float64)
        return (bits.T @ bits).astype(np.int64).ravel()

    n = prints.count()
    bits = correlated_parts(_counted(prints, BITS * BITS, pairs).reshape(BITS, BITS), n, parts or number_of_parts(n, radius))

    def values(fp: np.ndarray) -> np.ndarray:
        at = [(part_value(fp, b) & np.uint64((1 << COUNTED) - 1)).astype(np.int64) for b in bits]
        return np.concatenate([np.bincount(x, minlength=1 << COUNTED) for x in at])

    return Plan(bits, _counted(prints, len(bits) << COUNTED, values).reshape(len(bits), -1), radius, block)


# The search


def small_links(fp: np.ndarray, kind: np.ndarray, first: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links in groups of rows that begin at first (and end where the last number says)."""
    end = np.repeat(first[1:], np.diff(first))
    follow = end - np.arange(first[0], first[-1]) - 1
    upto = np.cumsum(follow)
    a = 0
    while a < len(follow):
        done = upto[a - 1] if a else 0
        z = max(a + 1, int(np.searchsorted(upto, done + _PAIRS_AT_ONCE, "right")))
        i = np.repeat(np.arange(a, z), follow[a:z])
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[a:z] - follow[a:z] - done, follow[a:z])
        i, j = i + first[0], j + first[0]
        close = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        i, j = i[close], j[close]
        # One lies there and the other asks; a fingerprint that asks in several blocks can meet itself nowhere.
        met = (kind[i] != 2) & (kind[j] > 0) | (kind[j] != 2) & (kind[i] > 0)
        yield fp[i[met]], fp[j[met]]
        a = z


class Forest:
    """The links of one large bucket, as a spanning forest: rows that lie there first, then those that only ask."""

    def __init__(self, fp: np.ndarray, kind: np.ndarray, radius: int):
        self.fp, self.radius, self.label = fp, radius, np.arange(len(fp))
        self.links: list[tuple[int, int]] = []
        for i in np.flatnonzero(kind == 1).tolist():
            other = np.flatnonzero(self.label != self.label[i])
            self._join(int(fp[i]), other[np.bitwise_count(fp[other] ^ fp[i]) <= radius], i)

    def ask(self, fp: np.ndarray) -> None:
        for x in fp:
            self._join(int(x), np.flatnonzero(np.bitwise_count(self.fp ^ x) <= self.radius), None)

    def _join(self, asked: int, near: np.ndarray, own: int | None) -> None:
        if not len(near):
            return
        labels, at = np.unique(self.label[near], return_index=True)
        self.links += [(asked, int(self.fp[near[k]])) for k in at.tolist()]
        if own is not None or len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0] if own is None else self.label[own]


def links(prints: DataFrame, how: Plan, small: int = SMALL) -> DataFrame:
    """u, v: links between distinct fingerprints (fp) that leave the components as all links do."""
    radius = how.radius
    names = ["bucket", "block", "kind", "fp"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            for a in range(0, len(fp), 1 << 16):
                for bucket, block, kind, who in how.rows(fp[a : a + (1 << 16)]):
                    if len(who):
                        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(block), pa.array(kind), pa.array(who.view(np.int64))], names=names)

    def found(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for u, v in parts:
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in (u, v)], names=["u", "v"])

    def grown(fp: np.ndarray, kind: np.ndarray) -> Forest:
        lies = int(np.searchsorted(kind == 2, True))
        tree = Forest(fp[:lies], kind[:lies], radius)
        tree.ask(fp[lies:])
        return tree

    def ended(group: tuple[np.ndarray, np.ndarray] | Forest | None) -> Iterator[pa.RecordBatch]:
        """The links of a group of which no more rows come."""
        if isinstance(group, tuple):
            fp, kind = group
            if len(fp) <= small:
                yield from found(small_links(fp, kind, np.array([0, len(fp)]), radius))
                return
            group = grown(fp, kind)
        if group is not None and group.links:
            yield from found([tuple(zip(*group.links, strict=True))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last group of a batch can go on in the next one.
        open_, key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, block, kind = (np.asarray(batch.column(c)) for c in names[:3])
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            new = np.append(True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]))
            first = np.append(np.flatnonzero(new), len(fp))
            if key == (bucket[0], block[0]):
                z = first[1]
                if isinstance(open_, Forest):
                    open_.ask(fp[:z])
                else:
                    open_ = np.concatenate([open_[0], fp[:z]]), np.concatenate([open_[1], kind[:z]])
                    # What only asks comes last in a group: of a large one it need not be held.
                    if len(open_[0]) > small and open_[1][-1] == 2:
                        open_ = grown(*open_)
                first = first[1:]
                if len(first) == 1:
                    continue
            yield from ended(open_)
            size = np.diff(first[:-1])
            for a, z in _runs(size <= small):
                yield from found(small_links(fp, kind, first[a : z + 1], radius))
            for k in np.flatnonzero(size > small).tolist():
                yield from ended((fp[first[k] : first[k + 1]], kind[first[k] : first[k + 1]]))
            open_, key = (fp[first[-2] :].copy(), kind[first[-2] :].copy()), (bucket[-1], block[-1])
        yield from ended(open_)

    n = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = prints.select("fp").mapInArrow(frugal(spread), "bucket long, block long, kind byte, fp long")
    dealt = dealt.repartition(n, "bucket", "block").sortWithinPartitions("bucket", "block", "kind", "fp")
    return dealt.mapInArrow(frugal(search), "u long, v long").distinct()


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of true begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def simhash_components(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, block: int = BLOCK, small: int = SMALL, parts: int | None = None) -> DataFrame:
    """docs (doc_id, other columns) without text, with fingerprint (16 hexadecimal digits) and component_id.

    component_id is the smallest doc_id that links lead to, the document's own included. A text is lower-cased in A-Z and cut
    at ASCII blanks; one of fewer words than `width` is one run, one without words, an empty and a null one have the fingerprint
    0, which links like any other. Texts of any length are read whole. A null doc_id is no name: a component of null
    ids alone has a null component_id. Rows that stand twice come out twice. An empty table gives no rows. Columns
    that are named as those two, or fp, are left out.
    """
    names = [c for c in docs.columns if c not in ("text", "fingerprint", "component_id", "fp")]
    rows = written(fingerprinted(docs.select(*(F.col(f"`{c}`") for c in names), "text"), width), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    found = written(links(prints, plan(prints, radius, block, parts), small), "links")
    labels = components(found).select(F.col("node").alias("fp"), "label")
    named = written(prints.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "named")
    # A component is named once, in a table of its own, so that the joins with hot sides can be split.
    least = written(named.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    ids = written(named.join(least, "label").select("fp", "component_id"), "ids")
    return rows.join(ids, "fp").select(*(F.col(f"`{c}`") for c in names), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
