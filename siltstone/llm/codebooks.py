"""Vector codes by Lloyd's method with heaps: codebooks for 16 parts of integer vectors, exact to the last digit.

Vectors are cut into 16 equal parts; each part position has a codebook. A round assigns every part to its nearest entry and
moves every entry to the floor of its parts' mean. Between rounds the parts lie in blocks, a Parquet row of a bounded number
of vectors of one partition each, with heaps: one for each part position and entry, keyed by the slack between the lower bound of
the distance to any other entry and the upper bound of the distance to its own, plus the drift at the time it was put there. An entry's
drift grows each round by its own move and the largest move of the others, so a heap's bounds are all updated by one
number; only parts whose slack the drift has used up are popped and compared with all entries again, in whole numbers. All
others provably keep their entry. Sums and counts are kept by block and change only by what moved.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.kernels import frugal
from siltstone.llm.storage import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and what can be a component: beyond it squares would leave 64 bits.
BLOCK, LARGEST = 4096, 1 << 26
#: Bounds are doubles: slack counts as used up so much before it is.
_MARGIN = 1e-6


def finite(vector: Column) -> Column:
    """Is a vector there, without null, NaN and infinite components?"""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, good), F.lit(False))


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of the components; beyond 2 ** 26 they are held at that."""
    one = lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), scale * x.cast("double"))))
    return F.transform(vector, one)


@dataclass(frozen=True)
class Codebooks:
    """entries: (parts, entries, width) whole numbers."""

    entries: np.ndarray
    scale: int = SCALE

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for, in the middle of its components' steps."""
        at = np.frombuffer(bytes.fromhex(code), np.uint8)
        return ((self.entries[np.arange(len(at)), at] + 0.5) / self.scale).ravel()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (n, entries) of one part position, in whole numbers."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - entries[None, :, k]
        out += d * d
    return out


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lowest of equals, and how much farther the next one is."""
    d = distances(x, entries)
    at = d.argmin(1)
    rows = np.arange(len(x))
    least = np.sqrt(d[rows, at])
    if len(entries) == 1:
        return at, np.full(len(x), np.inf)
    d[rows, at] = np.iinfo(np.int64).max
    return at, np.sqrt(d.min(1)) - least


class Block:
    """Vectors with, by part position and entry, heaps of (slack + drift, row), sums and counts."""

    def __init__(self, x: np.ndarray, entries: int):
        n, parts, width = x.shape
        self.x, self.assigned = x, np.zeros((n, parts), np.int64)
        self.heaps: list[list[list[tuple[float, int]]]] = [[[] for _ in range(entries)] for _ in range(parts)]
        self.sums, self.counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)

    def assign(self, entries: np.ndarray, drift: np.ndarray) -> int:
        """Make all assignments right; how many parts were compared with the entries."""
        scanned = 0
        for p, heaps in enumerate(self.heaps):
            first = not any(heaps)
            popped = list(range(len(self.x))) if first else []
            for e, heap in enumerate(heaps):
                while heap and heap[0][0] <= drift[p, e] + _MARGIN:
                    popped.append(heapq.heappop(heap)[1])
            if not popped:
                continue
            scanned += len(popped)
            rows = np.array(popped)
            at, slack = _nearest(self.x[rows, p], entries[p])
            old = self.assigned[rows, p]
            moved = np.ones(len(rows), bool) if first else at != old
            for sign, where in ((1, at), (-1, old)) if not first else ((1, at),):
                np.add.at(self.sums[p], where[moved], sign * self.x[rows[moved], p])
                np.add.at(self.counts[p], where[moved], sign)
            self.assigned[rows, p] = at
            keys = slack + drift[p, at]
            for key, row, e in zip(keys.tolist(), popped, at.tolist(), strict=True):
                heapq.heappush(heaps[e], (key, row))
        return scanned

    def pack(self) -> dict[str, object]:
        """Vectors as narrow as they go, heaps in their own order: read again they are heaps as they stand. Keys are rounded down."""
        flat = [item for heaps in self.heaps for heap in heaps for item in heap]
        keys = np.nextafter(np.array([k for k, _ in flat], np.float32), np.float32(-np.inf))
        kind = np.int16 if np.abs(self.x).max(initial=0) < 1 << 15 else np.int32
        return {
            "n": len(self.x),
            "vectors": self.x.astype(kind).tobytes(),
            "sizes": np.array([len(heap) for heaps in self.heaps for heap in heaps], np.uint16).tobytes(),
            "keys": keys.tobytes(),
            "places": np.array([r for _, r in flat], np.uint16).tobytes(),
            "sums": np.concatenate([self.sums, self.counts[:, :, None]], axis=2).tobytes(),
        }

    @classmethod
    def unpack(cls, row: dict, shape: tuple[int, int, int]) -> Block:
        parts, entries, width = shape
        kind = np.int16 if len(row["vectors"]) == 2 * row["n"] * parts * width else np.int32
        self = cls(np.frombuffer(row["vectors"], kind).reshape(-1, parts, width).astype(np.int64), entries)
        both = np.frombuffer(row["sums"], np.int64).reshape(parts, entries, width + 1)
        self.sums, self.counts = both[:, :, :-1].copy(), both[:, :, -1].copy()
        items = list(zip(np.frombuffer(row["keys"], np.float32).tolist(), np.frombuffer(row["places"], np.uint16).tolist(), strict=True))
        ends = np.cumsum(np.frombuffer(row["sizes"], np.uint16), dtype=np.int64).tolist()
        flat = [items[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
        self.heaps = [flat[p * entries : (p + 1) * entries] for p in range(parts)]
        for p, heaps in enumerate(self.heaps):
            for e, heap in enumerate(heaps):
                self.assigned[[r for _, r in heap], p] = e
        return self


_PACKED = pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in ("vectors", "sizes", "keys", "places", "sums")), ("scanned", pa.int64())])


def _first_round(kept: DataFrame, books: np.ndarray, block: int) -> DataFrame:
    """kept (row, vector) in blocks with everything assigned: the rows of each in a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                made = Block(x.reshape(part.num_rows, len(books), -1), books.shape[1])
                scanned = made.assign(books, np.zeros(books.shape[:2]))
                state = pa.RecordBatch.from_pylist([made.pack() | {"scanned": scanned}], _PACKED)
                rows = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("row"))
                yield pa.RecordBatch.from_arrays([rows, *state.columns], names=["rows", *_PACKED.names])

    empty = {c: F.lit(b"") for c in _PACKED.names} | {c: F.lit(0).cast("long") for c in ("n", "scanned")}
    schema = kept.select(F.array("row").alias("rows"), *(empty[c].alias(c) for c in _PACKED.names)).schema
    return kept.select("row", "vector").mapInArrow(frugal(run), schema)


def _next_round(state: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                made = Block.unpack(part.select(_PACKED.names).to_pylist()[0], books.shape)
                scanned = made.assign(books, drift)
                packed = pa.RecordBatch.from_pylist([made.pack() | {"scanned": scanned}], _PACKED)
                yield pa.RecordBatch.from_arrays([part.column("rows"), *packed.columns], names=["rows", *_PACKED.names])

    return state.mapInArrow(frugal(run), state.schema)


def _codes(state: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """row, code, error of all rows, once their parts are assigned to the last books."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                made = Block.unpack(part.select(_PACKED.names).to_pylist()[0], books.shape)
                made.assign(books, drift)
                error = ((made.x - books[np.arange(len(books)), made.assigned]) ** 2).sum((1, 2))
                code = pa.array([r.tobytes().hex() for r in made.assigned.astype(np.uint8)])
                yield pa.RecordBatch.from_arrays([part.column("rows").flatten(), code, pa.array(error)], names=["row", "code", "error"])

    schema = state.select(F.col("rows")[0].alias("row"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    return state.mapInArrow(frugal(run), schema)


def _totals(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sums and counts over all blocks: added up in each task, then over the tasks. A bounded table whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(np.prod(shape)), np.int64)
        for batch in batches:
            for raw in batch.column("sums"):
                total += np.frombuffer(raw.as_py(), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in state.select("sums").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(shape)


def moved(books: np.ndarray, totals: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries at the floor of their parts' means (unused ones stay), and the drift after that move."""
    sums, counts = totals[:, :, :-1], totals[:, :, -1:]
    new = np.where(counts > 0, sums // np.maximum(counts, 1), books)
    step = np.sqrt(((new - books) ** 2).sum(2))
    order = np.sort(step, axis=1)
    highest = order[:, -1:]
    second = order[:, -2:-1] if step.shape[1] > 1 else np.zeros_like(highest)
    # The largest move of the others: the second largest for the entry that moved most.
    at = step.argmax(1)[:, None] == np.arange(step.shape[1])
    return new, drift + step + np.where(at, second, highest)


@dataclass(frozen=True)
class Trained:
    """The codebooks, the blocks of the last round before them, the drift since, and how many parts each round compared."""

    books: Codebooks
    state: DataFrame
    drift: np.ndarray
    scanned: list[int]


def trained(vectors: DataFrame, key: str, vector: str, keep: list[str], entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK, scale: int = SCALE) -> Trained | None:
    """Codebooks that begin as the parts of the vectors of the lowest keys, after so many rounds (one at least).

    None without a vector that counts; see coded for what does.
    """
    if not 0 < block < 1 << 16 or not 0 < entries <= 256 or rounds < 1:
        raise ValueError(f"block {block}, entries {entries}, rounds {rounds}")
    whole = vectors.where(finite(F.col(vector))).select(F.col(key).alias("key"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), whole_numbers(F.col(vector), scale).alias("vector"))
    usable = whole.where(F.size("vector") > 0)
    start = [r["vector"] for r in usable.select("key", "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()]
    if not start:
        return None
    size = len(start[0])
    if size % PARTS:
        raise ValueError(f"vectors of {size} components do not have {PARTS} equal parts")
    usable = usable.where(F.size("vector") == size)
    if any(len(v) != size for v in start):
        start = [r["vector"] for r in usable.select("key", "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()]
    books = np.array(start, np.int64).reshape(len(start), PARTS, -1).transpose(1, 0, 2)
    drift, scanned = np.zeros(books.shape[:2]), []
    for k in range(rounds):
        state = written(_next_round(state, books, drift) if k else _first_round(usable, books, block), "heaps")
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        books, drift = moved(books, _totals(state, (*books.shape[:2], books.shape[2] + 1)), drift)
    return Trained(Codebooks(books, scale), state, drift, scanned)


def coded(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **how: int) -> DataFrame:
    """key, label, code, error, label_error, codebooks_sha256 of all rows whose vector counts.

    A vector that is null or empty or holds null or a component that is not finite is left out, and so is one that is not as
    long as that of the lowest key; components beyond 2 ** 26 steps are held at that. Equal distances go to the lower
    entry. Rows of the lowest keys, a null key last, ties by their vectors, begin the codebooks; with fewer rows than entries there
    are fewer entries. Rows that stand twice are two rows. label_error sums the error over equal labels, nulls together.
    An empty table gives no rows; other columns are left aside.
    """
    keep = [key, label]
    made = trained(vectors, key, vector, keep, **how)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in keep}
    if made is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, code string, error long, label_error long, codebooks_sha256 string")
    codes = written(_codes(made.state, made.books.entries, made.drift).select("row.*", "code", "error"), "codes")
    # Written first, so that a label with most rows can be split where the sums are joined.
    sums = written(codes.groupBy(F.col(f"`{label}`").alias("_l")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = codes.join(sums, F.col(f"`{label}`").eqNullSafe(F.col("_l")))
    return joined.select(f"`{key}`", f"`{label}`", "code", "error", "label_error", F.lit(made.books.sha256()).alias("codebooks_sha256"))
