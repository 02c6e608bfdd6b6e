"""Best-fit packing of token pieces into sequences of fixed capacity.

Sizes are whole numbers up to the capacity, so a packing is decided on the histogram of sizes alone: at most
`capacity` counters reach the driver, whatever the number of documents. Pieces above one third of the capacity
are matched greedily, the largest first, each with the largest partner that fits; three of them exceed the
capacity, so a bin holds two at most. The smaller ones then best-fit the gaps, largest first. Equal bins are handled as one run of bins, so the plan has a bounded number of steps too.

The plan says which bins take the k-th piece of a size. Pieces are numbered within their size by counting in
salted groups, so a size that holds a third of all pieces is not ranked in one task.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.kernels import frugal
from siltstone.llm.storage import written
from siltstone.llm.tokens import encoder, slices

CAPACITY = 4096
#: Pieces of a group, on average: the pieces of one size are dealt to groups before they are numbered.
GROUP = 1_000


@dataclass
class Plan:
    """Segments, sorted by (size, rank): pieces of `size` ranked rank, rank + 1, ... lie in bins bin, bin + 1, ... at offset."""

    size: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    n_bins: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack so many pieces of each size; sizes are between 1 and capacity."""
    left = {s: n for s, n in histogram.items() if n}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("piece sizes must be between 1 and the capacity")
    used: dict[int, int] = dict.fromkeys(left, 0)
    segments: list[tuple[int, int, int, int]] = []
    n_bins = 0

    def place(size: int, count: int, first_bin: int, offset: int) -> None:
        segments.append((size, used[size], first_bin, offset))
        used[size] += count
        left[size] -= count
        if not left[size]:
            del left[size]
            live = large if 3 * size > capacity else small
            live.pop(bisect_right(live, size) - 1)

    large = sorted(s for s in left if 3 * s > capacity)
    small = sorted(s for s in left if 3 * s <= capacity)
    # Gaps: free space -> runs of equal bins (first bin, number of bins).
    gaps: dict[int, list[tuple[int, int]]] = {}
    while large:
        opener = large[-1]
        room = capacity - opener
        partners = [opener]
        at = bisect_right(large, room) - 1
        if at >= 0 and large[at] == opener and left[opener] == 1:
            at -= 1
        if at >= 0:
            partners.append(large[at])
            room -= large[at]
        bins = min(left[s] // partners.count(s) for s in set(partners))
        offset = 0
        for s in partners:
            place(s, bins, n_bins, offset)
            offset += s
        if room:
            gaps.setdefault(room, []).append((n_bins, bins))
        n_bins += bins
    spaces = sorted(gaps)
    heap = [-s for s in small]
    heapq.heapify(heap)
    while heap:
        size = -heapq.heappop(heap)
        while left.get(size):
            at = bisect_right(spaces, size - 1)
            if at == len(spaces):
                each = capacity // size
                bins = max(1, left[size] // each)
                fill = min(each, left[size])
                for k in range(fill):
                    place(size, bins, n_bins, k * size)
                room = capacity - fill * size
                run = (n_bins, bins)
                n_bins += bins
            else:
                space = spaces[at]
                first, bins = gaps[space].pop()
                if not gaps[space]:
                    del gaps[space]
                    spaces.pop(at)
                # As many of this size as the gap holds go into every bin of the run that can be filled alike.
                each = space // size
                full = left[size] // each
                if full == 0:
                    each, full = left[size], 1
                take = min(bins, full)
                for k in range(each):
                    place(size, take, first, capacity - space + k * size)
                if take < bins:
                    _open(gaps, spaces, space, (first + take, bins - take))
                room, run = space - each * size, (first, take)
            if room:
                _open(gaps, spaces, room, run)
    segments.sort()
    columns = np.array(segments, np.int64).reshape(-1, 4).T
    return Plan(*columns, n_bins)


def _open(gaps: dict[int, list[tuple[int, int]]], spaces: list[int], space: int, run: tuple[int, int]) -> None:
    if space not in gaps:
        gaps[space] = []
        insort(spaces, space)
    gaps[space].append(run)


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids: documents cut into pieces of at most capacity ids.

    A null text is an empty one and still has its end id. Repeated rows are packed as often as they stand. A text of any length is
    tokenised whole and cut after its ids are known. An empty table gives no rows; other columns are left aside.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                ids, begin = enc.encode(texts[a:b], end_id)
                lengths = np.diff(begin)
                n = -(-lengths // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                at = begin[doc] + piece * capacity
                end = np.minimum(at + capacity, begin[doc + 1])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), end.tolist(), strict=True)), np.int64, len(at))
                out = [ids_col.slice(a, b - a).take(pa.array(doc)), piece.astype(np.int32), piece * capacity, end - at, crc]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(at, end[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], schema=pa.schema(fields))

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(cut), kinds)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces, which have a column `length` from 1 to capacity, with sequence_id and offset.

    Offsets are gapless from 0 in every sequence. Pieces of one length are ranked by their number in
    the table of pieces, which is written once, so a lost executor changes nothing. An empty table gives no rows.
    """
    own = ["sequence_id", "offset", "_row", "_salt", "_rank", "_upto"]
    numbered = pieces.drop(*own).withColumn("_row", F.monotonically_increasing_id())
    fixed = written(numbered, "pieces")
    totals = {int(r["length"]): int(r["n"]) for r in fixed.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    found = plan(totals, capacity)
    # A size has a group for each `group` of its pieces, so there are capacity groups and one for each `group` of all pieces at most.
    groups = fixed.sparkSession.createDataFrame([(size, -(-n // group)) for size, n in totals.items()], "length long, _groups long")
    fixed = fixed.join(F.broadcast(groups), "length").withColumn("_salt", F.pmod(F.xxhash64("_row"), "_groups")).drop("_groups")
    counted = fixed.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = written(counted.select("length", "_salt", before.alias("_upto")), "piece-counts")
    # Segments of a size begin at key size * (n + 1) + rank, so one binary search finds a piece's segment.
    wide = max(totals.values(), default=0) + 1
    keys = found.size * wide + found.rank

    ranked = fixed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1)
    placed = ranked.join(counted, ["length", "_salt"])
    names = [c for c in fixed.columns if c not in ("_salt", "_row")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(k)) for k in ("length", "_rank"))
            at = np.searchsorted(keys, size * wide + rank, "right") - 1
            columns = [batch.column(c) for c in names]
            columns += [pa.array(found.bin[at] + rank - found.rank[at]), pa.array(found.offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = fixed.select(names).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return placed.select(*names, (F.col("_rank") + F.col("_upto")).cast("long").alias("_rank")).mapInArrow(frugal(assign), schema)
