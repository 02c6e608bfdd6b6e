"""Near duplicates by ProbMinHash, banding and exact verification.

A text is a weighted set: its runs of five words and how often each occurs. ProbMinHash gives every run a Poisson
process of arrivals whose rate is its weight; each arrival falls on a random register, a register keeps the run that
arrives first, and a run stops as soon as its next arrival is later than all registers. Two texts agree in a register
with the probability Jaccard similarity of their weights. Registers are grouped into bands; texts that share a band are
candidates, and candidates are verified by the exact probability Jaccard similarity.

Equal texts are one node from the start. A bucket of a band is searched in blocks of `BLOCK` texts at most, each with the
bucket's lowest node. Within a block a text is compared with those it is not yet connected to, so a group of near copies
of one text costs one comparison a text; only a spanning forest of the links is emitted. Buckets with the same texts are
searched once. The texts of large buckets that are not one component by then are dealt anew by longer bands, which keep
apart what is merely related and still bring a pair at the threshold together, and searched alike; texts that are
connected already are not compared. What is open even then (many texts of one template, say) is dealt by prefixes: the runs of
these texts are ordered by rarity. If the runs that two texts have in common are shares a and b of their weights, their similarity
t is a * b / (a + b - a * b) at most; so both shares are t at least and one of them is 2t / (1 + t). The rarest common run thus lies
among the rarest runs that make up just over 1 - t of the weight of either text, and over (1 - t) / (1 + t) of one of them. A text
ships the hashes of the former, and a run that is among the latter in no text is dropped, as are those of one text alone: a template's
pages that differ by more than the threshold allows do not meet. Only buckets of such a run that exceed a block and are still not
connected are compared block by block, so no pair is left out. Classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.kernels import RangeHash, buffer, distinct_counts, frugal, mix, shingles, words
from siltstone.llm.storage import set_aside, written
from siltstone.operators.graph import components

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 0.0007.
BANDS, ROWS = 24, 6
#: Longer bands for the texts of large buckets; here the probability is 0.0006, and a pair of 0.5 shares one with 0.025 (above: 0.31).
LONG_BANDS, LONG_ROWS = 104, 12
BLOCK = 1000
#: Elements of which the arrivals are drawn at once.
_ELEMENTS = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = -(1 << 63)
_KEYS = ["_id", "_k1", "_k2"]


def weighted_shingles(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of words of every text (hashes, ascending), their counts, and where each text's begin."""
    raw, offsets = buffer(column)
    w = words(raw, offsets)
    codes = RangeHash.of_bytes(raw)(w.start, w.end)
    return distinct_counts(*shingles(codes, w.first, width))


def signatures(hashes: np.ndarray, weights: np.ndarray, first: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash of every weighted set, (n, registers); sets without elements have zeros."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    arrival = np.full(n * registers, np.inf)
    out = np.zeros(n * registers, np.uint64)
    alive, now, drawn = np.arange(len(hashes)), np.zeros(len(hashes)), 0
    while len(alive):
        many = int(np.clip(_ELEMENTS // len(alive), 1, 64))
        k = np.arange(drawn + 1, drawn + many + 1, dtype=np.uint64) * _STEP
        x = mix(hashes[alive][:, None] + k)
        wait = -np.log1p(-((x >> np.uint64(11)) * 2.0**-53)) / weights[alive][:, None]
        times = now[alive][:, None] + np.cumsum(wait, axis=1)
        slot = (owner[alive] * registers)[:, None] + (mix(x + _STEP) % np.uint64(registers)).astype(np.int64)
        latest = arrival.reshape(n, registers).max(1)
        use = times < latest[owner[alive]][:, None]
        slot_used, time_used = slot[use], times[use]
        np.minimum.at(arrival, slot_used, time_used)
        won = arrival[slot_used] == time_used
        out[slot_used[won]] = np.broadcast_to(hashes[alive][:, None], times.shape)[use][won]
        now[alive] = times[:, -1]
        latest = arrival.reshape(n, registers).max(1)
        alive = alive[now[alive] < latest[owner[alive]]]
        drawn += many
    return out.reshape(n, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for r in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return out.view(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact: sum over common elements of 1 / sum over all elements of max(x_j / x_i, y_j / y_i). a and b ascend."""
    every = np.union1d(a, b)
    u, v = np.zeros(len(every)), np.zeros(len(every))
    u[np.searchsorted(every, a)], v[np.searchsorted(every, b)] = x, y
    with np.errstate(divide="ignore"):
        ratio = u / v
    order = np.argsort(-ratio, kind="stable")
    u, v, ratio = u[order], v[order], ratio[order]
    # Elements of a ratio as large give x_j / x_i, the others y_j / y_i; equal ratios give the same either way.
    high = np.searchsorted(-ratio, -ratio, "right")
    above, below = np.concatenate([[0], np.cumsum(u)])[high], (v.sum() - np.concatenate([[0], np.cumsum(v)]))[high]
    both = (u > 0) & (v > 0)
    return float((1 / (above[both] / u[both] + below[both] / v[both])).sum())


def _links(nodes: list[int], side: list[int], label: list[int], texts: pa.Array, similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links in one block. Texts with the same label are connected; the same side (if not -1) is done."""
    hashes, counts, first = weighted_shingles(texts)
    n = len(nodes)
    total = np.maximum(1, np.add.reduceat(np.append(counts, 0), first[:-1]) * (np.diff(first) > 0)).astype(float)
    ids, dense = np.unique(hashes, return_inverse=True)
    share = counts / np.repeat(total, np.diff(first))
    group = np.unique(np.array(label), return_inverse=True)[1]
    sides = np.array(side)
    own = np.zeros(len(ids))
    for i in range(n - 1):
        other = np.flatnonzero((group[i + 1 :] != group[i]) & ((sides[i + 1 :] != sides[i]) | (sides[i] < 0))) + i + 1
        a, b = first[i], first[i + 1]
        if not len(other) or a == b:
            continue
        own[dense[a:b]] = share[a:b]
        # The shares that two texts have in common bound their similarity from above.
        at, size = first[other], first[other + 1] - first[other]
        where = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(np.repeat(np.arange(len(other)), size), np.minimum(own[dense[where]], share[where]), len(other))
        own[dense[a:b]] = 0
        for j in other[common >= similarity - 1e-9].tolist():
            if group[j] == group[i]:
                continue
            c, d = first[j], first[j + 1]
            if probability_jaccard(hashes[a:b], counts[a:b], hashes[c:d], counts[c:d]) >= similarity - 1e-9:
                yield nodes[i], nodes[j]
                group[group == group[j]] = group[i]


def _verified(blocks: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) within groups of rows: bucket, block, node, side, label, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
            t = pa.Table.from_batches(parts)
            columns = (t.column(c).to_pylist() for c in ("node", "side", "label"))
            return list(_links(*columns, t.column("text").combine_chunks(), similarity))

        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("bucket", "block")], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            found: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key is not None and tuple(k[a]) != key:
                    found += done(held)
                    held = []
                key = tuple(k[a])
                held.append(batch.slice(a, b - a))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])
        if held and (found := done(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])

    n = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.select("bucket", "block", "node", "side", "label", "text").repartition(n, "bucket", "block").sortWithinPartitions("bucket", "block", "node")
    return dealt.mapInArrow(frugal(run), "u long, v long")


def _keys() -> dict:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(7), text)}


def _sketched(keyed: DataFrame, bands: int, rows: int) -> DataFrame:
    """keyed without its column text but with bands: the hashes of the text's bands, none for a text without words."""
    names = [c for c in keyed.columns if c != "text"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                hashes, counts, first = weighted_shingles(part.column("text"))
                found = band_hashes(signatures(hashes, counts, first, bands * rows), bands, rows)
                some = np.diff(first) > 0
                offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[some].ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], names=[*names, "bands"])

    return keyed.mapInArrow(frugal(sketch), keyed.select(names).withColumn("bands", F.array().cast("array<long>")).schema)


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """members (node, label, keys, bucket) of buckets of several labels, with the bucket's lowest node, its number of blocks and the node's block."""
    buckets = members.groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.min("node").alias("pivot"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64(F.lit(3), "node")).alias("x"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
    )
    # Of buckets with the same members one is enough.
    buckets = buckets.where("low <> high").groupBy("n", "pivot", "s", "x").agg(F.min("bucket").alias("bucket"))
    parts = F.ceil(F.col("n") / block).cast("int")
    joined = members.join(buckets.select("bucket", "pivot", parts.alias("parts")), "bucket")
    return written(joined.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "node"), "parts").cast("int")), "members")


def _links_in_blocks(dealt: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    # The lowest node of a bucket is in each of its blocks.
    places = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    cells = dealt.select("bucket", "node", "label", *_KEYS, F.explode(places).alias("block"), F.lit(-1).alias("side"))
    return written(_verified(cells.join(texts, _KEYS).dropDuplicates(["bucket", "block", "node"]), similarity), "links")


def _open_members(dealt: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets of several blocks that are not one component, with their present labels."""
    split = dealt.where("parts > 1").drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = written(split, "labelled")
    open_ = written(labelled.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("bucket"), "open-buckets")
    return written(labelled.join(open_, "bucket", "left_semi"), "open")


def _by_prefixes(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """members (node, label, keys) by the runs of their prefixes, as buckets, where two texts can have their rarest common run."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                hashes, counts, first = weighted_shingles(part.column("text"))
                n = np.diff(first)
                total = np.add.reduceat(np.append(counts, 0), first[:-1]) * (n > 0)
                share = counts / np.repeat(np.maximum(1, total), n)
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(hashes.view(np.int64)), pa.array(share)], names=["node", "bucket", "share"])

    held = members.join(texts, _KEYS).dropDuplicates(["node"]).select("node", "text")
    every = written(held.mapInArrow(frugal(runs), "node long, bucket long, share double"), "runs")
    common = written(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "run-counts")
    before = F.coalesce(F.sum("share").over(Window.partitionBy("node").orderBy("n", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ordered = every.join(common, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("before", before)
    short = F.col("before") <= (1 - similarity) / (1 + similarity) + 1e-9
    prefix = written(ordered.where((F.col("before") <= 1 - similarity + 1e-9) & (F.col("n") > 1)).select("node", "bucket", short.alias("short")), "prefixes")
    meets = written(prefix.groupBy("bucket").agg(F.count("*").alias("n"), F.max("short").alias("short")).where("short and n > 1").select("bucket"), "meeting-runs")
    return members.join(prefix.drop("short").join(meets, "bucket", "left_semi"), "node")


def text_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """_k1, _k2 (128 bits of a text), class_id, r1, r2: the class of every distinct text, and the text that stands for it.

    class_id is the lowest doc_id of the class, r1 and r2 the key of a text with this id.
    """
    keyed = docs.withColumns(_keys()).select("_id", "_k1", "_k2", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    nodes = _sketched(keyed, bands, rows).groupBy("_k1", "_k2").agg(F.min("_id").alias("_id"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = keyed.select(*_KEYS, "text")
    dealt = _dealt(nodes.select("node", F.col("node").alias("label"), *_KEYS, F.explode("bands").alias("bucket")), block)
    links = _links_in_blocks(dealt, texts, similarity)
    labels = written(components(links), "labels")
    if dealt.where("parts > 1").limit(1).count():
        again = _open_members(dealt, labels).select("node", "label", *_KEYS).distinct()
        long = written(_sketched(again.join(texts, _KEYS).dropDuplicates(["node"]), LONG_BANDS, LONG_ROWS), "long-bands")
        dealt = _dealt(long.select("node", "label", *_KEYS, F.explode("bands").alias("bucket")), block)
        links = links.unionByName(_links_in_blocks(dealt, texts, similarity))
        labels = written(components(links), "labels")
        again = _open_members(dealt, labels).select("node", "label", *_KEYS).distinct() if dealt.where("parts > 1").limit(1).count() else None
        if again is not None and again.limit(1).count():
            dealt = _dealt(written(_by_prefixes(written(again, "open-texts"), texts, similarity), "prefixes"), block)
            links = links.unionByName(_links_in_blocks(dealt, texts, similarity))
            labels = written(components(links), "labels")
        if dealt.where("parts > 1").limit(1).count():
            # A text meets every other block: block pairs are numbered by their lower and their higher block.
            other = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own")))
            pairs = _open_members(dealt, labels).withColumn("other", other)
            pairs = pairs.withColumn("block", F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).withColumn("side", F.col("own"))
            cells = pairs.select("bucket", "block", "node", "side", "label", *_KEYS)
            more = _verified(cells.join(texts, _KEYS).dropDuplicates(["bucket", "block", "node"]), similarity)
            labels = written(components(links.unionByName(written(more, "links"))), "labels")
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named, "named")
    best = written(named.groupBy("label").agg(F.min(F.struct("_id", "_k1", "_k2")).alias("b"), F.count("*").alias("n_texts")), "best")
    return named.join(best, "label").select("_k1", "_k2", F.col("b._id").alias("class_id"), F.col("b._k1").alias("r1"), F.col("b._k2").alias("r2"), "n_texts")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, **how: int) -> DataFrame:
    """docs with class_id (the lowest doc_id of the near-duplicate class), n_texts (its distinct texts) and is_first.

    is_first marks the rows that stand for their class: its lowest doc_id with one of its texts. A null text is an
    empty one. Texts without words are alike only if they are equal; texts of fewer than five words are one run. A null
    doc_id sorts first, and a class that it stands for has a null class_id. Rows that share id and text are both first
    or neither. An empty table gives no rows.
    """
    own = ["class_id", "n_texts", "is_first", "_id", "_k1", "_k2", "r1", "r2"]
    names = [c for c in docs.columns if c not in own]
    docs = docs.select(names)
    classes = text_classes(docs.select("doc_id", "text"), similarity, **how)
    joined = docs.withColumns(_keys()).join(classes, ["_k1", "_k2"])
    first = (F.col("_id") == F.col("class_id")) & (F.col("_k1") == F.col("r1")) & (F.col("_k2") == F.col("r2"))
    return joined.select(*names, F.when(F.col("class_id") != _NO_ID, F.col("class_id")).alias("class_id"), "n_texts", first.alias("is_first"), "_id", "_k1", "_k2").drop("_id", "_k1", "_k2")


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, **how: int) -> DataFrame:
    """One row of docs for each class. Of rows that share id and text that with the lowest hash of all columns stays."""
    held, restored = set_aside(docs)
    first = text_classes(held.select("doc_id", "text"), similarity, **how).select(F.col("class_id").alias("_id"), F.col("r1").alias("_k1"), F.col("r2").alias("_k2")).distinct()
    kept = held.withColumns(_keys()).join(first, _KEYS, "left_semi")
    copies = held.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1")
    if copies.limit(1).count():
        kept = kept.groupBy(*_KEYS).agg(F.min_by(F.struct(*held.columns), F.xxhash64(*held.columns)).alias("_row")).select("_row.*")
    return restored(kept)
