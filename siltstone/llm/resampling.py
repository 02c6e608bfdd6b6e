"""Importance resampling towards a target distribution: gains of hashed word runs, then a merge of sorted runs by tournament trees.

Features are all runs of 1 to 3 words; crc32 deals them to buckets. A bucket's gain is the logarithm of how much more often
the target holds it than the corpus does, a document's weight is the sum of its features' gains, taken from one array, and
its score is the weight plus Gumbel noise, so that the highest scores are a draw without replacement.

Each partition sorts its scored documents and writes them as a run. Candidates (runs down to a score that is proven
to leave enough of them) are cut into slices of the total order, a slice's size is counted exactly, and one task merges
what the runs hold of a slice by a tournament tree, which gives the ranks. The tree stops at the exact draw count; slices
behind it are not merged at all, and no task sees more than a slice.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.kernels import Words, buffer, frugal, lowered, row_slices, words
from siltstone.llm.storage import written

BUCKETS = 10_000
LONGEST = 3
#: Rows of a slice, about: what one task holds while it merges.
SLICE_ROWS = 250_000
#: Keys a slice that reach the driver to cut the order into slices. They decide nothing else: sizes and ranks are counted.
SAMPLES = 32
#: Words whose features are hashed at once, and the longest word that is hashed with others byte by byte.
_WORDS_AT_ONCE, _LONG_WORD = 1 << 18, 64

#: A word is a run of ASCII letters and digits and of anything outside ASCII; letters are lower-cased before.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# crc32 of a concatenation: the first part's value moved on by the second's length, a linear map, combined with the second's value.
_BYTE = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as its values on each of the four bytes."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _maps() -> tuple[np.ndarray, list[np.ndarray]]:
    """The maps that move a value on by 0 to 63 zero bytes, and by 2 ** k of them from k = 6."""
    zero = lambda c: _BYTE[c & 255] ^ c >> 8
    short = [(np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)]
    for _ in range(63):
        short.append(zero(short[-1]))
    powers = [zero(short[-1])]
    for _ in range(6, 40):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(short), powers


_SHORT, _POWERS = _maps()


def moved_on(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    low = n & 63
    out = _SHORT[low, 0, crc & 255] ^ _SHORT[low, 1, crc >> 8 & 255] ^ _SHORT[low, 2, crc >> 16 & 255] ^ _SHORT[low, 3, crc >> 24]
    high, k = n >> 6, 0
    while high.any():
        odd = np.flatnonzero(high & 1)
        out[odd] = _apply(_POWERS[k], out[odd])
        high, k = high >> 1, k + 1
    return out


def _spaced(crc: np.ndarray) -> np.ndarray:
    """crc32 of the same bytes and a space."""
    c = ~crc
    return ~(_BYTE[(c ^ 0x20) & 255] ^ c >> 8)


def _word_crcs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    active, k = np.flatnonzero(size <= _LONG_WORD), 0
    while len(active):
        c = crc[active]
        crc[active] = _BYTE[(c ^ raw[start[active] + k]) & 255] ^ c >> 8
        k += 1
        active = active[size[active] > k]
    crc = ~crc
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        crc[i] = zlib.crc32(raw[start[i] : end[i]])
    return crc


def features(raw: np.ndarray, w: Words, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The text's number and the bucket of every feature, some of them at a time."""
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    for a in range(0, len(w.start), _WORDS_AT_ONCE):
        z = min(a + _WORDS_AT_ONCE + longest - 1, len(w.start))
        own = min(_WORDS_AT_ONCE, z - a)
        one, size, owner = _word_crcs(raw, w.start[a:z], w.end[a:z]), w.end[a:z] - w.start[a:z], text[a:z]
        run = one
        for more in range(longest):
            n = z - a - more
            if more:
                run = moved_on(_spaced(run[:n]), size[more:]) ^ one[more:]
            whole = owner[:n] == owner[more:]
            whole[own:] = False
            yield owner[:n][whole], run[whole] % np.uint32(buckets)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Words]]:
    for part in row_slices(batch, "text"):
        raw, offsets = buffer(part.column("text"))
        raw = lowered(raw)
        yield part, raw, words(raw, offsets, _IN_WORD[raw])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall in each bucket: summed in each task, then over the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, raw, w in _read(batch):
                for _, bucket in features(raw, w, buckets, longest):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(frugal(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of the smoothed shares of each bucket, in doubles."""
    all_corpus, all_target, k = float(corpus.sum()), float(target.sum()), float(len(corpus))
    ratio = lambda s, t: (t + 1.0) * (all_corpus + k) / ((s + 1.0) * (all_target + k))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """docs (key, kept, text) without the text, with n_words, n_features and weight."""
    names = [c for c in docs.columns if c != "text"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, w in _read(batch):
                n = part.num_rows
                count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for owner, bucket in features(raw, w, len(gain), longest):
                    count += np.bincount(owner, minlength=n)
                    # Sums of a chunk are whole numbers far below 2 ** 53.
                    weight += np.bincount(owner, gain[bucket], n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.diff(w.first)), pa.array(count), pa.array(weight)], names=[*names, "n_words", "n_features", "weight"])

    made = docs.select(names).withColumns({c: F.lit(0).cast("long") for c in ("n_words", "n_features", "weight")})
    return docs.select(*names, "text").mapInArrow(frugal(weigh), made.schema)


class Tournament:
    """A tree of losers over sorted runs: the winner is the least head of all, and to replace it costs one match a level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.heads = runs, [next(r, None) for r in runs]
        k = len(runs)
        self.losers = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1]

    def _beats(self, a: int, b: int) -> bool:
        return self.heads[b] is None or self.heads[a] is not None and self.heads[a] <= self.heads[b]

    def pop(self) -> tuple | None:
        w = self.winner
        out, self.heads[w] = self.heads[w], next(self.runs[w], None)
        node = (w + len(self.runs)) // 2
        while node:
            if self._beats(self.losers[node], w):
                w, self.losers[node] = self.losers[node], w
            node //= 2
        self.winner = w
        return out


_RUN_BITS = 33  # monotonically_increasing_id: the partition, which is the run, above so many bits of the place in it


def _order(batch: pa.RecordBatch) -> list[tuple]:
    """The total order of rows: score descending, key ascending (null first), features, and then the place, which is unique."""
    columns = (batch.column(c).to_pylist() for c in ("score", "key", "n_features", "id"))
    return [(-s, k is not None, 0 if k is None else k, n, i) for s, k, n, i in zip(*columns, strict=True)]


def _sliced(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(splitters, x) for x in _order(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "slice"])

    return rows.mapInArrow(cut, rows.withColumn("slice", F.lit(0).cast("long")).schema)


def _merged(sliced: DataFrame, before: dict[int, int], draw: int) -> DataFrame:
    """sliced with ranks: every slice's runs are merged until `draw` rows are out, those of earlier slices included; then ranks are null."""

    def merge(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys, first = _order(whole), before[whole.column("slice")[0].as_py()]
        run = np.asarray(whole.column("id")) >> _RUN_BITS
        # Rows come by id: run after run, each in its order.
        cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(keys)]
        tree = Tournament([iter([(keys[i], i) for i in range(a, b)]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        rank: list[int | None] = [None] * len(keys)
        for k in range(min(len(keys), draw - first)):
            rank[tree.pop()[1]] = first + k + 1
        return pa.RecordBatch.from_arrays([*whole.columns, pa.array(rank, pa.int64())], names=[*whole.schema.names, "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = np.asarray(batch.column("slice"))
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column("slice")[0].as_py() != at[a]:
                    yield merge(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield merge(held)

    n = int(sliced.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sliced.repartition(n, "slice").sortWithinPartitions("slice", "id")
    return dealt.mapInArrow(frugal(run), sliced.withColumn("rank", F.lit(None).cast("long")).schema)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, keep: list[str] | None = None, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = "42", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The columns `keep` of every row of docs (doc_id alone, if not given), n_features, weight, score, rank.

    Of the N rows with at least least_words words, floor(percent * N / 100) are drawn: those of the highest scores, ties to the
    smaller doc_id, then to fewer features, then as the rows lie. rank counts the drawn ones from 1 and is null for all others.
    A null text has no words, weight 0 and is never drawn if least_words is 1 or more; a null doc_id sorts before all others and
    is hashed as an empty text. Rows that stand twice have equal scores and are drawn one by one. Without documents there
    are no rows, without a target all gains are about rarity. Kept columns that are named as one of the four are left out.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    own = ["n_features", "weight", "score"]
    kept = F.struct(*(F.col(f"`{c}`") for c in keep or ["doc_id"] if c not in (*own, "rank"))).alias("kept")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighted(docs.select(F.col("doc_id").alias("key"), kept, "text"), gain, longest).withColumn("score", F.col("weight") + noise)
    scored = scored.withColumn("eligible", F.col("n_words") >= least_words).drop("n_words")
    runs = scored.sortWithinPartitions(F.desc("eligible"), F.desc("score"), F.asc_nulls_first("key"), "n_features")
    runs = written(runs.withColumn("id", F.monotonically_increasing_id()), "runs")
    eligible = runs.where("eligible")
    shares = [max(0.0, 1 - percent / 100 - more) for more in (0.001, 0.02)] + [0.0]
    found = eligible.agg(F.count("*").alias("n"), F.percentile_approx("score", shares, 10_000).alias("at")).first()
    draw = percent * found["n"] // 100
    out = ["kept.*", *own]
    unranked = lambda df: df.select(*out, F.lit(None).cast("long").alias("rank"))
    if not draw:
        return unranked(runs)
    # The lowest score that is tried is the lowest of all, so one of them leaves enough rows.
    enough = eligible.agg(*(F.count_if(F.col("score") >= x).alias(str(k)) for k, x in enumerate(found["at"]))).first()
    low, n = next((x, c) for x, c in zip(found["at"], enough, strict=True) if c >= draw)
    candidates = eligible.where(F.col("score") >= low)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // slice_rows))
    sample = candidates.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // (SAMPLES * parts)))) == 0).select("score", "key", "n_features", "id")
    keys = sorted((-r["score"], r["key"] is not None, 0 if r["key"] is None else r["key"], r["n_features"], r["id"]) for r in sample.collect())
    each = max(1, -(-len(keys) // parts))
    sliced = written(_sliced(candidates, keys[each::each]), "slices")
    before, last, total = {}, 0, 0
    for r in sliced.groupBy("slice").count().orderBy("slice").collect():
        if total < draw:
            before[r["slice"]], last, total = total, r["slice"], total + r["count"]
    merged = _merged(sliced.where(F.col("slice") <= last), before, draw).select(*out, "rank")
    return merged.unionByName(unranked(sliced.where(F.col("slice") > last))).unionByName(unranked(runs.where(~F.col("eligible") | (F.col("score") < low))))
