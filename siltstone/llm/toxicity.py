"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is a bag of character n-grams of its lower-cased words, each word between two blanks, so a misspelling
shares most of its n-grams with the word it hides. N-grams are hashed into buckets; a bucket has an embedding, a
text the mean of its embeddings, and a linear softmax over the mean gives the probability. Embeddings and softmax
are trained together. The mean is linear, so scoring needs one number per bucket.

The classifier is fitted on a bounded sample of labelled rows (``MAX_ROWS`` a class, ``MAX_BYTES`` in all, chosen by
a hash of the id); every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.kernels import _blank, buffer, mix

BUCKETS = 1 << 18
DIM = 8
WIDTHS = (3, 4, 5, 6)
#: The bound of the training sample: rows of each class, and bytes of text in all.
MAX_ROWS = 4000
MAX_BYTES = 24_000_000
EPOCHS = 12
BATCH = 32
#: Texts of the sample in which an n-gram must stand to be learned.
LEAST_TEXTS = 4
#: Bytes of text whose n-grams are held at once; each byte takes about 150 while they are found.
RUN_BYTES = 500_000
#: Shares of n-grams are about a thousandth, so embeddings take long steps; the softmax takes short ones.
RATE, SOFTMAX_RATE = 4000.0, 0.02


def ngram_buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, buckets, first bucket number of each text) for runs of texts of RUN_BYTES or one longer text.

    N-grams lie within one word and the blank on either side of it.
    """
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    sizes = np.asarray(pc.binary_length(low))
    ends = np.cumsum(sizes)
    a = 0
    while a < len(low):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + RUN_BYTES, "right")))
        raw, offsets = buffer(low.slice(a, b - a))
        n = b - a
        # Every text gets a blank before and after it, and all blanks become one byte.
        framed = np.full(len(raw) + 2 * n, 32, np.uint8)
        text = np.repeat(np.arange(n), np.diff(offsets))
        framed[np.arange(len(raw)) + 2 * text + 1] = np.where(_blank[raw], 32, raw)
        limits = offsets + 2 * np.arange(n + 1)
        blank = framed == 32
        seen = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
        code = np.zeros(len(framed), np.uint64)
        found, where = [], []
        for w in range(1, max(WIDTHS) + 1):
            m = len(framed) - w + 1
            if m <= 0:
                break
            code = code[:m] * np.uint64(0x100000001B3) + framed[w - 1 : w - 1 + m] + np.uint64(1)
            if w in WIDTHS:
                ok = np.flatnonzero(seen[w - 1 : w - 1 + m] == seen[1 : 1 + m])
                found.append((mix(code[ok] + np.uint64(w)) % np.uint64(BUCKETS)).astype(np.int32))
                where.append(ok)
        place = np.concatenate(where)
        order = np.argsort(place, kind="stable")
        place, codes = place[order], np.concatenate(found)[order]
        yield a, b, codes, np.searchsorted(place, limits)
        a = b


@dataclass
class Model:
    """weight: what a bucket adds to the log odds, before the mean; embedding and softmax: what it was made of."""

    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        return self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _bags(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(buckets, counts) of each text, its number of n-grams (1 at least), and the number of texts of each bucket.

    The bags of a run are slices of two arrays, five bytes an entry; a count over 255 takes several entries. Buckets of
    fewer than LEAST_TEXTS texts are left out of the bags.
    """
    runs, totals, spread = [], [], np.zeros(BUCKETS, np.int64)
    for a, b, codes, first in ngram_buckets(column):
        key, n = np.unique(np.repeat(np.arange(b - a) * BUCKETS, np.diff(first)) + codes, return_counts=True)
        bucket = (key % BUCKETS).astype(np.int32)
        spread += np.bincount(bucket, minlength=BUCKETS)
        parts = -(-n // 255)
        counts = np.full(int(parts.sum()), 255, np.uint8)
        counts[np.cumsum(parts) - 1] = n - 255 * (parts - 1)
        runs.append((np.repeat(bucket, parts), counts, np.bincount(np.repeat(key // BUCKETS, parts), minlength=b - a)))
        totals.append(np.maximum(1, np.diff(first)))
    bags = []
    for k, (bucket, counts, sizes) in enumerate(runs):
        keep = spread[bucket] >= LEAST_TEXTS
        ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
        bucket, counts, runs[k] = bucket[keep], counts[keep], None
        bags += [(bucket[x:y], counts[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
    return bags, np.concatenate(totals), spread


def train(texts: list[str | None], labels: np.ndarray, seed: int = 1) -> Model:
    """Fit by minibatches of gradient descent with a falling rate; classes weigh the same. Without both classes every score is the class share."""
    rng = np.random.Generator(np.random.PCG64(seed))
    embedding = (rng.random((BUCKETS, DIM), np.float32) - np.float32(0.5)) / np.float32(DIM)
    softmax, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    softmax[:, 0], softmax[:, 1] = -0.5, 0.5
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros_like(embedding), softmax, np.array([0, 0] if not len(y) else [-5, 5][:: 1 if y[0] else -1], np.float32))
    bags, totals, spread = _bags(pa.array(texts, pa.string()))
    embedding *= np.float32(0.01)
    known = spread >= LEAST_TEXTS
    embedding[~known] = 0
    class_weight = len(y) / 2 / np.bincount(y, minlength=2)
    for epoch in range(EPOCHS):
        fall = 1 - epoch / EPOCHS
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            feats, counts = np.concatenate([bags[d][0] for d in docs]), np.concatenate([bags[d][1] for d in docs])
            sizes = np.array([len(bags[d][0]) for d in docs])
            doc, some = np.repeat(np.arange(len(docs)), sizes), sizes > 0
            share = (counts / totals[docs][doc]).astype(np.float32)
            mean = np.zeros((len(docs), DIM), np.float32)
            if some.any():
                mean[some] = np.add.reduceat(embedding[feats] * share[:, None], (np.cumsum(sizes) - sizes)[some], axis=0)
            z = mean @ softmax + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1
            p *= class_weight[y[docs]][:, None] / len(docs)
            # The loss pulls all n-grams of a text along softmax @ p; of two classes, p holds one number and its negative.
            pull = np.bincount(feats, p[doc, 1] * share, BUCKETS)
            moved = np.flatnonzero(pull)
            embedding[moved] -= (RATE * fall * pull[moved])[:, None] * (softmax[:, 1] - softmax[:, 0])
            softmax -= SOFTMAX_RATE * fall * (mean.T @ p).astype(np.float32)
            bias -= SOFTMAX_RATE * fall * p.sum(0).astype(np.float32)
    return Model(embedding, softmax, bias)


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels (0 or 1) of at most max_rows labelled ids a class, lowest hashes of the id first, and max_bytes of text.

    docs: doc_id, text. labels: doc_id, toxic; rows without either are left out. Sizes alone decide which texts are fetched:
    one that does not fit is left out, and shorter ones after it can fit. An id with several texts teaches them all,
    equal ones once; an id that is labelled both ways teaches both.
    """
    picked = None
    for y in (0, 1):
        rows = labels.where((F.col("toxic") == y) & F.col("doc_id").isNotNull()).select("doc_id", F.lit(y).alias("_y"))
        rows = rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = rows if picked is None else picked.unionByName(rows)
    keyed = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("_t"))
    # At most 2 * max_rows ids are broadcast, and as many sizes come back.
    sizes = keyed.join(F.broadcast(picked), "doc_id").select("doc_id", "_t", "_y", F.octet_length("text").alias("_bytes")).distinct()
    chosen, size = [], 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "_t", "_y").limit(2 * max_rows).collect():
        if size + r["_bytes"] <= max_bytes:
            size += r["_bytes"]
            chosen.append((r["doc_id"], r["_t"], r["_y"]))
    if not chosen:
        return [], np.zeros(0, np.int64)
    wanted = docs.sparkSession.createDataFrame(sorted({c[:2] for c in chosen}), picked.select("doc_id", F.lit(0).cast("long").alias("_t")).schema)
    texts = {(r["doc_id"], r["_t"]): r["text"] for r in keyed.join(F.broadcast(wanted), ["doc_id", "_t"]).dropDuplicates(["doc_id", "_t"]).collect()}
    return [texts[c[:2]] for c in chosen], np.array([c[2] for c in chosen], np.int64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score`: the probability of class 1. A null, empty or blank text gets the model's prior."""
    weight, offset = model.weight.astype(np.float32), model.offset
    names = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for a, b, codes, first in ngram_buckets(batch.column("text")):
                total = np.concatenate([[0], np.cumsum(weight[codes], dtype=np.float64)])
                out[a:b] = (total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(first)) + offset
            p = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p)], names=[*names, "score"])

    schema = docs.select(names).withColumn("score", F.lit(0.0)).schema
    return docs.select(names).mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs with held_out, score and predicted; labels of held-out rows are not learned from."""
    docs = docs.drop("held_out", "predicted")
    learn = labels.where(~held_out(F.col("doc_id")))
    model = train(*training_sample(docs, learn, max_rows))
    return score(docs, model).withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= 0.5).cast("int")})
