import hashlib
import math
import random

import numpy as np
import pytest

from siltstone.llm import queries
from siltstone.llm.codebooks import Block, coded, distances, moved, trained

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=64, rounds=2):
    kept = [(k, v, label) for k, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = lambda r: (r[0] is None, r[0] or 0, [math.floor(256 * float(np.float32(x))) for x in r[1]])
    size = len(min(kept, key=order)[1])
    kept = sorted((r for r in kept if len(r[1]) == size), key=order)
    whole = [[max(-(1 << 26), min(1 << 26, math.floor(256 * float(np.float32(x))))) for x in v] for _, v, _ in kept]
    w = size // 16
    parts = [[v[p * w : (p + 1) * w] for p in range(16)] for v in whole]
    books = [[parts[i][p] for i in range(min(entries, len(parts)))] for p in range(16)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            members = {}
            for v in parts:
                members.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(c) for c in zip(*members[e], strict=True)] if e in members else x for e, x in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(16)] for v in parts]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((k, label, "".join(f"{e:02x}" for _, e in f), x, by_label[label], digest) for (k, _, label), f, x in zip(kept, found, error, strict=True)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(seed, n, width=32, spread=0.2):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    return [(i, [float(np.float32(c + rnd.gauss(0, spread))) for c in rnd.choice(centres)], rnd.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize(("n", "entries", "rounds", "block"), [(300, 64, 2, 4096), (200, 8, 3, 16), (40, 64, 2, 7), (120, 1, 2, 50), (150, 5, 1, 1)])
def test_against_brute_force(spark, n, entries, rounds, block):
    rows = vectors(n, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(coded(df, entries=entries, rounds=rounds, block=block)) == brute(rows, entries, rounds)


def test_odd_rows(spark):
    rows = [
        *vectors(1, 90, 16),
        (500, None, 1), (501, [], 1), (502, [None] * 16, 1), (503, [math.nan] * 16, None), (504, [1.0] * 15 + [math.inf], 2), (505, [-math.inf] * 16, 2),
        (506, [0.5] * 32, 1), (507, [1e30] * 16, 3), (508, [-1e30] * 16, None), (509, [-0.0] * 16, 3),
        (None, [0.25] * 16, 1), (7, [0.25] * 16, 1), (7, [0.25] * 16, 1), (-3, [0.25] * 16, 9),
    ]
    df = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], SCHEMA + ", code string, error int").repartition(4)
    out = coded(df, entries=20)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert got(out) == brute(rows, 20)


def test_tables_without_vectors(spark):
    for rows in ([], [(1, None, 2), (2, [], None)]):
        out = coded(spark.createDataFrame(rows, SCHEMA))
        assert got(out) == [] and dict(out.dtypes)["label_error"] == "bigint"
    with pytest.raises(ValueError):
        coded(spark.createDataFrame([(1, [0.5] * 20, 1)], SCHEMA))


def test_heaps_rescan_only_what_drift_has_violated(spark):
    """Clusters that are far apart: after the first round hardly anything is compared again, and nothing is wrong."""
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-30, 30, (16, 8, 2)) * 1000
    x = np.stack([centres[p, rnd.integers(0, 8, 3000)] for p in range(16)], axis=1) + rnd.integers(-3, 4, (3000, 16, 2))
    books, drift = centres + 2, np.zeros((16, 8))
    block = Block(x, 8)
    scanned = [block.assign(books, drift)]
    for _ in range(3):
        block = Block.unpack(block.pack(), (16, 8, 2))
        books, drift = moved(books, np.concatenate([block.sums, block.counts[:, :, None]], axis=2), drift)
        scanned.append(block.assign(books, drift))
        for p in range(16):
            assert (block.assigned[:, p] == distances(x[:, p], books[p]).argmin(1)).all()
            for e in range(8):
                assert (block.sums[p, e] == x[block.assigned[:, p] == e, p].sum(0)).all()
    assert scanned[0] == 16 * 3000 and max(scanned[1:]) < 3000


def test_decoded_vectors_lie_near(spark):
    rows = vectors(5, 200, 16, 0.02)
    df = spark.createDataFrame(rows, SCHEMA)
    made = trained(df, "vec_id", "embedding", ["vec_id"], rounds=4)
    codes = {r["vec_id"]: r["code"] for r in coded(df, rounds=4).collect()}
    assert len(made.scanned) == 4 and made.scanned[0] == 200 * 16
    assert all(np.abs(made.books.decode(codes[k]) - v).max() < 0.2 for k, v, _ in rows)


def test_op12_on_a_small_table(spark, tmp_path):
    rows = vectors(12, 130, 64)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op12_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got(out) == sorted(((k, c, e, x, h) for k, _, c, e, x, h in brute(rows)), key=str)
