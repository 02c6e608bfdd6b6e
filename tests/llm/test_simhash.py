import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from siltstone.llm import queries, simhash
from siltstone.llm.simhash import Plan, correlated_parts, fingerprints, links, number_of_parts, plan, simhash_components, thresholds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=4):
    """The least number of the component of each number."""
    label = {x: x for x in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    many = np.array(sorted(prints), np.uint64)
    for i, x in enumerate(many.tolist()):
        for y in many[i + 1 :][np.bitwise_count(many[i + 1 :] ^ many[i]) <= radius].tolist():
            a, b = sorted((root(x), root(y)))
            label[b] = a
    return {x: root(x) for x in prints}


def brute(docs, radius=4):
    prints = {i: fingerprint(t) for i, (_, t) in enumerate(docs)}
    roots = classes(set(prints.values()), radius)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            r = roots[prints[i]]
            least[r] = min(least.get(r, key), key)
    return sorted(((key, format(prints[i], "016x"), least.get(roots[prints[i]])) for i, (key, _) in enumerate(docs)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def texts(seed, n):
    """Texts, some of them near copies of others, and odd ones."""
    rnd = random.Random(seed)
    pool = ["Lorem", "ipsum", "DOLOR", "sit", "Übung", "日本", "a" * 80, "x.", "—"]
    out = [None, "", " \t\n", "one", "Two words", "three short words", "exactly four words here", "\x0b\x0c", "tab\tand\rbreak\nso"]
    while len(out) < n:
        if len(out) > 20 and rnd.random() < 0.6:
            w = (rnd.choice(out) or "").split(" ")
            w[rnd.randrange(len(w))] = rnd.choice(pool)
            out.append(" ".join(w))
        else:
            out.append(rnd.choice([" ", "  ", "\n"]).join(rnd.choice(pool) for _ in range(rnd.randint(1, 90))))
    return out


def crowded(seed, n):
    """Distinct fingerprints: crowds around a few centres, with some bits the same in all, and strangers."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) & ~0xFFFF for _ in range(4)]
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        x = rnd.choice(centres) if rnd.random() < 0.8 else rnd.getrandbits(64) & ~0xFFFF
        for _ in range(rnd.randint(0, 7)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprints(monkeypatch):
    docs = texts(1, 120)
    want = [fingerprint(t) for t in docs]
    assert fingerprints(pa.array(docs)).tolist() == want
    monkeypatch.setattr(simhash, "_HASHES_AT_ONCE", 7)
    assert fingerprints(pa.array(docs)).tolist() == want


@pytest.mark.parametrize("total", [0, 1, 3, 5])
def test_thresholds_are_the_best_allocation(total):
    rnd = np.random.default_rng(total)
    cost = rnd.random((4, total + 1, 50))
    found = thresholds(cost, total) + 1
    assert (found.sum(0) == total).all() and (found >= 0).all()
    every = [c for c in itertools.product(range(total + 1), repeat=4) if sum(c) == total]
    for q in range(50):
        assert sum(cost[k, found[k, q], q] for k in range(4)) == pytest.approx(min(sum(cost[k, c[k], q] for k in range(4)) for c in every))


def test_bits_that_go_together_share_a_part():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2, (4000, 16))
    bits = np.repeat(base, 4, axis=1) ^ (rnd.random((4000, 64)) < 0.02)
    order = rnd.permutation(64)
    bits = bits[:, order].astype(float)
    for part in correlated_parts((bits.T @ bits).astype(np.int64), 4000, 4):
        assert len(part) == 16 and len({order[b] // 4 for b in part}) == 4


def test_more_fingerprints_take_fewer_parts():
    counts = [number_of_parts(n, 4) for n in (10, 10**5, 10**7, 10**9, 10**11)]
    assert counts == sorted(counts, reverse=True) and counts[0] == 5 and counts[-1] == 2


@pytest.mark.parametrize(("n", "radius", "parts", "block", "small", "batch"), [(300, 4, None, 65536, 64, 10_000), (700, 4, 5, 40, 8, 37), (500, 3, 2, 65536, 1, 5), (600, 4, 3, 100, 30, 250), (200, 0, None, 9, 2, 10), (400, 2, 3, 1, 64, 64)])
def test_no_pair_within_the_radius_is_lost(spark, n, radius, parts, block, small, batch):
    prints = crowded(n, n)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in prints], "fp long").repartition(3)
        found = [(r["u"] % 2**64, r["v"] % 2**64) for r in links(df, plan(df, radius, block, parts), small).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert all(0 < (u ^ v).bit_count() <= radius for u, v in found)
    label = {x: x for x in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in found:
        a, b = sorted((root(u), root(v)))
        label[b] = a
    assert {x: root(x) for x in prints} == classes(prints, radius)


def test_crowds_do_not_give_all_their_pairs(spark):
    rnd = random.Random(4)
    crowd = sorted({0, *(sum(1 << b for b in rnd.sample(range(64), 2)) for _ in range(1500))})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in crowd], "fp long")
    found = links(df, plan(df)).count()
    assert len(crowd) - 1 <= found < 100 * len(crowd)


def test_hot_buckets_are_dealt_to_blocks():
    """Bits that are the same in all fingerprints make one bucket of everything: it is cut, and still asked as a whole."""
    prints = np.arange(2000, dtype=np.uint64) << np.uint64(44)
    parts = [list(range(k, k + 16)) for k in range(0, 64, 16)]
    counts = np.zeros((4, 4096), np.int64)
    for k, bits in enumerate(parts):
        counts[k] = np.bincount((simhash.part_value(prints, bits) & np.uint64(4095)).astype(np.int64), minlength=4096)
    how = Plan(parts, counts, 4, 100)
    assert how.blocks[0][0] == 20
    lies = {}
    for bucket, block, kind, fp in how.rows(prints):
        for b, c, k, _ in zip(bucket.tolist(), block.tolist(), kind.tolist(), fp.tolist(), strict=True):
            if k != 2:
                lies[b, c] = lies.get((b, c), 0) + 1
    assert max(lies.values()) < 160


def test_against_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(texts(5, 250))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(simhash_components(df)) == brute(docs)
    assert got(simhash_components(df, radius=8, small=2, block=20)) == brute(docs, 8)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    base = "a b c d e f g h i j k l m n o p q r s t"
    docs = [(None, "alone and unnamed, nothing like it"), (None, base), (7, base), (7, base), (7, "other text of the same id"), (9, None), (8, ""), (3, base.upper()), (4, "long " * 200_000), (5, "long " * 200_000 + "x")]
    df = spark.createDataFrame([(*d, i, "y") for i, d in enumerate(docs)], "doc_id long, text string, fp int, node string")
    out = simhash_components(df)
    assert out.columns == ["doc_id", "node", "fingerprint", "component_id"]
    assert got(out) == brute(docs)


def test_empty_table(spark):
    assert got(simhash_components(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_op13_on_a_small_table(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(texts(13, 100))]
    spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_simhash(spark, str(tmp_path))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert got(out) == brute(docs)
