import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import queries
from siltstone.llm.resampling import Tournament, moved_on, resampled, weighted

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in buckets(x):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + 10000) / ((s[b] + 1.0) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for key, text in docs:
        weight = sum(gain[b] for b in buckets(text))
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(buckets(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    eligible = sorted((i for i, (_, text) in enumerate(docs) if len(words(text)) >= least), key=lambda i: (-rows[i][3], rows[i][0] is not None, rows[i][0] or 0, rows[i][1]))
    rank = {i: k + 1 for k, i in enumerate(eligible[: percent * len(eligible) // 100])}
    return sorted(((*r, rank.get(i)) for i, r in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    pool = ["Alpha", "beta", "übung", "ÜBUNG", "x" * 63, "y" * 64, "z" * 65, "q" * 1500, "日本語", "a1", "7", "It's", "the", "of", "\x00", "—"]
    return [(i, "".join(rnd.choice(pool) + rnd.choice([" ", ", ", "\n", "\x7f", "_"]) for _ in range(rnd.randint(0, 60)))) for i in range(n)]


def test_crc_of_concatenations():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 5, 63, 64, 65, 1000, 123457):
        a, b = rnd.bytes(9), rnd.bytes(n)
        moved = moved_on(np.array([zlib.crc32(a)], np.uint32), np.array([n]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("k", [1, 2, 3, 7, 64])
def test_a_tournament_merges_sorted_runs(k):
    rnd = random.Random(k)
    runs = [sorted((rnd.randint(0, 50), i, j) for j in range(rnd.randint(0, 40))) for i in range(k)]
    tree = Tournament([iter(r) for r in runs])
    for want in sorted(x for r in runs for x in r):
        assert tree.pop() == want
    assert tree.pop() is None


@pytest.mark.parametrize(("percent", "least", "slice_rows"), [(5, 20, 250_000), (50, 5, 7), (100, 0, 1), (0, 20, 10)])
def test_against_brute_force(spark, percent, least, slice_rows):
    docs, target = corpus(percent, 150), [x for _, x in corpus(99, 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    assert got(resampled(df, bench, percent, least, slice_rows=slice_rows)) == brute(docs, target, percent, least)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    same = "one two three four five " * 6
    docs = [(None, same), (1, None), (2, ""), (3, same), (3, same), (3, same), (4, same + "Six"), (None, same), (5, "…"), (6, "w " * 50_000)]
    target = ["one two three", None, ""]
    df = spark.createDataFrame([(*d, i, "x") for i, d in enumerate(docs)], "doc_id long, text string, score int, kept string")
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    # Tenfold, so that equal scores stand at the cut.
    many = df.unionByName(df.where("doc_id = 3")).repartition(3)
    listed = [*docs, *[d for d in docs if d[0] == 3]]
    assert got(resampled(many, bench, 50)) == brute(listed, target, 50)
    whole = resampled(many, bench, 50, keep=["doc_id", "score", "kept", "text"])
    assert whole.columns == ["doc_id", "kept", "text", "n_features", "weight", "score", "rank"]
    assert whole.count() == len(listed)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(corpus(3, 40), "doc_id long, text string")
    assert got(resampled(none, some)) == []
    assert got(resampled(some, none)) == brute(corpus(3, 40), [])


def test_weights_do_not_depend_on_how_much_is_hashed_at_once(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(5, 30), "doc_id long, text string")
    gain = np.arange(10000) - 5000
    once = weighted(docs, gain).collect()
    monkeypatch.setattr("siltstone.llm.resampling._WORDS_AT_ONCE", 5)
    from siltstone.llm.kernels import buffer, lowered
    from siltstone.llm.kernels import words as cut
    from siltstone.llm.resampling import _IN_WORD, features

    texts = [t for _, t in corpus(5, 30)]
    raw, offsets = buffer(pa.array(texts))
    raw = lowered(raw)
    total = np.zeros(len(texts), np.int64)
    for owner, bucket in features(raw, cut(raw, offsets, _IN_WORD[raw]), 10000, 3):
        np.add.at(total, owner, gain[bucket])
    assert {r["doc_id"]: r["weight"] for r in once} == dict(enumerate(total.tolist()))


def test_op11_on_a_small_table(spark, tmp_path):
    docs, target = corpus(11, 80), corpus(12, 5)
    spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(target, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries.op11_resampling(spark, str(tmp_path))
    assert out.columns == COLUMNS and {t for _, t in out.dtypes} == {"bigint"}
    assert got(out) == brute(docs, [x for _, x in target])
