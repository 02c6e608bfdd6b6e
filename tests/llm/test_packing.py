import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing, queries


def check_plan(histogram, capacity):
    found = packing.plan(histogram, capacity)
    fill = {}
    keys = list(zip(found.size.tolist(), found.rank.tolist(), found.bin.tolist(), found.offset.tolist(), strict=True))
    for k, (size, rank, first, offset) in enumerate(keys):
        end = keys[k + 1][1] if k + 1 < len(keys) and keys[k + 1][0] == size else histogram[size]
        for i in range(end - rank):
            fill.setdefault(first + i, []).append((offset, size))
    assert len(fill) == found.n_bins
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    assert sum(len(p) for p in fill.values()) == sum(histogram.values())
    return found.n_bins


def first_fit_decreasing(histogram, capacity):
    bins = []
    for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        for i, b in enumerate(bins):
            if b >= s:
                bins[i] -= s
                break
        else:
            bins.append(capacity - s)
    return len(bins)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_valid_and_tight(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 100])
    histogram = {}
    for _ in range(rnd.randint(0, 300)):
        s = min(capacity, int(rnd.expovariate(1 / (capacity / 4))) + 1)
        histogram[s] = histogram.get(s, 0) + 1
    n = check_plan(histogram, capacity)
    assert n >= -(-sum(s * k for s, k in histogram.items()) // capacity)
    assert n <= first_fit_decreasing(histogram, capacity) + 1


def test_sizes_outside_the_capacity_are_refused():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_op3_against_the_library(spark, tmp_path):
    texts = ["a b", None, "", "word " * 9000, "word " * 4095, "ünï 'S <|endoftext|> x\x85y", "a b", "end\n\n of \t it"]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(None, "z", None, None), (6, "a b", "en", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, length int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_packing(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = []
    for doc_id, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((doc_id, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_pieces_keep_their_ids_and_an_empty_table_gives_none(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    pieces = packing.tokenized_pieces(docs, queries.vocabulary("word_bpe_49k.json"), 1, capacity=3, with_ids=True)
    rows = sorted(packing.pack(pieces, 3).collect(), key=lambda r: r.piece)
    assert [len(r.ids) for r in rows] == [3, 1] and rows[1].ids == [1]
    assert packing.pack(pieces.where("doc_id = 9"), 3).count() == 0


@pytest.mark.parametrize("group", [1, 3, 1000])
def test_sizes_are_numbered_in_groups_by_their_count(spark, group):
    rnd = random.Random(group)
    sizes = [rnd.choice([64, 64, 64, 30, 7, rnd.randint(1, 64)]) for _ in range(200)]
    packed = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").repartition(5), 64, group).collect()
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.doc_id for r in packed) == list(range(200))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
