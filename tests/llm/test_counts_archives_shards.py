import io
import math
import random
from decimal import Decimal, localcontext
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import queries, sharding, token_counts, token_files, warc
from siltstone.llm.storage import new_folder
from siltstone.llm.tokens import Encoder

TEXTS = ["It's a b,c", None, "", " x ", "a b", "a b", "z" * 5000 + " ", "été, İx\x85y <|endoftext|> 12.5%'s", "\n\n tail \n"]


def test_encoder_agrees_with_the_library_on_odd_texts():
    rnd = random.Random(3)
    parts = [*"abcZ.,%$-_ \n\t.!-éÉß漢🙂0123<|>́ ​\x1c\x85İ's", "'ll", "<|endoftext|>", "  ", "\r\n", "don't", "≠"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(30000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = queries.vocabulary(name)
        ids, first = Encoder(path).encode(pa.array(texts, pa.string()))
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want
        assert Encoder(path).counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in want]


def documents(spark, tmp_path, texts):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_op2_totals_are_those_of_the_final_documents(spark, tmp_path):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", "x") for i, t in enumerate(TEXTS)]
    # Ids that stand twice, with the same text or another, and without any id.
    rows += [(1, " x y ", "en", "s0", "x"), (1, " x y ", "en", "s0", "x"), (1, "hello ", "en", "s0", "x"), (None, "hello", "en", "s1", "x"), (None, "hello", None, "s1", "x"), (7, None, None, None, "x"), (7, None, None, None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in queries.op2_token_counts(spark, str(tmp_path)).collect()}
    want, seen = Counter(), set()
    docs = Counter()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3] is not None, r[3] or "", r[2] is not None, r[2] or ""))
    for _, text, lang, source, _ in order:
        if text is not None and text in seen:
            continue
        seen.add(text)
        for v in ("byte_bpe_50k", "word_bpe_49k"):
            enc = Encoder(queries.vocabulary(f"{v}.json"))
            want[source, lang, v] += int(enc.counts(pa.array([(text or "").strip(" \t\r\n")]))[0])
            docs[source, lang, v] += 1
    assert got == {k: (docs[k], want[k]) for k in docs}


def test_op2_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op2_token_counts(spark, str(tmp_path)).count() == 0


def test_snapshots_hold_what_was_committed(spark):
    rollup = token_counts.Rollup(spark, new_folder(spark, "t"))
    kinds = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
    for k in range(3):
        one = spark.createDataFrame([(k, "s", "en", "v", k + 1), (9, f"s{k}", None, "v", 5)], kinds)
        assert rollup.commit(str(k), token_counts.inserts(one))
        assert rollup.commit(f"-{k}", token_counts.deletes(one.where("doc_id = 9")))
        if k < 2:
            assert rollup.compact()
            assert not rollup.commit(str(k), token_counts.inserts(one))
    assert len(rollup._open()[1]) == 2
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 3, 6)]
    # A marker that says nothing is that of a lost committer.
    rollup._fs.create(rollup._path(rollup._place("x")), False).close()
    assert not rollup.committed("x") and rollup.totals().count() == 1
    assert rollup.commit("x", token_counts.deletes(spark.createDataFrame([(0, "s", "en", "v", 6)], kinds))) and rollup.committed("x")
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 2, 0)]


def test_commits_are_idempotent_and_keys_can_vanish(spark):
    rollup = token_counts.Rollup(spark, new_folder(spark, "t"))
    assert rollup.totals().count() == 0
    kinds = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
    one = spark.createDataFrame([(1, "s", None, "v", 5), (2, "s", None, "v", 7)], kinds)
    assert rollup.commit("a", token_counts.inserts(one)) and not rollup.commit("a", token_counts.inserts(one))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", None, "v", 2, 12)]
    new = spark.createDataFrame([(2, "t", "en", "v", 9)], kinds)
    assert rollup.commit("b", token_counts.revisions(one.where("doc_id = 2"), new))
    assert rollup.commit("c", token_counts.deletes(one.where("doc_id = 1")))
    assert [tuple(r) for r in rollup.totals().collect()] == [("t", "en", "v", 1, 9)]


def test_op9_round_trip(spark, tmp_path):
    rows = documents(spark, tmp_path, TEXTS + ["the cat sat on the mat. " * 400] * 3)
    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    at, want = 0, []
    for doc_id, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op9_token_files(spark, str(tmp_path)).collect()) == want


def test_grammar_round_trip_ranges_and_gain():
    rng = np.random.default_rng(1)
    docs = [np.tile(rng.integers(0, 9, 7), 300), np.zeros(0, int), np.full(1001, 4), rng.integers(0, 50000, 50), np.array([0])]
    ids, first = np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    symbols, sym_first, rules, lengths, base = token_files.compress(ids, first)
    assert len(symbols) < len(ids) / 8
    block = token_files.Block(token_files._block([3, None, 5, 6, 7], ids, first))
    assert block.doc_ids == [3, None, 5, 6, 7]
    for k, d in enumerate(docs):
        assert block.document(k).tolist() == d.tolist()
        for a, b in ((0, len(d)), (len(d) // 3, len(d) // 2), (len(d) - 1, len(d))):
            if 0 <= a < b:
                assert block.ids(k, a, b).tolist() == d[a:b].tolist()
    empty = token_files.compress(np.zeros(0, np.uint32), np.zeros(1, np.int64))
    assert len(empty[0]) == 0


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    passage = rng.permutation(40000)[:400]
    own = [rng.integers(0, 3000, 300) for _ in range(120)]
    docs = [np.concatenate([o, passage]) for o in own] + [np.full(4000, 7)]
    ids, first = np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    symbols, sym_first, rules, lengths, base = token_files.compress(ids, first)
    # 48,000 ids of copies shrink to a symbol or a few for each copy.
    assert len(symbols) < 36000 + 120 * 4 + 40
    inner = np.ones(len(symbols), bool)
    inner[sym_first[1:].astype(np.int64) - 1] = False
    pairs = list(zip(symbols[:-1][inner[:-1]].tolist(), symbols[1:][inner[:-1]].tolist(), strict=True))
    assert max(Counter(pairs).values()) < token_files.LEAST
    block = token_files.Block(token_files._block(list(range(len(docs))), ids, first))
    assert block.all_ids().tolist() == ids.tolist() and block.ids(5, 310, 420).tolist() == docs[5][310:420].tolist()


def test_op6_is_exact_gapless_and_seeded(spark, tmp_path):
    documents(spark, tmp_path, [None, "", "é"] + ["same"] * 40 + [f"t{i}" for i in range(60)])
    got = queries.op6_sharding(spark, str(tmp_path)).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == 103 and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {r.doc_id: (r.size, r.text_crc32) for r in got}[2] == (3, zlib.crc32("é".encode()))
    assert sorted(got) == sorted(queries.op6_sharding(spark, str(tmp_path)).collect())
    assert sharding.shuffle_into_shards(spark.createDataFrame([], "a long, shard int"), ["a"]).count() == 0
    copies = spark.createDataFrame([(1,), (1,), (None,)], "a long")
    assert sharding.shuffle_into_shards(copies, ["a"], shards=2).count() == 3


def test_op6_over_many_blocks_and_parts(spark):
    n, shards = 3000, 5
    rows = spark.range(n, numPartitions=30).withColumnRenamed("id", "a").withColumn("_block", F.lit("own"))
    for blocks in (64, 7, 1):
        got = sharding.shuffle_into_shards(rows.drop("_block"), ["a"], shards=shards, max_blocks=blocks, part_rows=90).collect()
        assert sorted(r.a for r in got) == list(range(n))
        counts = Counter(r.shard for r in got)
        assert set(counts.values()) == {n // shards}
        place = {r.a: (r.shard, r.slot) for r in got}
        for s in range(shards):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n // shards))
        # A uniform order keeps nothing of the old one: shares of the old partitions, order, and neighbours.
        cells = Counter((a // 100, place[a][0]) for a in range(n))
        chi = sum((cells[p, s] - 20) ** 2 / 20 for p in range(30) for s in range(shards))
        assert 70 < chi < 170  # 116 degrees of freedom
        assert abs(np.corrcoef(range(n), [place[a][0] * (n // shards) + place[a][1] for a in range(n)])[0, 1]) < 0.08
        order = sorted(range(n), key=place.get)
        assert sum(abs(x - y) == 1 for x, y in zip(order[:-1], order[1:], strict=True)) < 10
    few = spark.range(3, numPartitions=8)
    assert Counter(r.shard for r in sharding.shuffle_into_shards(few, ["id"], shards=2).collect()) == {0: 2, 1: 1}


def test_the_matrix_has_the_law_of_a_permutation():
    draws = Counter(sharding.hypergeometric(random.Random(i), 6, 4, 5) for i in range(20000))
    from math import comb

    for k in range(1, 6):
        assert abs(draws[k] / 20000 - comb(6, k) * comb(4, 5 - k) / comb(10, 5)) < 0.02
    m = sharding.communication_matrix([100000, 0, 7, 50000], [37502, 37502, 37502, 37501], 5)
    assert [sum(r) for r in m] == [100000, 0, 7, 50000] and [sum(c) for c in zip(*m, strict=True)] == [37502, 37502, 37502, 37501]


def test_op5_against_brute_force(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 3000, "x", "<p>a</p>"]
    rows = [(i, f"http://h/{i}\r\nX: y", h, 5) for i, h in enumerate(html)] + [(None, None, "x", 5), (5, "u", "x", 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string, n long").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op5_warc(spark, str(tmp_path)).collect()
    best = {}
    for page_id, _, h, _ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if page_id is None else page_id)
    want, answered = [], set()
    for page_id, _, h, _ in rows:
        # Of rows with the same page_id and payload one is the response.
        own = page_id == best[h or ""] and (page_id, h or "") not in answered
        answered.add((page_id, h or ""))
        want.append((page_id, len((h or "").encode()), warc.digest((h or "").encode()), "response" if own else "revisit", None if own else best[h or ""]))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    small = warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet").coalesce(1), package_bytes=300)
    assert small.count() > 3 and warc.read_archives(small).count() == len(rows)
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


@pytest.mark.parametrize("always64", [False, True])
def test_packages_are_zip_files_and_zip64_is_read(always64):
    out = io.BytesIO()
    z = warc.ZipWriter(out, always64)
    for name, raw in (("a", b"12"), ("dir/é", b"")):
        z.member(name, iter([raw]), len(raw), zlib.crc32(raw))
    z.close()
    raw = out.getvalue()
    assert zipfile.ZipFile(out).read("a") == b"12" and zipfile.ZipFile(out).testzip() is None
    found = warc.members(io.BytesIO(raw), len(raw))
    assert [(m.name, m.size) for m in found] == [("a", 2), ("dir/é", 0)]
    at = warc.data_place(io.BytesIO(raw), found[0])
    assert raw[at : at + 2] == b"12"


def test_foreign_and_broken_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "xyz")
        z.comment = b"PK\x05\x06 comment"
    raw = out.getvalue()
    m = warc.members(io.BytesIO(raw), len(raw))[0]
    at = warc.data_place(io.BytesIO(raw), m)
    assert raw[at : at + m.size] == b"xyz"
    with pytest.raises(warc.BadArchive):
        warc.members(io.BytesIO(b"no archive"), 10)
    with pytest.raises(warc.BadArchive):
        list(warc.package_records(io.BytesIO(raw), len(raw)))
    assert struct.calcsize("<I") == 4


@pytest.mark.parametrize("total", [10**2, 10**5, 10**9, 10**10, 10**12, 10**15])
@pytest.mark.parametrize(("part", "share"), [(16, 1000), (2, 3), (16, 16384)])
def test_the_law_is_exact_at_any_size(total, part, share):
    """Against 80 digits: the lost digits of differences of logarithms of factorials were 1 % at 10 ** 12."""
    good, n = total // part, max(1, total // share)
    mode = (n + 1) * (good + 1) // (total + 2)

    def log_factorial(x):
        if x < 2000:
            return Decimal(math.factorial(x)).ln()
        d = Decimal(x)
        pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899862803482534211706798")
        return d * d.ln() - d + (2 * pi * d).ln() / 2 + 1 / (12 * d) - 1 / (360 * d**3) + 1 / (1260 * d**5) - 1 / (1680 * d**7) + 1 / (1188 * d**9)

    with localcontext() as c:
        c.prec = 80
        comb = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
        for k in {mode, max(0, mode - 3), min(good, n, mode + 3)}:
            want = float((comb(good, k) + comb(total - good, n - k) - comb(total, n)).exp())
            assert sharding.hypergeometric_probability(k, good, total - good, n) == pytest.approx(want, rel=1e-11)


def test_probabilities_add_up_to_one():
    for good, bad, n in ((6, 4, 5), (1, 9, 10), (300, 40, 77), (5, 0, 3), (0, 5, 2)):
        assert sum(sharding.hypergeometric_probability(k, good, bad, n) for k in range(max(0, n - bad), min(good, n) + 1)) == pytest.approx(1, abs=1e-12)


def test_a_payload_that_half_the_pages_share(spark):
    """Rows that share page_id and payload too: one response a payload, whatever the number of copies."""
    rows = [(i, f"http://x/{i}", "same" * 50 if i % 2 else f"own {i}") for i in range(400)] + [(399, "http://x/again", "same" * 50)] * 5 + [(None, None, "same" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    found = warc.read_archives(warc.write_archives(pages)).collect()
    same = [r for r in found if r.payload_bytes == 200]
    assert len(found) == 406 and sum(r.record_type == "response" for r in same) == 1
    assert next(r for r in same if r.record_type == "response").page_id == 399
    assert {r.refers_to for r in same if r.record_type == "revisit"} == {399}


def test_token_files_of_odd_tables(spark):
    """One document is longer than a block; null and repeated ids, repeated rows, clashing columns and an empty table."""
    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(vocabulary)
    rows = [(None, "no id"), (None, None), (3, "twice"), (3, "twice"), (3, "another text"), (1, ""), (2, "a long one " * 750_000), (9, None)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, path string, start int").repartition(3)
    found = token_files.read_token_files(token_files.write_token_files(docs, vocabulary, end_id=0)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for doc_id, text in order:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert max(n for _, _, n, _ in want) > token_files.BLOCK_IDS
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=str) == sorted(want, key=str)
    assert token_files.read_token_files(token_files.write_token_files(docs.where("false"), vocabulary, end_id=0)).count() == 0


def test_archives_of_long_pages_and_of_none(spark):
    rows = [(1, "http://x/1", "é" * 3_000_000), (2, "http://x/2", "é" * 3_000_000), (3, None, None), (None, "http://x/4", "")]
    pages = spark.createDataFrame([(*r, "sha", 1) for r in rows], "page_id long, url string, html string, sha string, n int")
    found = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert found[1].payload_bytes == found[2].payload_bytes == 6_000_000 and (found[1].record_type, found[1].refers_to, found[2].record_type) == ("revisit", 2, "response")
    assert (found[3].record_type, found[None].record_type, found[None].refers_to) == ("response", "revisit", 3)
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0
