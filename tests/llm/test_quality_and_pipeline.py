import math
import random
import re
from collections import Counter

import xxhash

import corpus_pipeline
from siltstone.llm import packing, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def long_hash(word, seed=42):
    x = xxhash.xxh64_intdigest(word.encode(), seed=seed & (1 << 64) - 1)
    return x - (1 << 64) if x >> 63 else x


def buckets(words, n):
    return [long_hash(w) % n for w in words] + [long_hash(b, long_hash(a)) % n for a, b in zip(words, words[1:], strict=False)]


def verdicts(rows, trusted, n=quality.N_BUCKETS):
    raw, target = Counter(), Counter()
    for i, t in rows:
        g = buckets(WORD.findall(t or ""), n)
        raw.update(g)
        if i in trusted:
            target.update(g)
    part = lambda c, b: math.log((c[b] + quality.SMOOTHING) / (c.total() + quality.SMOOTHING * n))
    out = []
    for i, t in rows:
        g = buckets(WORD.findall(t or ""), n)
        score = sum(part(target, b) - part(raw, b) for b in g) / len(g) if g and target else (0.0 if g else None)
        c = base_counts(t)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        out.append((i, *c, failed, not failed and score is not None and score >= quality.THRESHOLD, score))
    return out


def rows_of(rnd):
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(80)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rnd.randint(15, 80))) for i in range(80)]
    rows += [(i, " ".join(w.upper() + "$$$" for w in text(60).split())) for i in range(80, 100)]
    repeated = text(9)
    rows += [(100, f"{repeated} {text(5)} {repeated} {text(20)}"), (101, "a\n\na\n \nb\na"), (102, None), (103, ""), (104, "\x1f\x0b  x"), (None, text(30)), (3, rows[3][1])]
    return [*rows, (105, "a b " * 20000)]


def check(spark, folder, rows, trusted):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, score string, _r string")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in trusted] + [(None, 1, 0), (1, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = [tuple(r) for r in queries.op1_quality(spark, str(folder)).collect()]
    want = verdicts(rows, set(trusted))
    key = lambda r: (r[0] is None, r[0] or 0, str(r[:8]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:8] for r in got] == [r[:8] for r in want]
    assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip([r[8] for r in got], [r[8] for r in want], strict=True))
    return want


def test_op1_against_brute_force(spark, tmp_path):
    want = check(spark, tmp_path, rows_of(random.Random(1)), list(range(0, 80, 2)))
    assert {r[7] for r in want} == {True, False}


def test_without_trusted_documents_only_base_rules_decide(spark, tmp_path):
    check(spark, tmp_path, rows_of(random.Random(2)), [])


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality(docs, docs.select("doc_id")).count() == 0


def test_ids_beyond_the_broadcast_bound_are_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "a")], "doc_id long, text string")
    before = quality.log_ratios(docs, docs.where("doc_id < 3")).first().ratios
    monkeypatch.setattr(quality, "BROADCAST_IDS", 1)
    assert quality.log_ratios(docs, docs.where("doc_id < 3")).first().ratios == before


def test_pipeline_keeps_clean_documents_once_and_packs_them(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    text = lambda n: ". ".join(" ".join(word() for _ in range(10)) for _ in range(n)) + "."
    clean = [(i, text(rnd.randint(4, 12))) for i in range(60)]
    item = " ".join(word() for _ in range(30))
    rows = [*clean, (70, clean[5][1]), (71, f"{text(5)} {item}. {text(4)}"), (72, "too short"), (73, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
    kept = verdicts(rows, set(range(0, 60, 3)))
    # The copy is emptied by line removal, and goes.
    want = {r[0] for r in kept if r[7]} - {70, 71}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert {r.doc_id for r in got} == want and texts == {i: t for i, t in clean if i in want}
    assert packing.CAPACITY >= max(r.offset + r.length for r in got)


def test_pipeline_of_odd_tables(spark, tmp_path):
    rnd = random.Random(10)
    # Few different words, so that trusted and other documents are alike.
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    text = lambda: ". ".join(" ".join(rnd.choice(vocabulary) for _ in range(12)) for _ in range(5)) + "."
    texts = [text() for _ in range(8)]
    # Nulls in every column, rows that stand twice, ties, a very long text, and columns named like those of the operators.
    rows = [(i, t, None, f"s{i}", None, 1, "b") for i, t in enumerate(texts)] + [(0, texts[0], None, "s0", None, 1, "b"), (0, texts[0], "zz", "other", 3, None, None), (None, text(), None, None, None, None, None)]
    rows += [(50, None, None, None, None, None, None), (51, "", "en", "s", 0, 1, "c"), (52, " \n", "en", "s", 2, 1, "c"), (53, " ".join(text() for _ in range(300)), "en", "s", 9, 1, "c")]
    kinds = "doc_id long, text string, lang string, found string, n_lines int, _id int, bands string"
    docs = spark.createDataFrame(rows, kinds)
    folder = tmp_path / "odd"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*((i, 1, None) for i in (*range(8), 53)), (None, None, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, texts[3])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(folder))
        assert out.columns == docs.columns, name
    left = [(r.doc_id, bool(r.text)) for r in out.collect()]
    assert {i for i, t in left if t} == {0, 1, 2, 4, 5, 6, 7, 53, None} and all(t for _, t in left)
    assert all(n == 1 for n in {i: sum(x == (i, True) for x in left) for i, t in left if t}.values())
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in left}
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
