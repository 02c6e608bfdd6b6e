import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontamination, line_dedup, near_dup, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def edited(rnd, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = "zz" + str(rnd.randrange(10**6))
    return " ".join(w)


def runs(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def exact(a, b):
    both = [k for k in a if k in b]
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in both)


def brute_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    bags = [runs(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and exact(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    low = {}
    for doc_id, t in rows:
        r = find(texts.index(t or ""))
        key = (doc_id is not None, doc_id or 0)
        low[r] = min(low.get(r, (True, 1 << 60)), key)
    return {(d, t): (low[find(texts.index(t or ""))][1] if low[find(texts.index(t or ""))][0] else None) for d, t in rows}


def corpus(seed):
    rnd = random.Random(seed)
    rows = [sentence(rnd, rnd.randint(1, 120)) for _ in range(60)]
    base = sentence(rnd, 150)
    rows += [edited(rnd, base, k % 6) for k in range(60)]
    rows += [edited(rnd, t, 1) for t in rows[:25]] + rows[:10] + ["a b", "a b", "", None, " ", "the same run " * 60, "the same run " * 80]
    rnd.shuffle(rows)
    return list(enumerate(rows)) + [(None, rows[3]), (3, rows[3])]


@pytest.mark.parametrize("block", [1000, 7])
def test_near_duplicate_classes_against_brute_force(spark, block):
    rows = corpus(block)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, label int")
    got = near_dup.near_duplicates(docs, block=block).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    assert {(r.doc_id, r.text): r.class_id for r in got} == want
    kept = near_dup.without_near_duplicates(docs, block=block)
    assert kept.columns == ["doc_id", "text", "class_id", "label"] and kept.count() == len({(v is None, v) for v in want.values()})


def test_large_buckets_of_related_texts_are_dealt_again(spark):
    # All texts share most of one frame: large buckets of many classes.
    rnd = random.Random(31)
    frame = [sentence(rnd, 6) for _ in range(10)]
    rows = []
    for k in range(40):
        t = " ".join(f if rnd.random() < 0.8 else sentence(rnd, 6) for f in frame)
        rows += [t, edited(rnd, t, 1)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (5, 20):
        got = {(r.doc_id, r.text): r.class_id for r in near_dup.near_duplicates(docs, block=block).collect()}
        assert got == brute_classes(rows)


def test_of_rows_that_share_id_and_text_the_same_stays(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (2, "a b", "z"), (None, None, "n")], "doc_id long, text string, lang string")
    kept = near_dup.without_near_duplicates(docs).collect()
    assert len(kept) == 2 and {tuple(r) for r in kept} == {tuple(r) for r in near_dup.without_near_duplicates(docs.orderBy(F.desc("lang"))).collect()}


def test_signatures_estimate_the_probability_jaccard_and_do_not_depend_on_the_batch():
    a = Counter({i: 1 + i % 3 for i in range(100)})
    b = Counter({i: 1 + i % 2 for i in range(20, 120)})
    code = lambda c: (near_dup.mix(np.array(sorted(c), np.uint64)), np.array([c[k] for k in sorted(c)]))
    (ha, ca), (hb, cb) = code(a), code(b)
    s = near_dup.signatures(np.concatenate([ha, hb]), np.concatenate([ca, cb]), np.array([0, 100, 200]), 4096)
    assert abs((s[0] == s[1]).mean() - exact(a, b)) < 0.03
    oa, ob = np.argsort(ha), np.argsort(hb)
    assert abs(near_dup.probability_jaccard(ha[oa], ca[oa], hb[ob], cb[ob]) - exact(a, b)) < 1e-9
    alone = near_dup.signatures(ha, ca, np.array([0, 100]), 4096)
    assert (alone[0] == s[0]).all()
    # A run that never stops early gives the same registers as the early end.
    assert near_dup.signatures(ha[:0], ca[:0], np.array([0, 0]), 8).tolist() == [[0] * 8]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (95, 95)]
    got = {r.node: r.label for r in near_dup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def passage(rnd, lines=8):
    return "\n".join(sentence(rnd, 9) + "." for _ in range(lines))


def test_repeated_passages_go_and_everything_else_stays(spark):
    rnd = random.Random(4)
    p = [passage(rnd) for _ in range(6)] + [" ".join(sentence(rnd, 8) + "." for _ in range(9))]
    own = [[passage(rnd, 3) for _ in range(3)] for _ in range(40)]
    rows = [(i, "\n".join([o[0], p[i % 7], o[1], o[2]])) for i, o in enumerate(own)]
    rows += [(100, None), (101, ""), (102, "one line"), (103, rows[0][1]), (104, "x. " * 30000), (None, "lone"), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "k", 2) for i, t in rows], "doc_id long, text string, found string, n_lines int")
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(rows)
    text = {}
    for r in got:
        assert text.setdefault(r.doc_id, r.text) == r.text
    words = lambda t: (t or "").split()
    hold = lambda t, x: " ".join(words(x)) in " ".join(words(t))
    whole = 0
    for k in range(7):
        holders = [i for i in range(40) if hold(text[i], p[k])]
        assert k in holders
        whole += len(holders) - 1
    assert whole <= 1
    for i in range(40):
        assert hold(text[i], own[i][0].rsplit("\n", 1)[0]) and hold(text[i], own[i][2])
    assert text[100] is None and text[101] == "" and text[102] == "one line" and text[103] == "" and text[None] == "lone"
    assert line_dedup.line_dedup(docs.where("false")).count() == 0


@pytest.mark.parametrize("lines,per_line", [(1, 54), (2, 27), (3, 18), (4, 14), (5, 11), (6, 9), (31, 2), (61, 1), (240, 1)])
def test_repeated_passages_of_any_line_length_go(spark, lines, per_line):
    rnd = random.Random(lines)
    own, shared = [], []
    for _ in range(40):
        p = "\n".join(sentence(rnd, per_line) + "." for _ in range(lines))
        for _ in range(2):
            own.append((passage(rnd, 2), passage(rnd, 2)))
            shared.append(p)
    rows = [(i, f"{a}\n{p}\n{b}") for i, ((a, b), p) in enumerate(zip(own, shared, strict=True))]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (a, b) in enumerate(own):
        assert got[i] == (f"{a}\n{b}" if i % 2 else rows[i][1])


def test_runs_inside_lines_and_short_copies_go(spark):
    rnd = random.Random(6)
    p, q = sentence(rnd, 51), sentence(rnd, 50)
    a, b, c, d = (sentence(rnd, 9) for _ in range(4))
    rows = [(1, f"{a} {p} {b}"), (2, f"{c} {p} {d}"), (3, f"{a} {q} {b}"), (4, f"{d} {q} {a}"), (5, "One line."), (6, "One line."), (7, f"{c}. One line. {b}"), (8, p), (9, sentence(rnd, 20)), (10, " ")]
    rows += [(11, rows[8][1]), (12, f"{b}. {c}. {rows[8][1]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed_lines, r.n_removed_words) for r in line_dedup.line_dedup(docs).collect()}
    want = {i: (t, 0, 0) for i, t in rows} | {2: (f"{c} {d}", 0, 51), 6: ("", 1, 2), 8: ("", 1, 51), 11: ("", 1, 20)}
    assert got == want


LINE = re.compile(rb"\n[\x20\x09-\x0D]*|[.!?][\x20\x09-\x0D]+")


def test_lines_join_to_the_text():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab.!? \n\té") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    want = []
    for t in texts:
        raw = t.encode()
        ends = [m.end() for m in LINE.finditer(raw)]
        want.append(ends + [len(raw)] * bool(raw and (not ends or ends[-1] != len(raw))))
        assert line_dedup.line_ends(raw) == want[-1]
    raw, offsets = line_dedup.buffer(pa.array(texts))
    ends, first = line_dedup.line_table(raw, offsets)
    assert [(ends[a:b] - o).tolist() for a, b, o in zip(first[:-1], first[1:], offsets, strict=False)] == want


def test_hash_collisions_are_not_removed():
    found = [{"words": 0, "size": 2, "begins": [0], "body": b"other.\nlines."}, {"words": 1, "size": 1, "begins": [0, 1], "body": b"x"}]
    raw = b"some.\nlines."
    assert line_dedup.cleaned(raw, line_dedup.line_ends(raw), found) == (None, 0, 0)


def brute_passages(texts):
    """What is left of each text: all equal runs of lines, of words in a line, and whole texts are looked at, in order."""
    seen, left = {}, []
    for d, t in enumerate(texts):
        raw, gone = t.encode(), set()
        ends = [0, *line_dedup.line_ends(raw)]
        lines = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        runs = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)]
        places = []
        for i, j in runs:
            n = sum(len(x.split()) for x in lines[i:j])
            if (j - i >= 2 and n >= 12) or (i == 0 and j == len(lines) and n):
                places.append((("lines", *(x.strip() for x in lines[i:j])), ends[i], ends[j]))
        for i, line in enumerate(lines):
            w = [0, *line_dedup.word_ends(line)]
            for k in range(len(w) - 51):
                places.append((("words", *line[w[k] : w[k + 51]].split()), ends[i] + w[k], ends[i] + w[k + 51]))
        for key, a, b in sorted(places, key=lambda x: x[1]):
            if seen.setdefault(key, (d, a)) != (d, a):
                gone |= set(range(a, b))
        left.append(bytes(x for k, x in enumerate(raw) if k not in gone).decode())
    return left


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [sentence(rnd, n) + rnd.choice([".", "", "!"]) for n in (1, 1, 2, 3, 5, 8, 9, 12, 12, 20, 40, 52, 60, 70)] + ["la " * 130 + "la"]
    blanks = ["\n", " \n", "\n\n", " "]
    texts = []
    for _ in range(70):
        texts.append("".join(rnd.choice([rnd.choice(pool), sentence(rnd, 4) + "."]) + rnd.choice(blanks) for _ in range(rnd.randint(0, 7))))
    texts += texts[:5] + [pool[-1] + " " + pool[-1], "", "\n \n", sentence(rnd, 2), "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert got == dict(enumerate(brute_passages(texts)))


def brute_hits(docs, items):
    out = {}
    for d, text in docs:
        w = WORD.findall(text or "")
        for k, item in items:
            v = WORD.findall(item or "")
            if not v or not w:
                continue
            best = 0
            a = runs(item)
            for s in range(max(1, len(w) - len(v) + 1)):
                b = runs(" ".join(w[s : s + len(v)]))
                both = sum((a & b).values())
                best = max(best, both / (a.total() + b.total() - both))
            if best >= 0.8:
                out[d, k] = best
    return out


def test_contaminated_documents_against_brute_force(spark):
    rnd = random.Random(8)
    items = [(k, sentence(rnd, rnd.randint(15, 59))) for k in range(25)] + [(90, "tiny"), (91, None), (92, "")]
    docs = [(i, sentence(rnd, rnd.randint(1, 400))) for i in range(40)]
    for i in range(40, 90):
        k, t = items[i % 25]
        t = edited(rnd, t, 1) if i % 3 == 0 and len(t.split()) > 45 else t
        docs.append((i, f"{sentence(rnd, rnd.randint(1, 300))}\n{t} {sentence(rnd, rnd.randint(1, 90))}"))
    docs += [(200, items[3][1]), (201, None), (202, ""), (203, "a tiny b"), (None, items[4][1])]
    table = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in ({}, {"items_a_pass": 10}, {"bytes_a_pass": 1500}):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(table, bench, **size).collect()}
        want = brute_hits(docs, items)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = decontamination.decontaminate(table, bench)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.contaminated(table, bench.where("false")).count() == 0
    assert decontamination.decontaminate(table.where("false"), bench).count() == 0


def test_documents_shorter_than_an_item_against_brute_force(spark):
    rnd = random.Random(12)
    items = [(k, sentence(rnd, 15 + k)) for k in range(45)]
    docs = []
    for k, t in items:
        w = t.split(" ")
        docs += [(100 * k + 10 * a + b, " ".join(w[a : len(w) - b])) for a in range(4) for b in range(8)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_hits(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_the_multi_index_finds_every_fingerprint_in_the_radius():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(1 << 30)}" for _ in range(20)) for _ in range(12)]
    index = decontamination.Index(list(range(12)), texts)
    (own, *_), = index.by_length.values()
    prints = []
    for p in own.tolist():
        for d in range(0, 24):
            prints.append(p ^ int(sum(1 << int(b) for b in rng.choice(64, d, replace=False))))
    prints = np.array(prints, np.uint64)
    got = {(int(w), i) for near, i, _ in index.candidates(20, prints) for w in near}
    want = {(w, i) for i, p in enumerate(own) for w in np.flatnonzero(np.bitwise_count(prints ^ p) <= decontamination.RADIUS).tolist()}
    assert got == want


def test_two_thousand_items_against_brute_force():
    rnd = random.Random(21)
    items = [sentence(rnd, rnd.randint(3, 60)) for _ in range(2000)] + [sentence(rnd, 400)]
    texts = [sentence(rnd, rnd.randint(1, 200)) for _ in range(40)]
    for k in range(120):
        w = items[(k * 17) % 2001].split(" ")
        cut = w[rnd.randint(0, 1 + len(w) // 20) : len(w) - rnd.randint(0, 1 + len(w) // 20)]
        texts.append(" ".join(cut) if k % 2 else f"{sentence(rnd, rnd.randint(0, 90))} {' '.join(w)} {sentence(rnd, 30)}")
    holders = {}
    for k, t in enumerate(items):
        for r in runs(t):
            holders.setdefault(r, set()).add(k)
    want = {}
    for t, text in enumerate(texts):
        near = sorted({k for r in runs(text) for k in holders.get(r, ())} | {k for k, x in enumerate(items) if len(x.split()) < 5 and x in text})
        want |= {(t, k): v for (_, k), v in brute_hits([(t, text)], [(k, items[k]) for k in near]).items()}
    index = decontamination.Index(list(range(2001)), items)
    got = {(t, k): v for t, k, v, *_ in decontamination.matches(pa.array(texts), index)}
    assert len(want) >= 110 and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_long_texts_are_searched_beyond_one_run():
    rnd = random.Random(5)
    item = sentence(rnd, 30)
    text = "word " * 99_990 + item + " word" * 200
    index = decontamination.Index([1], [item])
    assert [(t, i, v) for t, i, v, *_ in decontamination.matches(pa.array(["x", text]), index)] == [(1, 0, 1.0)]


def test_registered_queries_have_the_columns(spark, tmp_path):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    classes = {r.doc_id: r.class_id for r in queries.op8_near_dup(spark, str(tmp_path)).collect()}
    assert classes == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id for r in queries.op10_decontamination(spark, str(tmp_path)).collect()} == {1, 2}
    assert queries.op7_line_dedup(spark, str(tmp_path)).count() == 3


def test_a_family_of_a_template_is_dealt_by_prefixes(spark):
    """Pages of one template that differ in a part of their own, at 0.76: what is rare is that part, so hardly any two meet."""
    rnd = random.Random(8)
    template = [f"w{i}" for i in range(160)]
    texts = [" ".join(template + [f"own{rnd.getrandbits(40)}" for _ in range(25)]) for _ in range(300)]
    copy = texts[0].split()
    copy[170] = "other"
    texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(near_dup._keys())
    members = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label"), "_id", "_k1", "_k2")
    dealt = near_dup._by_prefixes(members, docs.select("_id", "_k1", "_k2", "text"), 0.8)
    # All pairs would be 45,150.
    meets = [set(r.n) for r in dealt.groupBy("bucket").agg(F.collect_list("node").alias("n")).collect()]
    assert any({0, 300} <= x for x in meets)
    assert sum(len(x) * (len(x) - 1) // 2 for x in meets) < 4000


def test_shares_bound_the_similarity():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        n = rnd.integers(1, 12, 2)
        a, b = (np.sort(rnd.choice(14, k, replace=False)).astype(np.uint64) for k in n)
        x, y = (rnd.integers(1, 30, k) for k in n)
        p, q = (float(w[np.isin(own, other)].sum() / w.sum()) for w, own, other in ((x, a, b), (y, b, a)))
        assert near_dup.probability_jaccard(a, x, b, y) <= (p * q / (p + q - p * q) if p and q else 0) + 1e-9


def test_line_dedup_of_odd_tables(spark):
    passage = "one two three four five six seven\neight nine ten eleven twelve thirteen\n"
    long = "\n".join(f"line {i} of a very long text" for i in range(30_000))
    rows = [(1, passage + "first"), (2, "second\n" + passage), (2, "second\n" + passage), (None, passage + "none"), (4, None), (5, ""), (6, " \n"), (7, long), (8, long)]
    docs = spark.createDataFrame([(*r, "f", 1, "n") for r in rows], "doc_id long, text string, found string, _id int, n_lines string").repartition(3)
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    # The null id comes first and keeps its passage; both rows of document 2 lose it; the later copy is emptied.
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(None, passage + "none"), (1, "first"), (2, "second\n"), (2, "second\n"), (4, None), (5, ""), (6, " \n"), (7, long), (8, "")], key=str)
    assert {(r.found, r._id, r.n_lines) for r in out.collect()} == {("f", 1, "n")}
    empty = line_dedup.without_repeats(docs.where("false"))
    assert empty.columns == docs.columns and empty.count() == 0
