"""Joins that must not make all pairs: very many patterns, and runs of words that very many rows share."""

import random
import re

import pytest

from siltstone.operators import overlap, patterns


def test_signatures_against_regular_expressions(spark):
    rnd = random.Random(1)
    words = ["put", "a", "red", "car", "on", "the", "table", "x.y", "(z)"]
    marks = sorted({" ".join(rnd.choice([*words, "__slot__"]) for _ in range(rnd.randint(1, 5))) for _ in range(150)} | {"__slot__", "__slot____slot__", ""})
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))) for i in range(120)] + [(200, ""), (201, None), (202, "a")]
    want = sorted((i, m) for i, x in texts for m in marks if x is not None and (re.fullmatch(".+?".join(map(re.escape, m.split("__slot__"))), x) if "__slot__" in m else m == x))
    df = spark.createDataFrame(texts, "i int, x string")
    signatures = spark.createDataFrame([(m,) for m in [*marks, None, marks[3]]], "s string")
    for how in ({}, {"at_once": 17}, {"bytes_at_once": 900}):
        assert sorted((r.i, r.s) for r in patterns.signature_matches(signatures, df, "s", "x", **how).collect()) == want


def test_a_hundred_thousand_signatures_in_one_pass(spark):
    signatures = spark.range(100_000).selectExpr("concat('replace item', id, ' with __slot__ now') as s")
    texts = spark.range(20_000).selectExpr("id", "concat('replace item', id * 7, ' with something', if(id % 2 = 0, ' now', '')) as x")
    found = patterns.signature_matches(signatures, texts, "s", "x")
    assert found.count() == sum(1 for i in range(0, 20_000, 2) if i * 7 < 100_000)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def runs(text, n):
    w = re.findall(r"\w+", (text or "").casefold())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("rare", [0, 5, 60, 10_000])
def test_overlap_of_two_texts_against_all_pairs(spark, rare):
    rnd = random.Random(rare)
    passages = [" ".join(f"p{k}w{j}" for j in range(rnd.randint(3, 9))) for k in range(6)]

    def text():
        return " . ".join(rnd.choice([rnd.choice(passages), rnd.choice(passages[:2]), " ".join(f"u{rnd.randrange(400)}" for _ in range(rnd.randint(1, 6)))]) for _ in range(rnd.randint(0, 4)))

    left, right = ([(i, text() if i else None, text()) for i in range(n)] for n in (90, 70))
    want = {(a, b) for a, p, q in left for b, r, s in right if runs(p, 3) & runs(r, 3) and runs(q, 4) & runs(s, 4)}
    found = overlap.paired_overlap(spark.createDataFrame(left, "l int, p string, q string"), spark.createDataFrame(right, "r int, p string, q string"), "l", "r", {"p": 3, "q": 4}, rare)
    links = [(r["left"], r["right"]) for r in found.links.collect()]
    side = {k: [(r[k], r["class"]) for r in rows.collect()] for k, rows in (("left", found.left_classes), ("right", found.right_classes))}
    pairs = {(r.left_class, r.right_class) for r in found.class_pairs.collect()}
    common = [(a, b) for a, c in side["left"] for b, d in side["right"] if (c, d) in pairs]
    assert len(links) + len(common) == len({*links, *common}) and {*links, *common} == want
    assert {r.left: r.n for r in found.partners().collect()} == {a: sum(x == a for x, _ in want) for a in {a for a, _ in want}}
    assert tuple(found.summary().first()) == (len(want), len({a for a, _ in want}), len({b for _, b in want}))
    assert rare or not links


def test_a_common_run_makes_no_row_for_each_pair(spark):
    rows = lambda n, name: spark.range(n).selectExpr(f"id as {name}", "concat('keep the voice of it all ', id) as p", "concat('own', id % 977, ' text', id % 977, ' here', id % 977) as q")
    found = overlap.paired_overlap(rows(5000, "l"), rows(4000, "r"), "l", "r", {"p": 5, "q": 3})
    assert found.class_pairs.count() == 0 and found.links.count() == sum(-(-(5000 - k) // 977) * -(-(4000 - k) // 977) for k in range(977))
    found = overlap.paired_overlap(rows(5000, "l"), rows(4000, "r"), "l", "r", {"p": 5})
    assert found.links.count() == 0 and found.class_pairs.count() == 1 and tuple(found.summary().first()) == (20_000_000, 5000, 4000)
