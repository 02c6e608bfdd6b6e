import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import exact, numbers, text
from siltstone.operators import audits, metrics, patterns, planner, ranking, relations, selection, transforms
from siltstone.sources import documents, records
from siltstone.sources.shared import folder
from siltstone.streaming import batches


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_case_folding_is_that_of_python(spark):
    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    rows = [(i, "x" + "y".join(chars[i : i + 64])) for i in range(0, len(chars), 64)] + [(-1, "\u039f\u0394\u039f\u03a3 Stra\u00dfe \u0130 \ufb03")]
    got = spark.createDataFrame(rows, "i int, s string").select("s", text.casefold(F.col("s")).alias("f")).collect()
    # Java and Python know slightly different versions of Unicode: new letters can differ, known ones cannot.
    odd = [(a, b) for r in got for a, b in zip(r.s.casefold(), r.f, strict=False) if r.s.casefold() != r.f]
    assert sum(r.s.casefold() != r.f for r in got) <= 8, odd[:5]
    assert got[-1].f == rows[-1][1].casefold()


def test_exact_scalars(spark):
    values = [2.675, 1.005, 0.125, 0.375, 2.5, -0.5, 1e300, float("nan"), None]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(exact.py_round(F.col("v"), 2).alias("x")).collect()]
    assert got[:7] == [round(v, 2) for v in values[:7]] and got[8] is None
    texts = ['{"b": 1, "a": {"d": 2, "c": "\u00e9"}}', '{"a": 1, "a": 2}', '{"a": NaN}', "[1]", '{"a": 1} x', None, "", '{"a": 1e999}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(exact.strict_object("t").alias("s"), exact.lenient_object("t").alias("l")).collect()
    assert [r.s for r in rows[:7]] == ['{"a": {"c": "\u00e9", "d": 2}, "b": 1}', None, None, None, None, None, None]
    assert [r.l for r in rows[:5]] == [rows[0].s, '{"a": 2}', '{"a": null}', None, None]


def test_plans_of_every_fault(spark):
    good = '{"refined_text_instruction": "x", "subtask": "add_object", "image_search": false, "mask": false}'
    cases = {
        good: True, good.replace("false", '"y"', 1): True, good.replace("false", '" "', 1): False, good.replace("false", "true", 1): False, good.replace("false", "null", 1): False,
        good.replace("false", '"false"', 1): True, good.replace("add_object", "add"): False, good.replace('"x"', '"\\u00a0"'): False, good.replace('"x"', "3"): False, good[:-1] + ', "z": 1}': False, "{}": False, None: False,
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", planner.valid(exact.strict_object("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in rows] == list(cases.values())


def test_greedy_walks_against_plain_loops(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        rows = [(i, [f"k{rnd.randrange(25)}" for _ in range(rnd.randint(0, 3))]) for i in range(60)]
        rows += [(60, None), (61, []), (62, ["k1", None, "k1"]), (63, [None])]
        table = spark.createDataFrame(rows, "p int, keys array<string>")
        # In one task, by components, and with components that are decided in rounds.
        got = {r.p: r.accepted for r in selection.first_come(table, "p", "keys", (2_000_000, 40, 3)[seed]).collect()}
        rows = [(p, [k for k in keys or [] if k]) for p, keys in rows]
        seen, want = set(), {}
        for p, keys in rows:
            want[p] = not seen & set(keys)
            if want[p]:
                seen |= set(keys)
        assert got == want


def test_a_long_chain_takes_few_jobs(spark):
    """Each row shares a key with the next: rounds would be 50,000."""
    chain = spark.range(100_000).select(F.col("id").alias("p"), F.array(F.concat(F.lit("k"), F.col("id").cast("string")), F.concat(F.lit("k"), (F.col("id") + 1).cast("string"))).alias("keys"))
    spark.sparkContext.setJobGroup("chain", "chain")
    found = selection.first_come(chain, "p", "keys")
    assert found.where("accepted <> (p % 2 = 0)").count() == 0 and found.count() == 100_000
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_a_large_table_are_walked_apart(spark):
    rows = [(i, [f"c{i % 50}-{(i * 7) % 11}", f"c{i % 50}-{(i * 5) % 11}"]) for i in range(1500)]
    got = {r.p: r.accepted for r in selection.first_come(spark.createDataFrame(rows, "p long, keys array<string>"), "p", "keys", 200).collect()}
    seen = set()
    for p, keys in rows:
        ok = not seen & set(keys)
        seen |= set(keys) if ok else set()
        assert got[p] == ok


def test_diverse_picks_against_a_plain_loop(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        rows = [(rnd.choice("abc"), f"v{rnd.randrange(8)}", str(i)) for i in range(60)]
        df = spark.createDataFrame(rows, "pool string, video string, key string")
        rank = {r.key: r.h for r in df.select("key", numbers.stable_hash(F.concat(F.lit("s-"), F.col("pool")), "key").alias("h")).collect()}
        pools = {p: sorted((r for r in rows if r[0] == p), key=lambda r: (rank[r[2]], r[2])) for p in "bca"}
        want, seen = [], set()
        for new_only in (True, False):
            moved = True
            while len(want) < 20 and moved:
                moved = False
                for p in pools:
                    k = next((i for i, r in enumerate(pools[p]) if not new_only or r[1] not in seen), None)
                    if k is not None and len(want) < 20:
                        r = pools[p].pop(k)
                        want.append(r[2])
                        seen.add(r[1])
                        moved = True
        got = selection.diverse(df, "pool", list("bca"), "video", "key", "s", 20).orderBy("place").collect()
        assert [r.key for r in got] == want and [r.place for r in got] == list(range(20))
    with pytest.raises(selection.TooFew):
        selection.diverse(df, "pool", ["a"], "video", "key", "s", 999)


def test_selection_that_falls_short(spark):
    rows = spark.createDataFrame([("f1", "p"), ("f2", "p"), ("f3", "q")], "fingerprint string, prompt string")
    assert selection.select_exact(rows, 2, "s", "fingerprint", prompt="prompt").count() == 2
    with pytest.raises(selection.TooFew):
        selection.select_exact(rows, 3, "s", "fingerprint", prompt="prompt")
    with pytest.raises(selection.TooFew):
        selection.replay(rows.withColumnRenamed("prompt", "g"), "g", {"p": 1, "q": 2}, "s", "fingerprint")
    assert selection.balanced_counts(11, list("abc")) == {"a": 4, "b": 4, "c": 3}
    with pytest.raises(ValueError):
        selection.pattern_types("img,xyz", {"img": "image"})
    assert selection.consumed(list("aab"), 7, 1) == {"a": 5, "b": 2}


def test_positions_and_ranks_over_many_partitions(spark):
    rows = [(i, "hot" if i % 3 else None, i * 7 % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, g string, o int").repartition(7)
    got = {r.i: r.place for r in ranking.ranked(df, "g", ["o", "i"], "place").collect()}
    for g in ("hot", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    assert ranking.with_positions(df.where("false"), ["i"]).count() == 0


def test_signatures_and_long_phrases(spark):
    texts = spark.createDataFrame([(1, "put a red car there"), (2, "a b c d e f g h i j k"), (3, "x (y)")], "i int, n string")
    marks = spark.createDataFrame([("put a __slot__ there",), ("x (y)",), ("__slot__ b",)], "s string")
    assert sorted((r.i, r.s) for r in patterns.signature_matches(marks, texts, "s", "n", at_once=1).collect()) == [(1, "put a __slot__ there"), (3, "x (y)")]
    phrases = spark.createDataFrame([("b c d e f g h i j",), ("b c d e f g h i z",), ("red",), ("",)], "p string")
    assert sorted((r.i, r.p) for r in relations.phrase_hits(texts, phrases, "i", "n", "p").collect()) == [(1, "red"), (2, "b c d e f g h i j")]


def test_four_way_without_invalid_pairs(spark):
    r = metrics.four_way(spark.createDataFrame([("A", "A"), ("B", "tie")], "a string, b string"), "a", "b").first()
    assert (r.num_pairs, r.four_way_agreement, r.invalid_precision, r.invalid_recall, r.invalid_f1) == (2, 0.5, None, None, None)


def test_steps_and_maps(spark):
    double = transforms.Step(lambda c: c * 2) >> transforms.to_text
    assert one(spark, double(F.lit(4))) == "8"
    with pytest.raises(TypeError):
        transforms.by_type({"string": transforms.to_text}, {"a": "int"})("a")


def test_sinks_leave_all_or_nothing(spark):
    root = folder(spark, "test")
    good = spark.createDataFrame([(1, None)], "a int, b string")
    documents.write_bundle(spark, {"one": good}, f"{root}/x")
    with pytest.raises(FileExistsError):
        documents.write_bundle(spark, {"one": good}, f"{root}/x")
    with pytest.raises(ValueError):
        documents.write_bundle(spark, {"one": good, "ONE": good}, f"{root}/y")
    assert spark.read.json(f"{root}/x/one").columns == ["a", "b"]
    documents.replace_text(spark, f"{root}/t.txt", "a")
    documents.replace_text(spark, f"{root}/t.txt", "b")
    assert documents.read_text(spark, f"{root}/t.txt") == "b" and documents.read_text(spark, f"{root}/none") is None


def test_calls_that_fail(spark):
    def never(prompts):
        raise ValueError("no")

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "k int, p string")
    assert {r.error for r in batches.called(rows, "k", "p", never, retries=0, at_once=2).collect()} == {"ValueError: no"}
    short = batches.called(rows, "k", "p", lambda ps: ps[:1], retries=0, at_once=2).collect()
    assert sorted((r.k, r.answer) for r in short) == [(i, f"p{i}") for i in range(5)]


def test_audits_of_clean_tables_say_nothing(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    assert audits.not_as_expected(rows, rows, "r").count() == 0
    assert audits.repeated(rows, ["key"]).count() == 0
    assert audits.wrong_counts(rows, "key", {"a": 1, "b": 1}, "r").count() == 0
    numbers_ = spark.createDataFrame([("a", 1.0), ("b", None)], "key string, value double")
    assert audits.not_recomputed(numbers_, numbers_, "r").count() == 0
    listed = rows.selectExpr("key as path", "coalesce(value, 'x') as sha256")
    assert records.verify_manifest(listed, listed).count() == 0
