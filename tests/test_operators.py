import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from siltstone.functions import numbers, text
from siltstone.operators import digests, metrics, ranking, relations
from siltstone.plans import catalog
from siltstone.sources import records
from siltstone.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, text.normalize(F.lit("  Ça-va? L'été_2 "))) == "ça va l été_2"
    assert one(spark, text.ngrams(text.tokens(F.lit("a b a b a")), 2)) == ["a b", "b a"]
    assert one(spark, text.ngrams(text.tokens(F.lit("a")), 2)) == []
    assert one(spark, text.contains_phrase(F.lit("a red car"), F.lit("red"))) and not one(spark, text.contains_phrase(F.lit("a red car"), F.lit("")))
    assert one(spark, text.stem(F.lit("a/b/.c.tar.gz"))) == ".c.tar" and one(spark, text.stem(F.lit("x/.env"))) == ".env"
    assert one(spark, text.pluralize(F.lit("old man"), {"man": "men"})) == "old men" and one(spark, text.pluralize(F.lit("cat"), {})) == "cats"
    assert one(spark, text.template_signature(F.lit("put a red car there"), ["car", "red car"])) == "put a __slot__ there"
    assert one(spark, text.strip_fences(F.lit("```json\n{\"a\": {}}\n```"))) == '{"a": {}}' and one(spark, text.strip_fences(F.lit("no"))) is None
    assert one(spark, text.numbers_after_colons(F.lit("a: 3, b:4.5 c 9"))) == [3.0, 4.5]
    assert one(spark, text.safe_id(F.lit("__a b/c__"))) == "a_b_c" and one(spark, text.is_false_text(F.lit(" None "))) and one(spark, text.collapse(F.lit(" a \n b. "))) == "a b"


def test_number_functions(spark):
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0), 1.0)) == 1.0 and one(spark, numbers.ratio(F.lit(1), F.lit(0), None)) is None
    h = int(hashlib.sha256(b"k").hexdigest()[:8], 16)
    assert one(spark, numbers.hash_choice(F.lit("k"), 7)) == h % 7 and one(spark, numbers.hash_uniform(F.lit("k"))) == h / 2**32
    assert one(spark, numbers.resample_positions(F.lit(6), 3)) == [0, 2, 5] and one(spark, numbers.resample_positions(F.lit(6), 1)) == [0]
    assert one(spark, numbers.align_frames(F.lit(12))) == 9 and one(spark, numbers.lambda_slug(F.lit(0.125))) == "lambda_0125"
    assert one(spark, numbers.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01) and one(spark, numbers.frame_rate(F.lit("1/0"))) is None
    assert tuple(one(spark, numbers.fit_pixels(F.lit(1080), F.lit(1920), 480 * 832))) == (464, 832)


def test_agreement_and_planner_goldens(spark):
    rows = [("a", "A", "A"), ("b", "A", "B"), ("c", "tie", "tie"), ("d", "invalid", "A")]
    r = metrics.agreement(spark.createDataFrame(rows, "id string, h string, j string"), "h", "j").first()
    assert (r.usable, r.coverage, r.exact, r.directional) == (3, 0.75, 2 / 3, 0.5)
    empty = metrics.agreement(spark.createDataFrame([], "h string, j string"), "h", "j").first()
    assert empty.kappa is None and empty.exact is None and empty.coverage == 0
    same = metrics.agreement(spark.createDataFrame([("A", "A")], "h string, j string"), "h", "j").first()
    assert same.kappa == 1.0
    m = metrics.binary_metrics(spark.createDataFrame([], "g int, p int"), "g", "p").first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)


def test_selection_and_bootstrap(spark):
    c = spark.createDataFrame([("a", 0.0, 0.90), ("b", 0.5, 0.95), ("c", 1.0, 0.95)], "candidate string, size double, utility double")
    assert metrics.one_standard_error(c, "utility", "size", 0.01).first().candidate == "b"
    assert metrics.one_standard_error(c, "utility", "size", 0.06).first().candidate == "a"
    scores = spark.createDataFrame([("x", s, i, float((i * 7 + len(s)) % 5)) for s, n in (("p", 3), ("qq", 2)) for i in range(n)], "candidate string, stratum string, case_pos long, score double")
    got = metrics.paired_bootstrap(scores, 100, 17).first().standard_error
    assert got > 0 and got == metrics.paired_bootstrap(scores, 100, 17).first().standard_error
    value = {(r.stratum, r.case_pos): r.score for r in scores.collect()}
    assert got == pytest.approx(plain_bootstrap({"x": {"p": [value["p", i] for i in range(3)], "qq": [value["qq", i] for i in range(2)]}}, 100, 17)["x"])


def plain_bootstrap(strata, draws, seed):
    """Standard errors as the reference takes them: strata is candidate -> stratum -> scores."""
    rnd, means = random.Random(seed), {c: [] for c in strata}
    sizes = {s: len(x) for s, x in sorted(next(iter(strata.values())).items())}
    for _ in range(draws):
        at = {s: [rnd.randrange(n) for _ in range(n)] for s, n in sizes.items()}
        for c, x in strata.items():
            means[c].append(statistics.fmean(statistics.fmean(x[s][i] for i in at[s]) for s in sizes))
    return {c: statistics.stdev(m) for c, m in means.items()}


def test_bootstrap_over_one_stream(spark, monkeypatch):
    rnd = random.Random(5)
    strata = {c: {s: [rnd.random() for _ in range(n)] for s, n in (("p", 37), ("qq", 1), ("r", 64))} for c in "ab"}
    rows = [(c, s, i, v) for c, x in strata.items() for s, y in x.items() for i, v in enumerate(y)]
    scores = spark.createDataFrame(rows, "candidate string, stratum string, case_pos long, score double")
    want = plain_bootstrap(strata, 70, 9)
    for bound in (metrics.STREAM_SCORES, 1):
        monkeypatch.setattr(metrics, "STREAM_SCORES", bound)
        got = {r.candidate: r.standard_error for r in metrics.paired_bootstrap(scores, 70, 9).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_the_registered_bootstrap_takes_all_draws(spark, tmp_path):
    sizes = [(i, 40 * i * (i % 3 + 1) + 200) for i in range(12)]
    labels = [(i, i % 4 // 2, i % 5 // 4) for i, _ in sizes]
    spark.createDataFrame(sizes, "doc_id long, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    by = lambda f: {str(t): [float(f(i)) for i, _, toxic in labels if toxic == t] for t in (0, 1)}
    want = plain_bootstrap({"label": by(lambda i: labels[i][1]), "length": by(lambda i: sizes[i][1] > 1000)}, 10_000, 20260916)
    got = {r.candidate: r.standard_error for r in catalog.agg24_paired_bootstrap(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_ranking(spark):
    pos = ranking.with_positions(spark.range(8).select((F.lit(8) - F.col("id")).alias("k")), ["k"])
    assert sorted((r.k, r._pos) for r in pos.collect()) == [(k + 1, k) for k in range(8)]
    for total, count, want in ((8, 4, [1, 3, 5, 7]), (8, 2, [2, 6]), (2, 4, [0, 0, 1, 1])):
        rows = spark.range(total).withColumnRenamed("id", "p")
        assert [r.p for r in ranking.evenly_spaced_rows(rows, "p", total, count).orderBy("slot").collect()] == want
    groups = spark.createDataFrame([(f"v{i % 10}", i) for i in range(30)], "video string, row int")
    split = ranking.grouped_split(groups, "video", 0.2)
    assert {r.split: (r["n"], r.v) for r in split.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("video").alias("v")).collect()} == {"train": (24, 8), "eval": (6, 2)}
    ranks = [ranking.contiguous_rank(F.col("id"), F.lit(10), 4)]
    assert [r[0] for r in spark.range(10).select(*ranks).collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    names = spark.createDataFrame([("f10.png",), ("f9.png",), ("f1.png",)], "n string")
    assert [r.n for r in names.orderBy(ranking.natural_key(F.col("n"))).collect()] == ["f1.png", "f9.png", "f10.png"]
    last = ranking.last_wins(spark.createDataFrame([("a", 1, None), ("a", 2, "y"), ("b", 1, "z")], "k string, p int, v string"), ["k"], "p")
    assert sorted(map(tuple, last.collect())) == [("a", 2, "y"), ("b", 1, "z")]


def test_relations(spark):
    df = spark.createDataFrame([("x", ["r", "s"], 1), ("y", None, 2)], "k string, tags array<string>, n int")
    assert [r.m for r in df.select(relations.matching_rule(df, "tags=r,n=2;k=y,none=1;tags=s").alias("m")).collect()] == [2, None]
    with pytest.raises(ValueError):
        relations.exclude_rules("k")
    todo = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "c", "r")], "idx int, v string, prompt string")
    done = spark.createDataFrame([(1, "a", "p", 0, 5), (2, "changed", "q", 1, 6), (9, "c", "r", 2, 6), (None, "c", "r", 2, 7), (1, "a", "p", 3, 8), (1, "new", "p", 4, 9)], "idx int, v string, prompt string, pos int, score int")
    got = relations.resume_by_identity(todo, done, "idx", ["v", "prompt"], "pos", "score")
    assert {r.idx: r.score for r in got.collect()} == {1: 8, 2: None, 3: 7}


def test_strict_and_resumable_lines(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a": 1}\n\n{"a": 1, "a": 2}\n{"a": NaN}\n[1]\n{"a": 1} x\n{"b": {"c": 1}}\n{"cut": ')
    good, bad = records.strict_jsonl(spark, str(f))
    assert sorted(r.line for r in good.collect()) == [1, 7] and sorted(r.line for r in bad.collect()) == [3, 4, 5, 6, 8]
    _, bad = records.resumable_jsonl(spark, str(f))
    assert sorted(r.line for r in bad.collect()) == [3, 4, 5, 6]
    good, errors = records.collecting_jsonl(spark, str(f), "a int")
    # Of a key that stands twice the last value counts here, and NaN is read; a list, text after the end and a cut line are errors.
    assert sorted(str(r.a) for r in good.collect()) == ["1", "2", "None", "None"] and errors.count() == 3


def test_documents_and_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"10": {"p": "x"}, "9": {"p": "y"}}))
    assert [r.id for r in records.json_map_rows(spark, str(tmp_path / "m.json"), "p: string").collect()] == ["9", "10"]
    (tmp_path / "c.csv").write_text('﻿a,b\n1,"x\ny"\n')
    assert [tuple(r) for r in records.metadata_csv(spark, str(tmp_path / "c.csv"), "a int, b string").collect()] == [(1, "x\ny")]


def test_manifests(spark, tmp_path):
    root = tmp_path / "bundle"
    (root / "d").mkdir(parents=True)
    (root / "a").write_text("1")
    (root / "d" / "b").write_text("2")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    (tmp_path / "sums").write_text(f"{sha(b'1')}  a\n{sha(b'x')}  d/b\n{sha(b'1')}  gone\nbad line\n{sha(b'1')}  ../up\n{sha(b'1')}  a\n")
    listed, bad = records.read_manifest(spark, str(tmp_path / "sums"))
    assert sorted(r.rule for r in bad.collect()) == ["duplicate_path", "format", "unsafe_path"]
    found = digests.file_manifest(spark, str(root))
    rules = {r.path: r.rule for r in records.verify_manifest(listed.where("path not like '..%'").distinct(), found).collect()}
    assert rules == {"d/b": "changed", "gone": "missing"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "é"), ("b", 3.0, None)], "k string, v double, w string")
    records.write_jsonl(df, str(tmp_path / "o"), create_only=True)
    with pytest.raises(Exception, match="exists"):
        records.write_jsonl(df, str(tmp_path / "o"), create_only=True)
    assert '"w":null' in "".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))
    assert [tuple(r) for r in records.with_average_row(df, "k", ["v"]).collect()][-1] == ("Average", 2.0, None)


def test_pulls_in_one_run_or_many_take_the_same(spark, tmp_path):
    """Files come one by one: all in one run, or with a stop after each. Repeated keys, a null group and null keys."""
    rnd = random.Random(2)
    schema = "k long, g string, v int"
    files = [[(rnd.choice([None, *range(60)]), rnd.choice(["a", "a", "b", None]), rnd.randrange(3)) for _ in range(30)] for _ in range(4)]
    taken = {}
    for way in ("once", "stops"):
        for i, rows in enumerate(files):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / way / "in"))
            if way == "stops" or i == len(files) - 1:
                stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / way / "in"))
                incremental.bounded_pull(stream, "g", "k", 12, str(tmp_path / way / "out"), str(tmp_path / way / "state"))
        taken[way] = sorted(map(tuple, spark.read.parquet(str(tmp_path / way / "out")).collect()), key=str)
    assert taken["once"] == taken["stops"]
    want, have = [], {}
    for rows in files:
        order = sorted((r for r in rows if r[0] is not None), key=lambda r: hashlib.sha256(f"pull\x1f{r[0]}".encode()).hexdigest())
        for k, g, _ in order:
            mine = have.setdefault(g, [])
            if k not in mine and len(mine) < 12:
                mine.append(k)
                want.append((k, g))
    assert sorted(((k, g) for k, g, _ in taken["once"]), key=str) == sorted(want, key=str)


def test_incremental_runs_take_up_where_they_ended(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "k string, g string"
    run = lambda: incremental.run_available(spark.readStream.schema(schema).json(source), out, check, key="k")
    spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "a")], schema).write.mode("append").json(source)
    run()
    spark.createDataFrame([("2", "a"), ("3", "b")], schema).write.mode("append").json(source)
    run()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]
    pulled, check2 = str(tmp_path / "pulled"), str(tmp_path / "check2")
    incremental.bounded_pull(spark.readStream.schema(schema).json(source), "g", "k", 1, pulled, check2)
    assert spark.read.parquet(pulled).count() == 2
    incremental.run_routed(spark.readStream.schema(schema).json(source), lambda df: df, F.col("g") == "a", str(tmp_path / "g"), str(tmp_path / "b"), str(tmp_path / "check3"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 4 and spark.read.parquet(str(tmp_path / "b")).count() == 1
