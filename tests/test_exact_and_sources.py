"""Exact arithmetic, scores in prose, and files: against Python's own results."""

import io
import math
import os
import random
import struct
import tarfile
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import judging
from siltstone.operators.exact_sums import exact_statistics, exact_sums, limbs
from siltstone.plans import files
from siltstone.sources import documents, records, tar


def any_double(rnd):
    while True:
        x = struct.unpack("<d", rnd.randbytes(8))[0]
        if math.isfinite(x):
            return x


def test_limbs_are_exact(spark):
    rnd = random.Random(1)
    values = [any_double(rnd) for _ in range(1500)] + [5e-324, -5e-324, 2.225e-308, 1.7976931348623157e308, 1.0, -0.0, 0.1]
    values += [2.0**k * s for k in range(-1074, 1024, 7) for s in (1, -1)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 13)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for r in df.select("x", limbs(F.col("x")).alias("l")).collect():
        assert sum(Fraction(p.part) * Fraction(2) ** (26 * p.at - 1074) for p in r.l) == Fraction(r.x)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_sums_are_rounded_once(spark, partitions):
    rnd = random.Random(2)
    rows = []
    for g in range(60):
        for _ in range(rnd.randint(1, 80)):
            x = rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-300, 290) if g % 2 else rnd.choice([1e16, 1.0, -1e16, 0.1, 5e-324, 1e-30])
            rows += [(g or None, x)] + [(g or None, -x)] * (rnd.random() < 0.4)
    df = spark.createDataFrame(rows, "g int, x double").repartition(partitions)
    want = {}
    for g, x in rows:
        want.setdefault(g, []).append(x)
    assert {r.g: (r.n, r.total) for r in exact_sums(df, ["g"], "x").collect()} == {g: (len(v), math.fsum(v)) for g, v in want.items()}


def test_odd_values_and_whole_tables(spark):
    rows = [("a", None), ("a", math.nan), ("b", math.inf), ("b", 1.0), ("c", math.inf), ("c", -math.inf), ("d", 1.7e308), ("d", 1.7e308), ("e", -math.inf), ("f", 0.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    found = {r.g: (r.n, r.total) for r in exact_sums(df, ["g"], "x").collect()}
    assert found["a"] == (0, None) and found["b"] == (2, math.inf) and found["c"] == (2, None)
    assert found["d"] == (2, math.inf) and found["e"] == (1, -math.inf) and found["f"] == (1, 0.0)
    assert [tuple(r) for r in exact_sums(df.where("g > 'f'"), [], "x").collect()] == [(0, None)]


def test_statistics_of_a_hot_group(spark):
    rnd = random.Random(3)
    values = [round(rnd.uniform(900, 500_000), 2) for _ in range(3000)]
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", x) for i, x in enumerate(values)], "g string, x double").repartition(5)
    for r in exact_statistics(df, ["g"], "x").collect():
        v = [x for i, x in enumerate(values) if ("hot" if i % 3 else f"k{i % 7}") == r.g]
        mean = math.fsum(v) / len(v)
        assert (r.n, r.mean, r.variance) == (len(v), mean, math.fsum((x - mean) * (x - mean) for x in v) / (len(v) - 1))


@pytest.mark.parametrize(
    ("said", "score"),
    [
        ("Visual Quality: 3", 3), ("- **Visual Quality** (0-3): **2**", 2), ("2. visual quality： [1] fine", 1), ("> # VISUAL QUALITY - good: `0`", 0),
        ("Visual Quality: 2-3", None), ("Visual Quality: 4", None), ("Visual Quality: 12", None), ("Visual Quality: 3rd", None), ("Visual Quality: 2.5", 2),
        ("The Visual Quality: 3", None), ("Visual Qualitys: 3", None), ("Visual Quality 3", None), ("Visual Quality: high: 2", 2), ("Visual Quality:\n\n  **1**", 1),
        ("Visual Quality: none\nVisual Quality: 3", 3), ("x\nVisual Quality: 1\nVisual Quality: 3", 1), ("", None), (None, None),
    ],
)
def test_scores_in_prose(spark, said, score):
    df = spark.createDataFrame([(said,)], "said string")
    assert df.select(judging.axis_score(F.col("said"), "Visual Quality")).first()[0] == score


def test_totals_in_prose(spark):
    lines = "\n".join(f"{label}: 2" for label in judging.lexicon.RUBRIC_AXES.values())
    for said, total in ((lines, 14), (lines + "\n**Total**: 17/21", 17), (lines + "\nTotal: 175", 14), ("Total: 9", 9), ("nothing", None)):
        assert spark.createDataFrame([(said,)], "said string").select(judging.axis_scores(F.col("said"))["total"]).first()[0] == total


def test_paraphrases(spark):
    cases = [("Please remove the cat.", 1, "get rid of the cat"), ("ADD a hat", 2, "put a hat"), ("Replaces it", 3, "replaces it"), ("Change, please", 4, "make, please"), ("Remove it", 2, "remove it"), ("...", 1, "..."), ("please", 1, "please")]
    for request, pick, want in cases:
        df = spark.createDataFrame([(request, pick)], "r string, p int")
        assert df.select(text.paraphrase(F.lit("k"), F.col("r"), F.col("p"))).first()[0] == want


def test_prompts_of_one_name_in_several_folders(spark, tmp_path):
    for place, prompt in (("x", "p1"), ("a/x", "p2"), ("b/a/x", "p3")):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{place}.mp4").write_text("m")
        (tmp_path / f"{place}.txt").write_text(f" {prompt}\n")
    (tmp_path / "c.mp4").write_text("alone")
    found = documents.prompted_media(spark, str(tmp_path), ("mp4",)).collect()
    assert sorted((r.path, r.prompt) for r in found) == [("a/x.mp4", "p2"), ("b/a/x.mp4", "p3"), ("x.mp4", "p1")]


def test_row_numbers_go_by_files(spark, tmp_path):
    for name, n in (("a.csv", 2), ("b.csv", 40), ("c.csv", 3)):
        (tmp_path / name).write_bytes(b"\xef\xbb\xbfname,media\n" + b"".join(f'"{name}\n{i}",v{i}\n'.encode() for i in range(n)))
    found = documents.indexed_csv(spark, str(tmp_path), "name string, media string", "/data", "media").orderBy("idx").collect()
    assert [r.name for r in found] == [f"{f}\n{i}" for f, n in (("a.csv", 2), ("b.csv", 40), ("c.csv", 3)) for i in range(n)]
    assert [r.idx for r in found] == list(range(45)) and found[0].media == "/data/v0"


@pytest.fixture
def small_splits(spark):
    """Files are read in ranges of 2000 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("2000", "10"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def test_lines_of_split_files_have_their_numbers(spark, tmp_path, small_splits):
    rnd = random.Random(1)
    want = []
    for name, n, tail, mark in (("a", 500, True, False), ("b", 3, False, False), ("c", 400, False, True), ("e", 0, True, False), ("f", 1, False, True), ("g", 200, True, True)):
        lines = ["é" * rnd.randint(0, 30) + str(i) + ("\r" if rnd.random() < 0.1 else "") + "x" * 5000 * (i == 150) for i in range(n)]
        raw = "\n".join(lines) + ("\n" if tail and n else "")
        (tmp_path / f"{name}.jsonl").write_bytes((b"\xef\xbb\xbf" if mark else b"") + raw.encode())
        want += [(name, i + 1, x, not tail and i == n - 1) for i, x in enumerate(lines)]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    found = records.numbered_lines(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r.path)[0], r.line, r.value, r.open_end) for r in found) == sorted(want)


def test_lines_are_counted_through_the_parts_of_a_text(spark, tmp_path, small_splits):
    parts = [[f"{name} {i}" for i in range(n)] for name, n in (("a", 300), ("b", 0), ("c", 1), ("d", 500))]
    for name, lines in zip("abcd", parts, strict=True):
        (tmp_path / f"part-{name}.txt").write_text("".join(x + "\n" for x in lines))
    found = records.numbered_lines(spark, str(tmp_path), through=True).collect()
    assert sorted((r.line, r.value) for r in found) == list(enumerate(sum(parts, []), 1)) and not any(r.open_end for r in found)


@pytest.fixture
def shuffled_items(spark, tmp_path):
    """A benchmark table of 700 items in no order, with gaps between their ids; the ids in order."""
    ids = sorted(random.Random(2).sample(range(5000), 700))
    mixed = random.Random(3).sample(ids, len(ids))
    spark.createDataFrame([(i, f"t {i}") for i in mixed], "item_id long, text string").repartition(3).write.parquet(str(tmp_path / "benchmark.parquet"))
    return ids


def test_located_errors_count_the_lines_of_the_whole_text(spark, tmp_path, shuffled_items, small_splits):
    found = files.src02_located_errors(spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.line) for r in found) == [(i, n) for n, i in enumerate(shuffled_items, 1) if i % 8 in (1, 2, 3, 4)]


def test_custom_cases_are_named_by_the_lines_of_the_whole_text(spark, tmp_path, shuffled_items, small_splits):
    found = files.src10_custom_cases(spark, str(tmp_path)).collect()
    names = lambda n, i: f"b{i}" if i % 3 == 0 else f"i{i}" if i % 3 == 1 else f"custom_{n}"
    want = [(names(n, i), "swap" if i % 2 else "custom", f"p {i}") for n, i in enumerate(shuffled_items, 1)]
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_repair_of_a_large_file(spark, tmp_path, small_splits):
    lines = [f'{{"id": {i}}}' for i in range(900)]
    lines[500] = '{"id": 1, "id": 2}'
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + '\n{"id": 9')
    good, bad = records.resumable_jsonl(spark, str(tmp_path / "x.jsonl"))
    assert good.count() == 899 and [(r.line, r.error) for r in bad.collect()] == [(501, "duplicate key")]
    assert [r.line for r in records.strict_jsonl(spark, str(tmp_path / "x.jsonl"))[1].orderBy("line").collect()] == [501, 901]
    (tmp_path / "y.jsonl").write_text("\n".join(lines) + "\n{cut}\n")
    assert [r.line for r in records.resumable_jsonl(spark, str(tmp_path / "y.jsonl"))[1].orderBy("line").collect()] == [501, 901]


def shard(path, files):
    with tarfile.open(path, "w") as out:
        for name, raw in files:
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            out.addfile(info, io.BytesIO(raw))


def test_tar_index_reads_headers_alone(spark, tmp_path):
    rnd = random.Random(5)
    everything = {}
    for k in range(11):
        files = [(f"{'deep/' * 40 if i % 7 == 0 else ''}{k}_{i}.{s}", rnd.randbytes(rnd.choice([0, 1, 511, 512, 513, 200_000]))) for i in range(20) for s in ("json", "source.mp4") if rnd.random() < 0.8]
        shard(tmp_path / f"{k:02}.tar", files)
        everything |= {name: raw for name, raw in files}
    (tmp_path / "other.txt").write_text("no shard")
    index = tar.store_index(tar.tar_index(spark, str(tmp_path)), str(tmp_path / "index"))
    rows = index.collect()
    assert {r.name for r in rows} == set(everything) and len(rows) == len(everything)
    for uri in {r.shard for r in rows}:
        raw = open(uri.removeprefix("file://"), "rb").read()
        mine = [r for r in rows if r.shard == uri]
        assert all(raw[r.offset : r.offset + r.size] == everything[r.name] for r in mine)
        # A long name has two headers and a block of its own.
        assert max(r.header_bytes for r in mine) <= 512 * 4 * (len(mine) + 2) and len(raw) > 10 * max(r.header_bytes for r in mine)
    keys = {n.rpartition("/")[2].partition(".")[0] for n in everything}
    by_name = {n.rpartition("/")[2]: raw for n, raw in everything.items()}
    pairs = {k for k in keys if f"{k}.json" in by_name and f"{k}.source.mp4" in by_name}
    found = tar.paired_members(index, ["json", "source.mp4"])
    assert {r.key for r in found.collect()} == pairs
    wanted = found.select("key", "shard", F.col("json.offset").alias("offset"), F.col("json.size").alias("size"))
    read = tar.read_members(wanted).collect()
    assert {r.key: r.content for r in read} == {k: by_name[f"{k}.json"] for k in pairs}
    assert sum(r.range_bytes for r in read) <= sum(r.size for r in read) + len(read) * tar.GAP


def test_tar_folders_without_shards(spark, tmp_path):
    assert tar.tar_index(spark, str(tmp_path)).count() == 0
    shard(tmp_path / "x.tar", [])
    shard(tmp_path / "y.tar", [("a", b"1"), ("a", b"22")])
    rows = tar.tar_index(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.name, r.key, r.suffix, r.size) for r in rows] == [("a", "a", "", 1), ("a", "a", "", 2)]
    assert tar.tar_index(spark, str(tmp_path / "y.tar")).count() == 2


def test_written_shards(spark, tmp_path):
    rows = [(i % 4, f"{i:03}.txt", f"{i}" * i) for i in range(80)]
    df = spark.createDataFrame(rows, "s int, n string, c string").withColumn("c", F.col("c").cast("binary"))
    made = tar.write_shards(df, "s", "n", "c", f"file://{tmp_path}/out")
    assert made.count() == 4
    found = []
    for r in made.collect():
        with tarfile.open(r.uri.removeprefix("file://")) as t:
            names = [m.name for m in t]
            assert names == sorted(names)
            found += [(r.shard, m, t.extractfile(m).read().decode()) for m in names]
    assert sorted(found) == sorted(rows)
