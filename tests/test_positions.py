"""Mixed streams against a plain loop over iterators, and what a resumed read opens."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from siltstone.sources import positions


def plain(rows, pattern, ranks, rank, staggered, epochs):
    """slot, loader, position as iterators give them that restart when they are used up."""
    cycles = min(rows[n] // ranks // pattern.count(n) for n in set(pattern))
    offset = rank % len(pattern) if staggered else 0
    streams = {n: itertools.cycle(range(*positions.rank_range(rows[n], ranks, rank))) for n in set(pattern)}
    return [(i, n := pattern[(i + offset) % len(pattern)], next(streams[n])) for i in range(cycles * len(pattern) * epochs)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("positions")
    sizes = {"img": 103, "vid": 41, "ref": 20}
    return {n: positions.write_positioned(spark.range(k).withColumn("v", F.col("id") * 7 % k), ["v"], f"file://{root}/{n}", 8) for n, k in sizes.items()}


@pytest.mark.parametrize(("pattern", "ranks", "rank", "staggered", "epochs"), [("img,vid", 1, 0, False, 1), ("img,img,vid,ref", 3, 1, True, 1), ("vid,img,vid", 2, 1, True, 4), ("ref", 6, 5, False, 3)])
def test_resumed_streams_are_tails_of_whole_ones(spark, tables, pattern, ranks, rank, staggered, epochs):
    pattern = pattern.split(",")
    want = plain({n: x.rows for n, x in tables.items()}, pattern, ranks, rank, staggered, epochs)
    for skip in sorted({0, 1, 2, len(want) // 2, len(want) - 1, len(want), len(want) + 5}):
        got = positions.mixed(spark, tables, pattern, ranks, rank, staggered, skip, epochs).orderBy("slot").collect()
        assert [tuple(r) for r in got] == want[skip:]


def test_a_resumed_read_opens_no_file_before_its_place(spark, tables):
    table = tables["img"]
    rows = table.read(spark, [(50, 57)])
    assert sorted(r.position for r in rows.collect()) == list(range(50, 57))
    opened = {os.path.dirname(r[0]).rpartition("=")[2] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert opened == {"6", "7"}
    assert "PartitionFilters: [" in rows._jdf.queryExecution().executedPlan().toString() and table.read(spark, [(200, 300)]).count() == 0
    assert positions.open_positioned(spark, table.path) == table
    assert [positions.rank_range(10, 3, r) for r in range(3)] == [(0, 4), (4, 7), (7, 10)] and positions.rank_range(10, 3, 1, 99) == (7, 7)


def test_the_number_of_files_does_not_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(positions, "MOST_FILES", 8)
    table = positions.write_positioned(spark.range(103), ["id"], f"file://{tmp_path}/t", 2)
    assert sum(n.startswith("_file=") for n in os.listdir(tmp_path / "t")) == 8
    assert table == positions.open_positioned(spark, table.path) and (table.rows, table.rows_a_file) == (103, 13)
    for ranges in ([(0, 103)], [(12, 14), (90, 200)], [(102, 103)]):
        want = [i for a, z in ranges for i in range(a, min(z, 103))]
        assert sorted((r.id, r.position) for r in table.read(spark, ranges).collect()) == [(i, i) for i in want]


def test_what_cannot_be_mixed(spark, tables):
    with pytest.raises(ValueError):
        positions.mixed(spark, tables, ["img", "none"])
    with pytest.raises(ValueError):
        positions.mixed(spark, tables, ["ref"] * 30)
