"""Tables by position, of which a range is read without opening what lies before it, and mixed streams that can be taken up at any place.

Files hold equal ranges of positions and lie in folders named by their number, so the place of a position is known without an index that
would have to be read; Spark drops the folders outside a range before it opens anything. The driver lists the folders, so there are no more of
them than MOST_FILES, however many rows there are.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.ranking import dealt_by_range, numbered
from siltstone.operators.selection import consumed
from siltstone.sources.documents import read_text, replace_text

ROWS_A_FILE = 1_000_000
#: Files of a table; one with more rows than so many files of the wanted size has longer files.
MOST_FILES = 1024


@dataclass(frozen=True)
class Positioned:
    """rows rows in `path`, numbered from 0 in the column position, rows_a_file of them in a file."""

    path: str
    rows: int
    rows_a_file: int

    def read(self, spark: SparkSession, ranges: list[tuple[int, int]]) -> DataFrame:
        """The rows whose positions lie in any of the ranges (first, end)."""
        table = spark.read.parquet(self.path)
        kept = [(a, min(z, self.rows)) for a, z in ranges if a < min(z, self.rows)]
        if not kept:
            return table.where("false").drop("_file")
        within = lambda name, size, last: reduce(lambda x, y: x | y, [(F.col(name) >= a // size) & (F.col(name) <= (z - 1) // size) for a, z in kept])
        return table.where(within("_file", self.rows_a_file, None) & within("position", 1, None)).drop("_file")


def write_positioned(df: DataFrame, order: list[Column | str], path: str, rows_a_file: int = ROWS_A_FILE) -> Positioned:
    """Number the rows in a total order and write them by position; the folder can be opened again by open_positioned.

    Files hold rows_a_file rows, or more where that would make more than MOST_FILES of them.
    """
    spark = df.sparkSession
    dealt = dealt_by_range(df, order)
    rows = dealt.count()
    made = Positioned(path, rows, max(rows_a_file, -(-rows // MOST_FILES)))
    files = numbered(dealt, order, "position").withColumn("_file", F.floor(F.col("position") / made.rows_a_file))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files.repartition(n, "_file").sortWithinPartitions("_file", "position").write.partitionBy("_file").parquet(path)
    replace_text(spark, f"{path}/_positions.json", json.dumps(asdict(made)))
    return made


def open_positioned(spark: SparkSession, path: str) -> Positioned:
    return Positioned(**json.loads(read_text(spark, f"{path}/_positions.json") or "{}") | {"path": path})


def rank_range(rows: int, ranks: int, rank: int, start: int = 0) -> tuple[int, int]:
    """The positions of a rank, first and end: contiguous, the first rows % ranks of them one longer; from `start` rows into it."""
    each, rest = divmod(rows, ranks)
    first = rank * each + min(rank, rest)
    end = first + each + (rank < rest)
    return min(end, first + max(0, start)), end


def mixed(spark: SparkSession, loaders: dict[str, Positioned], pattern: list[str], ranks: int = 1, rank: int = 0, staggered: bool = False, skip: int = 0, epochs: int = 1) -> DataFrame:
    """slot, loader, position: what a rank sees from place `skip` on of a cyclic mix of tables.

    An epoch has as many cycles of the pattern as every table can fill with rows // ranks rows; staggered ranks begin at another place of
    the pattern. A rank takes the rows of its range in order, and from its beginning again where more epochs need more. The rows that
    lie before the place are not read, and neither are files without rows that are still to come.
    """
    need = {name: pattern.count(name) for name in dict.fromkeys(pattern)}
    if missing := [n for n in need if n not in loaders]:
        raise ValueError(f"no such tables: {missing}")
    cycles = min(loaders[n].rows // ranks // c for n, c in need.items())
    if cycles < 1:
        raise ValueError("not one cycle a rank")
    p, offset = len(pattern), rank % len(pattern) if staggered else 0
    total = cycles * p * epochs
    skip = max(0, min(skip, total))
    seen = consumed(pattern, skip, offset)
    parts = []
    for name, c in need.items():
        first, end = rank_range(loaders[name].rows, ranks, rank)
        size, k0, k1 = end - first, seen.get(name, 0), cycles * epochs * c
        if k0 >= k1:
            continue
        # The k-th row of a loader is that of its range at k % size: one range of positions, two if it wraps, or all.
        a, z = k0 % size, (k1 - 1) % size + 1
        ranges = [(first, end)] if k1 - k0 >= size else [(first + a, first + z)] if a < z else [(first, first + z), (first + a, end)]
        places = F.array(*(F.lit(j) for j in range(p) if pattern[(j + offset) % p] == name))
        rows = loaders[name].read(spark, ranges).select("position")
        own = F.col("position") - first
        turns = F.sequence(F.lit(0).cast("long"), F.lit((k1 - 1) // size).cast("long"))
        rows = rows.select("position", F.explode(F.transform(turns, lambda e: own + e * size)).alias("k")).where((F.col("k") >= k0) & (F.col("k") < k1))
        slot = F.floor(F.col("k") / c) * p + F.get(places, F.pmod(F.col("k"), F.lit(c)).cast("int"))
        parts.append(rows.select(slot.cast("long").alias("slot"), F.lit(name).alias("loader"), "position"))
    if not parts:
        return spark.createDataFrame([], "slot long, loader string, position long")
    return reduce(DataFrame.unionByName, parts)
