"""Digests of ordered sequences and of files, folded piece by piece: a task holds one batch of rows or one chunk of a file, whatever the size."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.exact_sums import exact_sums
from siltstone.operators.ranking import with_positions
from siltstone.sources.documents import inside, listed
from siltstone.sources.shared import opened

#: Bytes of a file that are read at once.
CHUNK = 4 << 20


def folded(df: DataFrame, by: list[str], order: list[str], value: str, text: Callable[[object], str], between: str = "", begin: str = "", end: str = "") -> DataFrame:
    """by, n, digest: SHA-256 of begin, the values' texts in order, with something between them, and end, for each group.

    A digest of a sequence can only be made from its beginning to its end, so one task folds a group; it is sorted on disk where it is
    large, and streams through. Groups are folded side by side.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, kinds[c]) for c in by), ("n", pa.int64()), ("digest", pa.string())])
        group, n, made = None, 0, None

        def done() -> pa.RecordBatch:
            made.update(end.encode())
            return pa.RecordBatch.from_arrays([*(pa.array([g], kinds[c]) for g, c in zip(group, by, strict=True)), pa.array([n], pa.int64()), pa.array([made.hexdigest()])], schema=schema)

        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            values, k = batch.column("_value").to_pylist(), 0
            while k < len(values):
                z = k + 1
                while z < len(values) and groups[z] == groups[k]:
                    z += 1
                if made is None or groups[k] != group:
                    if made is not None:
                        yield done()
                    group, n, made = groups[k], 0, hashlib.sha256(begin.encode())
                made.update(((between if n else "") + between.join(map(text, values[k:z]))).encode())
                n, k = n + z - k, z
        if made is not None:
            yield done()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*by, F.col(value).alias("_value"), *(F.col(c).alias(f"_order{i}") for i, c in enumerate(order)))
    rows = rows.repartition(parts, *by) if by else rows.repartition(1)
    rows = rows.sortWithinPartitions(*by, *(f"_order{i}" for i in range(len(order))))
    shape = rows.select(*by).withColumns({"n": F.lit(0).cast("long"), "digest": F.lit("")}).schema
    kinds = {c: pa.RecordBatch.from_pylist([], schema=_arrow(shape)).schema.field(c).type for c in by}
    return rows.mapInArrow(fold, shape)


def _arrow(shape) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(shape)


def set_digest(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, digest, n: SHA-256 of the distinct values, sorted and joined by line feeds, and how many there are. Null is no value."""
    distinct = df.where(F.col(value).isNotNull()).select(*by, value).distinct()
    return folded(distinct, by, [value], value, str, "\n").select(*by, "digest", "n")


def score_digest(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """by, n, digest: SHA-256 of the scores as a compact JSON list; a double has the shortest text that reads back as it, as in Python."""
    return folded(df, by, order, value, json.dumps, ",", "[", "]")


def score_summary(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """by, n, total, mean, digest of the scores of each stratum; the sum is rounded once."""
    sums = exact_sums(df, by, value).withColumn("mean", F.col("total") / F.col("n"))
    return score_digest(df, value, by, order).join(sums.drop("n"), by)


def file_digests(spark: SparkSession, files: DataFrame, algorithm: str = "sha256", chunk: int = CHUNK) -> DataFrame:
    """files (uri, length and other columns) with digest: of their contents, a chunk at a time.

    Files are dealt by size, large ones first and to and fro, so that tasks have about as many bytes each; a file of any size is read by one
    task in constant memory. Files lie where Python workers can open them.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column("uri").to_pylist():
                system, path = opened(uri)
                made = hashlib.new(algorithm)
                with system.open_input_stream(path) as file:
                    while raw := file.read(chunk):
                        made.update(raw)
                found.append(made.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*names, "digest"])

    placed = with_positions(files, [F.desc("length"), "uri"], "_place")
    turn, lane = F.floor(F.col("_place") / parts), F.col("_place") % parts
    lane = F.when(turn % 2 == 0, lane).otherwise(parts - 1 - lane)
    return placed.withColumn("_lane", lane).repartition(parts, "_lane").select(names).mapInArrow(run, files.withColumn("digest", F.lit("")).schema)


def file_manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """sha256, path (relative to root), length of all files below root whose names match."""
    named = file_digests(spark, listed(spark, root, glob))
    return named.select(F.col("digest").alias("sha256"), inside(spark, root, F.col("uri")).alias("path"), "length")

