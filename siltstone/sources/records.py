"""Record sources and sinks: JSON lines with several degrees of strictness, CSV, tar shards, manifests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.functions.exact import lenient_object


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a trusted file: blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def collecting_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad lines as error texts. A line is good if Python's parser reads one object from all of it."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_object", lenient_object("value"))
    good = lines.where("_object is not null").select(F.from_json("_object", schema).alias("_row")).select("_row.*")
    return good, lines.where("_object is null").select(F.concat(F.lit("bad JSON: "), "value").alias("error"))


def numbered_lines(spark: SparkSession, path: str | list[str], through: bool = False) -> DataFrame:
    """path, line (from 1), value, open_end of all lines of files of any size; open_end marks a last line without its line feed.

    Files are read in splits, and so is the index that numbers their lines: the line feeds of every byte range, summed up range
    by range. A line's number is what lies before its range and its place in it. Lines end at a line feed alone; a byte-order mark
    is no part of the first. Of compressed files open_end is not known and false.

    through: the files are parts of one text, in the order of their names, and lines are counted through all of them. Each part
    ends at a line's end, as Spark writes them.
    """
    place = ["_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size"]
    # Ids ascend within a task, which reads a range from its beginning to its end.
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *(F.col(c).alias(n) for c, n in zip(place, ("path", "_from", "_size"), strict=True)), F.monotonically_increasing_id().alias("_at"))
    bytes_ = F.sum(F.octet_length("value") + 1).cast("long")
    ranges = lines.groupBy("path", "_from").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), bytes_.alias("_bytes"), F.first("_size").alias("_size"))
    before, whole = Window.partitionBy("path").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    # Without a feed at the end the lines and their feeds are one byte more than the file; a mark that was dropped makes them three less.
    open_end = (F.sum("_bytes").over(whole) - F.col("_size")).isin(1, -2) & ~F.lower("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$")
    in_file = F.coalesce(F.sum("_n").over(before), F.lit(0))
    # One row a range is summed up through all files, not the lines themselves.
    through_all = Window.orderBy("path", "_from").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_n").over(through_all), F.lit(0)) - in_file if through else F.lit(0)
    index = ranges.select("path", "_from", "_n", "_first", in_file.alias("_before"), earlier.cast("long").alias("_earlier"), F.sum("_n").over(whole).alias("_all"), open_end.alias("_open"))
    joined = lines.join(index, ["path", "_from"], "left")
    in_range = F.col("_at") - F.col("_first")
    # Both reads cut the files alike; were that ever not so, a number would be missing or out of its range.
    sure = F.when((in_range >= 0) & (in_range < F.col("_n")), F.col("_before") + in_range + 1).otherwise(F.raise_error(F.lit("the ranges of a file changed while it was read")))
    return joined.select("path", sure.cast("long").alias("line"), "value", "_open", "_all", "_earlier").select("path", (F.col("line") + F.col("_earlier")).alias("line"), "value", (F.col("_open") & (F.col("line") == F.col("_all"))).alias("open_end"))


def _strict(text: str | None) -> str | None:
    """Why a text is not a strict JSON object, or None."""

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("duplicate key")
        return dict(pairs)

    def no_constant(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    try:
        value = json.loads(text or "", object_pairs_hook=unique, parse_constant=no_constant)
    except ValueError as e:
        return str(e)
    return None if isinstance(value, dict) else "not an object"


@F.pandas_udf(T.StringType())
def strict_error(text: pd.Series) -> pd.Series:
    """Why a line is not one strict JSON object: bad syntax, a key twice at any depth, NaN, text after the end."""
    return text.map(_strict)


def strict_jsonl(spark: SparkSession, path: str, through: bool = False) -> tuple[DataFrame, DataFrame]:
    """path, line, value of the good lines; path, line, error of the others. Lines are numbered in their file, or through all files."""
    lines = numbered_lines(spark, path, through).where(F.trim("value") != "").withColumn("error", strict_error("value"))
    return lines.where("error is null").drop("error", "open_end"), lines.where("error is not null").select("path", "line", "error")


def resumable_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Like strict_jsonl, but a last line without its line feed that cannot be read is dropped: the writer died in it."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("error", strict_error("value"))
    lines = lines.where(~(F.col("open_end") & F.col("error").isNotNull()))
    return lines.where("error is null").drop("error", "open_end"), lines.where("error is not null").select("path", "line", "error")


def json_map_rows(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """id and fields of a document that maps ids to entries, in numeric order of the ids."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", f"map<string, struct<{entry}>>")).alias("id", "e")).select("id", "e.*")
    return rows.orderBy(F.expr("try_cast(id as bigint)"), "id")


def metadata_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header by an explicit schema; quoted fields can hold line breaks, and a byte-order mark is no part of a name."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """sha256, path of a manifest's lines; and violations: bad lines, paths that stand twice or leave the bundle."""
    lines = spark.read.text(path).where("value <> ''")
    form = r"^([0-9a-f]{64})  (.+)$"
    rows = lines.select("value", F.regexp_extract("value", form, 1).alias("sha256"), F.regexp_extract("value", form, 2).alias("path"))
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    bad = rows.where("sha256 = ''").select(F.lit("format").alias("rule"), F.col("value").alias("key"))
    bad = bad.unionByName(rows.where((F.col("sha256") != "") & unsafe).select(F.lit("unsafe_path").alias("rule"), F.col("path").alias("key")))
    twice = rows.where("sha256 <> ''").groupBy("path").count().where("count > 1")
    bad = bad.unionByName(twice.select(F.lit("duplicate_path").alias("rule"), F.col("path").alias("key")))
    return rows.where("sha256 <> ''").select("sha256", "path"), bad


def verify_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """rule, path: files that are missing, unlisted or differ."""
    a, b = listed.select("path", F.col("sha256").alias("want")), found.select("path", F.col("sha256").alias("have"))
    rule = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "changed")
    return a.join(b, "path", "full").select(rule.alias("rule"), "path").where("rule is not null")


def write_jsonl(df: DataFrame, path: str, create_only: bool = False) -> None:
    """JSON lines, null fields kept; create_only refuses a path that exists. Spark's committer makes it all or nothing."""
    df.write.mode("errorifexists" if create_only else "overwrite").option("ignoreNullFields", False).json(path)


def with_average_row(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """The rows and, last, one labelled Average with the means of the values."""
    rest = [c for c in df.columns if c not in (label, *values)]
    mean = df.agg(*(F.avg(v).alias(v) for v in values)).withColumn(label, F.lit("Average"))
    for c in rest:
        mean = mean.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    return df.withColumn("_last", F.lit(0)).unionByName(mean.withColumn("_last", F.lit(1))).orderBy("_last", label).drop("_last")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in each file, in the order of the rows: files sort by name as rows do."""
    df.write.option("header", True).option("escape", '"').csv(path)
