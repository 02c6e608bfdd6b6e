"""Whole-document sources (JSON lists and maps, wide CSV, folders, specs) and sinks that replace, merge or bundle."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.functions.exact import canonical, strict_object
from siltstone.operators.ranking import last_wins, with_positions
from siltstone.sources.records import numbered_lines
from siltstone.sources.shared import fixed


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a document that is one list of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def editing_cases(rows: DataFrame, prompt: str, video: str, root: str, ids: list[str] | None = None) -> DataFrame:
    """Cases whose prompts lose the marks of media and whose videos lie in another folder under their own names; only ids, if given."""
    clean = F.trim(F.regexp_replace(prompt, "<(video|image)[0-9]+>", ""))
    out = rows.withColumns({prompt: clean, video: F.concat(F.lit(root.rstrip("/") + "/"), text.basename(F.col(video)))})
    return out.where(F.col("id").isin(ids)) if ids is not None else out


def indexed_csv(spark: SparkSession, path: str, schema: str, root: str, media: str) -> DataFrame:
    """Rows with idx, their number in the order of files and lines, and the media path joined to a root.

    A byte-order mark and quoted line breaks are read as such, so a file is read by one task, in which ids ascend.
    """
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = fixed(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")), "csv")
    joined = F.when(F.col(media).startswith("/"), F.col(media)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), media))
    return with_positions(rows, ["_file", "_at"], "idx").drop("_file", "_at").withColumn(media, joined)


def field(name: str) -> Column:
    """A field of the JSON text in `value`, null if it is missing, empty or 0, as in Python's `or`."""
    x = F.get_json_object("value", f"$.{name}")
    return F.when(~x.isin("", "0", "false"), x)


def custom_cases(spark: SparkSession, path: str, through: bool = False) -> DataFrame:
    """bench_id, edit_type, prompt, video_path, ref_image_path: the id is bench_id, else id, else custom_ and the number of the line, in its file or through all files."""
    lines = numbered_lines(spark, path, through).where(F.trim("value") != "")
    name = F.coalesce(field("bench_id"), field("id"), F.concat(F.lit("custom_"), F.col("line").cast("string")))
    kind = F.coalesce(F.get_json_object("value", "$.edit_type"), F.lit("custom"))
    return lines.select(name.alias("bench_id"), kind.alias("edit_type"), text.strip(F.get_json_object("value", "$.prompt")).alias("prompt"), F.get_json_object("value", "$.video_path").alias("video_path"), F.coalesce(field("ref_image_path"), F.lit("")).alias("ref_image_path"))


def agent_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """bench_id, value (canonical JSON) and file place of records; those with an error are left out."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("value", strict_object("value"))
    ok = ~F.array_contains(F.json_object_keys("value"), "error")
    return lines.where(ok).select(F.coalesce(F.get_json_object("value", "$.bench_id"), F.lit("")).alias("bench_id"), "value", "path", "line")


def records_by_id(records: DataFrame) -> DataFrame:
    """The last record of each id, in the order of files and lines; without an id there is none."""
    return last_wins(records.where("bench_id <> ''").withColumn("_at", F.struct("path", "line")), ["bench_id"], "_at").drop("_at")


def records_in_order(records: DataFrame) -> DataFrame:
    """records with place: by id as a number, -1 for ids that are none, then as they stood."""
    return with_positions(records.withColumn("_n", F.coalesce(F.col("bench_id").try_cast("long"), F.lit(-1))), ["_n", "path", "line"], "place").drop("_n")


def strict_document(path: str, spark: SparkSession) -> dict:
    """One JSON object of a file, without keys that stand twice; ValueError otherwise. For configurations: read on the driver."""
    whole = spark.read.option("wholetext", True).text(path).first()
    if whole is None or (made := canonical(whole["value"], True)) is None:
        raise ValueError(f"{path}: not one strict JSON object")
    return json.loads(made)


def text_pool(spark: SparkSession, path: str) -> DataFrame:
    """value: the strings of a JSON list, or else the lines that are not blank and no comments."""
    lines = spark.read.option("wholetext", True).text(path)
    listed = F.from_json("value", "array<string>", {"mode": "PERMISSIVE"})
    plain = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    is_list = F.trim("value").startswith("[")
    return lines.select(F.explode(F.when(is_list & listed.isNotNull(), listed).otherwise(plain)).alias("value"))


def _plain(uri: Column) -> Column:
    return F.regexp_replace(uri, "^[a-z0-9]+:/+", "/")


def inside(spark: SparkSession, root: str, path: Column) -> Column:
    """A file's path relative to a folder that holds it, however either is written."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = str(base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base)).rstrip("/") + "/"
    return F.substr(_plain(path), F.length(_plain(F.lit(base))) + 1)


def listed(spark: SparkSession, root: str, glob: str = "*", deep: bool = True) -> DataFrame:
    """uri, length of the files below a folder whose names match; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", deep).option("pathGlobFilter", glob).load(root).select(F.col("path").alias("uri"), "length")
    names = found._jdf.inputFiles()
    if len(names) == found.count():
        return found
    # Scans leave out empty files; the listing has them, with their names as in URLs.
    every = spark.createDataFrame([(n,) for n in names], "uri string").select(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))).alias("uri"))
    empty = every.join(found.select(_plain(F.col("uri")).alias("_known")), _plain(F.col("uri")) == F.col("_known"), "left_anti")
    return found.unionByName(empty.withColumn("length", F.lit(0).cast("long")))


def files(spark: SparkSession, root: str, glob: str = "*", deep: bool = True, without: tuple[str, ...] = ()) -> DataFrame:
    """path (relative to root), length: files below a folder whose names match, without excluded ones; contents are not read."""
    found = listed(spark, root, glob, deep)
    return found.select(inside(spark, root, F.col("uri")).alias("path"), "length").where(~F.col("path").isin(*without) if without else F.lit(True))


def prompted_media(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """stem, path, prompt: media files with the text of the sibling .txt; those without one are left out."""
    stems = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    media = files(spark, root).where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*suffixes))
    prompts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    said = text.strip(F.decode("content", "UTF-8")).alias("prompt")
    return media.select(stems(F.col("path")).alias("stem"), "path").join(prompts.select(stems(inside(spark, root, F.col("path"))).alias("stem"), said), "stem")


def metric_means(wide: DataFrame, ids: list[str]) -> DataFrame:
    """metric, mean, n of all other columns of a wide table; empty cells are left out."""
    names = [c for c in wide.columns if c not in ids]
    long = wide.select(*ids, *(F.col(c).try_cast("double").alias(c) for c in names)).unpivot(ids, names, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def sample_metrics(wide: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """key and a map of the metrics that the sample has."""
    names = [c for c in wide.columns if c not in ids]
    filled = F.map_filter(F.create_map(*(x for c in names for x in (F.lit(c), F.col(c).try_cast("double")))), lambda _, v: v.isNotNull())
    return wide.select(key, filled.alias("metrics"))


def method_spec(spec: Column) -> Column:
    """name, folder and scores file of name:folder or name:folder:scores.json."""
    part = lambda i: F.nullif(F.split_part(spec, F.lit(":"), F.lit(i)), F.lit(""))
    return F.struct(part(1).alias("name"), part(2).alias("folder"), part(3).alias("scores"))


def counts_of_specs(specs: DataFrame, spec: str) -> tuple[DataFrame, DataFrame]:
    """name, n of name=count specs, counts of a name summed; and the specs that are no such thing."""
    name, n = F.split_part(spec, F.lit("="), F.lit(1)), F.substr(F.col(spec), F.length(F.split_part(spec, F.lit("="), F.lit(1))) + 2)
    ok = (name != "") & F.col(spec).contains("=") & n.rlike("^[0-9]+$") & (n.try_cast("long") >= 1)
    good = specs.where(ok).groupBy(name.alias("name")).agg(F.sum(n.cast("long")).alias("n"))
    return good, specs.where(~F.coalesce(ok, F.lit(False))).select(spec)


# Sinks


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_bundle(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    """All tables as JSON lines in one new folder, or nothing: they are written beside it and renamed at the end."""
    path, fs = _path(spark, folder)
    if len({n.casefold() for n in tables}) != len(tables) or not all(tables):
        raise ValueError("names of a bundle must differ")
    if fs.exists(path):
        raise FileExistsError(folder)
    staged, _ = _path(spark, f"{folder.rstrip('/')}.staged-{uuid.uuid4().hex}")
    try:
        for name, df in tables.items():
            df.write.option("ignoreNullFields", False).json(f"{staged}/{name}")
        if fs.exists(path) or not fs.rename(staged, path):
            raise FileExistsError(folder)
    finally:
        fs.delete(staged, True)


def replace_text(spark: SparkSession, uri: str, content: str) -> None:
    """Put a small file in the place of an older one: written beside it, then renamed, so no reader sees half of it."""
    path, fs = _path(spark, uri)
    staged, _ = _path(spark, f"{uri}.tmp-{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(content.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    rename.rename(fs.makeQualified(staged), fs.makeQualified(path), options)


def read_text(spark: SparkSession, uri: str) -> str | None:
    path, fs = _path(spark, uri)
    if not fs.exists(path):
        return None
    source = fs.open(path)
    raw = bytes(source.readAllBytes())
    source.close()
    return raw.decode()


def write_summary(spark: SparkSession, uri: str, row: dict, without: tuple[str, ...] = ()) -> None:
    """One record as indented JSON, without some keys."""
    replace_text(spark, uri, json.dumps({k: v for k, v in row.items() if k not in without}, ensure_ascii=False, indent=2, default=str) + "\n")


def upsert_json(spark: SparkSession, uri: str, entries: dict) -> dict:
    """Set keys of a JSON object in a file and keep the others; what the file holds then."""
    old = read_text(spark, uri)
    whole = (json.loads(old) if old else {}) | entries
    replace_text(spark, uri, json.dumps(whole, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    return whole


def merged_results(shards: DataFrame, order: str) -> DataFrame:
    """Of each (idx, bench_id) the last result, if it succeeded; prompt is the refined one or else the raw one."""
    last = last_wins(shards, ["idx", "bench_id"], order).where("success")
    return last.select("idx", "bench_id", "edited_type", F.coalesce(F.nullif("refined_prompt", F.lit("")), "raw_prompt", F.lit("")).alias("prompt"))
