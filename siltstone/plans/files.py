"""Registered queries of sources, sinks, audits and batch work.

Each writes files from the driver's tables to the shared folder and says what reading them back gives; the SQL says the same from
the tables alone.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import audits, digests
from siltstone.plans.catalog import query, t
from siltstone.sources import commits, documents, positions, records, tar
from siltstone.sources.shared import fixed, folder, located
from siltstone.streaming import batches, incremental


def _lines(df: DataFrame, label: str, line, parts: int | None = None) -> str:
    """Lines written as text files, in one file or several."""
    path = folder(df.sparkSession, label)
    rows = df.select(line.alias("value"))
    (rows.coalesce(parts) if parts else rows).write.text(path)
    return path


def _numbered(df: DataFrame, label: str, line, key: str, most: int) -> str:
    """Lines in order of a key, in files of `most` keys each that many tasks write; file names sort like the keys."""
    path = folder(df.sparkSession, label)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(line.alias("value"), F.format_string("%08d", F.floor(F.col(key) / most)).alias("part"), key)
    rows.repartition(n, "part").sortWithinPartitions("part", key).select("value", "part").write.partitionBy("part").text(path)
    return path


def _in_order(df: DataFrame, label: str, line, key: str) -> str:
    """Lines in order of a key through all files, in the order of their names; many tasks write them."""
    path = folder(df.sparkSession, label)
    n, order = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key).asc_nulls_last()
    df.select(line.alias("value"), key).repartitionByRange(n, order).sortWithinPartitions(order).select("value").write.text(path)
    return path


def _event():
    return F.to_json(F.struct("event_id", "user_id", "event_type", "value"))


@query("select event_id, user_id, event_type, value from events")
def src01_lenient_lines(spark, d):
    path = _lines(t(spark, d, "events"), "lines", F.concat(_event(), F.when(F.col("event_id") % 3 == 0, "\n\n").otherwise("")))
    return records.lenient_jsonl(spark, path, "event_id long, user_id long, event_type string, value double")


def _faulty(spark, d, label: str) -> str:
    """Items as JSON lines, with a fault of a kind for each rest of the id by 8."""
    k, ok = F.col("item_id") % 8, F.concat(F.lit('{"id": '), F.col("item_id").cast("string"), F.lit("}"))
    line = F.when(k == 1, F.concat(ok, F.lit(" x"))).when(k == 2, F.concat(F.lit('{"id": 1, "id": '), F.col("item_id").cast("string"), F.lit("}"))).when(k == 3, F.concat(F.lit('{"id": NaN, "n": '), F.col("item_id").cast("string"), F.lit("}")))
    return _lines(t(spark, d, "benchmark").select("item_id"), label, line.when(k == 4, F.concat(F.lit("["), ok, F.lit("]"))).when(k == 5, "  ").otherwise(ok))


@query("select count_if(item_id % 8 in (0, 6, 7)) as good, count_if(item_id % 8 in (1, 2, 3, 4)) as bad, sum(case when item_id % 8 in (0, 6, 7) then item_id end)::bigint as ids from benchmark")
def src03_strict_lines(spark, d):
    good, bad = records.strict_jsonl(spark, _faulty(spark, d, "strict"))
    s = good.agg(F.count("*").alias("good"), F.sum(F.get_json_object("value", "$.id").cast("long")).alias("ids"))
    return s.join(F.broadcast(bad.agg(F.count("*").alias("bad"))))


@query("select item_id, line from (select item_id, row_number() over (order by item_id) as line from benchmark) where item_id % 8 in (1, 2, 3, 4)")
def src02_located_errors(spark, d):
    """Bad lines with their places: errors name the part and the line, counted through all parts of the text."""
    k, ok = F.col("item_id") % 8, F.concat(F.lit('{"id": '), F.col("item_id").cast("string"), F.lit("}"))
    line = F.when(k.isin(1, 2, 3, 4), F.concat(F.col("item_id").cast("string"), F.lit(": no object"))).otherwise(ok)
    path = _in_order(t(spark, d, "benchmark"), "located", line, "item_id")
    _, bad = records.strict_jsonl(spark, path, through=True)
    lines = records.numbered_lines(spark, path, through=True).select("path", "line", "value")
    return bad.join(lines, ["path", "line"]).select(F.split_part("value", F.lit(":"), F.lit(1)).cast("long").alias("item_id"), "line")


@query("select count(*) - count(distinct item_id // 16) as good, 0::bigint as bad from benchmark")
def src04_truncated_tail(spark, d):
    """Files whose writer died in their last line: what was whole is kept, the rest is no error."""
    path = folder(spark, "tail")
    line = F.concat(F.lit('{"id": '), F.col("item_id").cast("string"), F.lit("}"))
    whole = t(spark, d, "benchmark").groupBy(F.floor(F.col("item_id") / 16).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("value"))
    # A blank, not a line feed, ends what Spark writes: each file stops in its last object.
    whole.select(F.expr("left(value, length(value) - 1)").alias("value"), "part").repartition("part").write.option("lineSep", " ").partitionBy("part").text(path)
    good, bad = records.resumable_jsonl(spark, path)
    return good.agg(F.count("*").alias("good")).join(F.broadcast(bad.agg(F.count("*").alias("bad"))))


@query("select count_if(item_id % 4 <> 1) as good, count_if(item_id % 4 = 1) as bad from benchmark")
def src05_collected_errors(spark, d):
    ok = F.concat(F.lit('{"id": '), F.col("item_id").cast("string"), F.lit("}"))
    path = _lines(t(spark, d, "benchmark"), "collect", F.when(F.col("item_id") % 4 == 1, F.concat(ok, F.lit(","), ok, F.lit("}"))).otherwise(ok))
    good, bad = records.collecting_jsonl(spark, path, "id long")
    return good.agg(F.count("id").alias("good")).join(F.broadcast(bad.agg(F.count("*").alias("bad"))))


@query("select item_id, length(text) as n from benchmark")
def src06_json_list(spark, d):
    rows = t(spark, d, "benchmark").agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("item_id", "text")))), ",\n").alias("x"))
    path = _lines(rows, "list", F.concat(F.lit("["), "x", F.lit("]")), 1)
    return documents.json_list(spark, path, "item_id long, text string").select("item_id", F.length("text").cast("long").alias("n"))


@query("select item_id::varchar as id, 'do it for ' || item_id as prompt, '/bench/clips/' || item_id || '.mp4' as video from benchmark where item_id % 3 = 0")
def src07_json_map(spark, d):
    """A document that maps ids to cases: prompts lose their marks, videos get another folder, and an id list picks cases."""
    i = F.col("item_id").cast("string")
    entry = F.concat(F.lit('"'), i, F.lit('": {"prompt": "<video1> do it for '), i, F.lit(' <image2>", "video": "old/'), i, F.lit('.mp4"}'))
    rows = t(spark, d, "benchmark").agg(F.array_join(F.collect_list(entry), ", ").alias("x"))
    path = _lines(rows, "map", F.concat(F.lit("{"), "x", F.lit("}")), 1)
    ids = [str(r["item_id"]) for r in t(spark, d, "benchmark").where("item_id % 3 = 0").select("item_id").collect()]
    return documents.editing_cases(records.json_map_rows(spark, path, "prompt string, video string"), "prompt", "video", "/bench/clips", ids)


@query("select item_id, text, length(text)::int as n from benchmark")
def src08_metadata_csv(spark, d):
    """Metadata with quoted line breaks, read by an explicit schema."""
    path = folder(spark, "meta")
    t(spark, d, "benchmark").select("item_id", "text", F.length("text").alias("n")).write.option("header", True).option("escape", '"').csv(path)
    return records.metadata_csv(spark, path, "item_id long, text string, n int")


@query("select item_id, row_number() over (order by item_id) - 1 as idx, '/data/' || item_id || '.mp4' as media from benchmark")
def src09_indexed_csv(spark, d):
    rows = t(spark, d, "benchmark").orderBy("item_id").coalesce(1)
    path = folder(spark, "csv")
    rows.select("item_id", "text", F.concat(F.when(F.col("item_id") % 2 == 0, "/data/").otherwise(""), F.col("item_id").cast("string"), F.lit(".mp4")).alias("media")).write.option("header", True).option("escape", '"').csv(path)
    return documents.indexed_csv(spark, path, "item_id long, text string, media string", "/data", "media").select("item_id", "idx", "media")


@query("select case when item_id % 3 = 0 then 'b' || item_id when item_id % 3 = 1 then 'i' || item_id else 'custom_' || (row_number() over (order by item_id)) end as bench_id, case when item_id % 2 = 0 then 'custom' else 'swap' end as edit_type, 'p ' || item_id as prompt from benchmark")
def src10_custom_cases(spark, d):
    i, k = F.col("item_id").cast("string"), F.col("item_id")
    names = F.concat(F.lit('"bench_id": "'), F.when(k % 3 == 0, F.concat(F.lit("b"), i)).otherwise(""), F.lit('", "id": "'), F.when(k % 3 == 1, F.concat(F.lit("i"), i)).otherwise(""), F.lit('"'))
    line = F.concat(F.lit("{"), names, F.when(k % 2 == 1, ', "edit_type": "swap"').otherwise(""), F.lit(', "prompt": " p '), i, F.lit(' ", "video_path": "v"}'))
    path = _in_order(t(spark, d, "benchmark"), "custom", line, "item_id")
    return documents.custom_cases(spark, path, through=True).select("bench_id", "edit_type", "prompt")


def _record():
    name = F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.pmod("doc_id", F.lit(150)).cast("string"))
    return F.concat(F.lit('{"bench_id": "'), name, F.lit('", "doc": '), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ', "error": null}').otherwise("}"))


@query("select case when doc_id % 11 = 0 then 'x' else (doc_id % 150)::varchar end as bench_id, max(doc_id) as doc from documents where doc_id % 5 <> 0 group by all")
def src11_agent_records(spark, d):
    """Records without an error, the last of each id."""
    path = _numbered(t(spark, d, "documents"), "agent", _record(), "doc_id", 300)
    return documents.records_by_id(documents.agent_records(spark, path)).select("bench_id", F.get_json_object("value", "$.doc").cast("long").alias("doc"))


@query("select doc_id as doc, row_number() over (order by case when doc_id % 11 = 0 then -1 else doc_id % 150 end, doc_id) - 1 as place from documents where doc_id % 5 <> 0")
def src12_records_in_order(spark, d):
    path = _numbered(t(spark, d, "documents"), "order", _record(), "doc_id", 300)
    return documents.records_in_order(documents.agent_records(spark, path)).select(F.get_json_object("value", "$.doc").cast("long").alias("doc"), "place")


def _shards(spark, d) -> str:
    """Tar shards of documents: a text member for each, and for two of three a record beside it, with a name too long for a plain header now and then."""
    docs = t(spark, d, "documents").where("text is not null").select("doc_id", "text", "lang")
    key = F.concat(F.when(F.col("doc_id") % 50 == 0, F.lit("deep/" * 30)).otherwise("a/"), F.col("doc_id").cast("string"))
    record = F.struct(F.concat(key, F.lit(".json")).alias("name"), F.to_json(F.struct("doc_id", "lang")).cast("binary").alias("content"))
    clip = F.struct(F.concat(key, F.lit(".source.mp4")).alias("name"), F.col("text").cast("binary").alias("content"))
    rows = docs.select(F.pmod(F.col("doc_id"), F.lit(12)).alias("shard"), F.inline(F.when(F.col("doc_id") % 3 == 0, F.array(clip)).otherwise(F.array(record, clip))))
    root = folder(spark, "tar")
    tar.write_shards(rows, "shard", "name", "content", root)
    return root


@query("select doc_id, lang, strlen(text) as bytes from documents where doc_id % 3 <> 0 and text is not null")
def src13_paired_shards(spark, d):
    """Records with the clip of their key in the same shard; of the clips only headers are read."""
    pairs = tar.paired_members(tar.tar_index(spark, _shards(spark, d)), ["json", "source.mp4"])
    found = tar.read_members(pairs.select("shard", F.col("json.offset").alias("offset"), F.col("json.size").alias("size"), F.col("`source.mp4`.size").alias("bytes")))
    return found.select(F.from_json(F.col("content").cast("string"), "doc_id long, lang string").alias("r"), "bytes").select("r.*", "bytes")


@query("select doc_id, md5(text) as digest from documents where doc_id % 7 = 2")
def src14_ranged_members(spark, d):
    """A stored index of tar shards; of some clips only their own bytes are read."""
    index = tar.store_index(tar.tar_index(spark, _shards(spark, d)), folder(spark, "tar-index"))
    wanted = t(spark, d, "documents").where("doc_id % 7 = 2").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    lies = index.where("suffix = 'source.mp4'").select("key", "shard", "offset", "size")
    return tar.read_members(wanted.join(lies, "key")).select("doc_id", F.md5("content").alias("digest"))


@query("select case when n_nationkey % 3 = 0 then 'unsafe_path' when n_nationkey % 3 = 1 then 'format' else 'duplicate_path' end as rule, case when n_nationkey % 3 = 0 then '../' || n_name when n_nationkey % 3 = 1 then 'no digest ' || n_name else n_name end as key from nation")
def src20_manifest_faults(spark, d):
    """Lines of a manifest that are no such lines, paths that leave the bundle, and paths that stand twice."""
    k, digest = F.col("n_nationkey") % 3, F.lit("0" * 64 + "  ")
    good = F.concat(digest, "n_name")
    line = F.when(k == 0, F.concat(digest, F.lit("../"), "n_name")).when(k == 1, F.concat(F.lit("no digest "), "n_name")).otherwise(F.concat(good, F.lit("\n"), good))
    return records.read_manifest(spark, _lines(t(spark, d, "nation"), "faults", line))[1]


def _small_files(spark, d) -> str:
    """For each nation a media file, for most a prompt beside it; and cached tensors in a folder of their own."""
    root = folder(spark, "files")
    for r in t(spark, d, "nation").select("n_nationkey", "n_name").collect():
        k, name = r["n_nationkey"], r["n_name"]
        documents.replace_text(spark, f"{root}/{'a' if k % 2 else 'b'}/{name}.mp4", "m" * (k + 1))
        if k % 4:
            documents.replace_text(spark, f"{root}/{'a' if k % 2 else 'b'}/{name}.txt", f" prompt {k}\n")
        documents.replace_text(spark, f"{root}/cache/deep/{k}.pth", "t")
    return root


@query("select case when n_nationkey % 2 = 1 then 'a/' else 'b/' end || n_name as stem, 'prompt ' || n_nationkey as prompt from nation where n_nationkey % 4 <> 0 union all select n_name, 'root ' || n_nationkey from nation where n_nationkey < 3 union all select 'deep/a/' || n_name, 'deep ' || n_nationkey from nation where n_nationkey < 3")
def src17_prompted_media(spark, d):
    """Media with the prompt beside them; files of one name in several folders have each its own."""
    root = _small_files(spark, d)
    for r in t(spark, d, "nation").where("n_nationkey < 3").collect():
        for place, word in (("", "root"), ("deep/a/", "deep")):
            documents.replace_text(spark, f"{root}/{place}{r['n_name']}.jpg", "j")
            documents.replace_text(spark, f"{root}/{place}{r['n_name']}.txt", f"{word} {r['n_nationkey']}")
    return documents.prompted_media(spark, root, ("mp4", "jpg")).select("stem", "prompt")


@query("select 'cache/deep/' || n_nationkey || '.pth' as path from nation")
def src18_cached_files(spark, d):
    return documents.files(spark, _small_files(spark, d), "*.pth").select("path")


@query("select path, length from (select case when n_nationkey % 2 = 1 then 'a/' else 'b/' end || n_name || '.mp4' as path, n_nationkey + 1 as length from nation) where path <> 'b/NATION_0.mp4'")
def src19_bundle_listing(spark, d):
    return documents.files(spark, _small_files(spark, d), "*.mp4", without=("b/NATION_0.mp4",)).select("path", F.col("length").cast("int").alias("length"))


@query("select item_id::varchar as bench_id, length(text)::double as score from benchmark")
def src21_scores_by_id(spark, d):
    """A scores document: its list of samples as rows by id."""
    sample = F.to_json(F.struct(F.col("item_id").cast("string").alias("bench_id"), F.length("text").cast("double").alias("score")))
    path = _lines(t(spark, d, "benchmark").agg(F.array_join(F.collect_list(sample), ",").alias("x")), "scores", F.concat(F.lit('{"samples": ['), "x", F.lit("]}")), 1)
    whole = documents.json_list(spark, path, "samples array<struct<bench_id string, score double>>")
    return whole.select(F.inline("samples"))


@query("select metric, avg(v) as mean, count(v) as n from (select 'a' as metric, case when doc_id % 7 <> 0 then n_chars * 0.5 end as v from documents union all select 'b', case when doc_id % 3 <> 0 then doc_id::double end from documents) group by metric")
def src22_wide_metrics(spark, d):
    path = folder(spark, "wide")
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") * 0.5).alias("a"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("double")).alias("b"))
    docs.write.option("header", True).csv(path)
    return documents.metric_means(spark.read.option("header", True).schema("id string, type string, a string, b string").csv(path), ["id", "type"])


@query("select doc_id::varchar as id, (doc_id % 7 <> 0)::int + (doc_id % 3 <> 0)::int as n_metrics from documents")
def src22_sparse_metrics(spark, d):
    wide = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 7 != 0, "1.5").otherwise("").alias("a"), F.when(F.col("doc_id") % 3 != 0, "2").alias("b"))
    return documents.sample_metrics(wide, "id", ["id"]).select("id", F.size("metrics").alias("n_metrics"))


@query("select user_id, count(*) as n from events where event_type in ('click', 'view') group by user_id")
def src24_filtered_cases(spark, d):
    """Cases of a file, by a list of ids."""
    path = _lines(t(spark, d, "events"), "cases", _event())
    return records.lenient_jsonl(spark, path, "event_id long, user_id long, event_type string, value double").where(F.col("event_type").isin("click", "view")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("select 'kept' as status, count(*) as n from benchmark union all select 'refused', 2")
def src25_strict_document(spark, d):
    """A configuration of one strict object; two that are none are refused."""
    root, n = folder(spark, "config"), t(spark, d, "benchmark").count()
    texts = {"good": json.dumps({"n": n}), "twice": '{"n": 1, "n": 2}', "list": "[1]"}
    refused, kept = 0, 0
    for name, said in texts.items():
        documents.replace_text(spark, f"{root}/{name}.json", said)
        try:
            kept = documents.strict_document(f"{root}/{name}.json", spark)["n"]
        except ValueError:
            refused += 1
    return spark.createDataFrame([("kept", kept), ("refused", refused)], "status string, n long")


@query("select source || ':' || lang || case when doc_id % 2 = 0 then ':s.json' else '' end as spec, source as name, lang as folder, case when doc_id % 2 = 0 then 's.json' end as scores from documents")
def src26_method_specs(spark, d):
    spec = F.concat("source", F.lit(":"), "lang", F.when(F.col("doc_id") % 2 == 0, ":s.json").otherwise(""))
    return t(spark, d, "documents").select(spec.alias("spec")).withColumn("m", documents.method_spec(F.col("spec"))).select("spec", "m.*")


@query("select n_name as value from nation where n_nationkey % 5 <> 0 union all select 'list ' || n_nationkey from nation")
def src27_text_pools(spark, d):
    """A pool as lines with comments and blanks, and one as a JSON list."""
    root = folder(spark, "pool")
    rows = t(spark, d, "nation").collect()
    documents.replace_text(spark, f"{root}/a.txt", "\n".join(("# " if r["n_nationkey"] % 5 == 0 else " ") + r["n_name"] + "\n" for r in rows))
    documents.replace_text(spark, f"{root}/b.json", json.dumps([f"list {r['n_nationkey']}" for r in rows]))
    return documents.text_pool(spark, f"{root}/a.txt").unionByName(documents.text_pool(spark, f"{root}/b.json"))


@query("select lang as name, sum(doc_id % 5 + 1)::bigint as n from documents where doc_id % 7 > 1 group by lang")
def flt25_count_specs(spark, d):
    k = F.col("doc_id")
    spec = F.when(k % 7 == 0, F.concat("lang", F.lit("=0"))).when(k % 7 == 1, F.concat(F.lit("="), (k % 5).cast("string"))).otherwise(F.concat("lang", F.lit("="), (k % 5 + 1).cast("string")))
    return documents.counts_of_specs(t(spark, d, "documents").select(spec.alias("spec")), "spec")[0]


# Sinks


@query("select item_id, text, null::varchar as note from benchmark")
def snk01_json_lines(spark, d):
    path = folder(spark, "jsonl")
    records.write_jsonl(t(spark, d, "benchmark").withColumn("note", F.lit(None).cast("string")), path)
    return spark.read.schema("item_id long, text string, note string").json(path)


@query("select 'written' as status, count(*) as n from benchmark union all select 'refused', 1")
def snk02_create_only(spark, d):
    path, refused = folder(spark, "once"), 0
    records.write_jsonl(t(spark, d, "benchmark"), path, create_only=True)
    try:
        records.write_jsonl(t(spark, d, "benchmark"), path, create_only=True)
    except Exception:  # noqa: BLE001 - Spark's own error type
        refused = 1
    return spark.read.json(path).agg(F.lit("written").alias("status"), F.count("*").alias("n")).unionByName(spark.createDataFrame([("refused", refused)], "status string, n long"))


@query("select 'items' as name, count(*) as n from benchmark union all select 'labels', count(*) from labels union all select 'leftovers', 0")
def snk03_bundle(spark, d):
    """Two tables in one bundle; a second bundle, of which one table cannot be written, leaves nothing."""
    root, left = folder(spark, "bundles"), 0
    tables = {"items": t(spark, d, "benchmark"), "labels": t(spark, d, "labels")}
    documents.write_bundle(spark, tables, f"{root}/one")
    try:
        documents.write_bundle(spark, tables | {"bad": t(spark, d, "benchmark").select(F.raise_error(F.lit("no")).cast("int").alias("x"))}, f"{root}/two")
    except Exception:  # noqa: BLE001 - Spark's own error type
        left = sum(1 for _ in spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(root))) - 1
    counts = [spark.read.json(f"{root}/one/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in tables]
    return counts[0].unionByName(counts[1]).unionByName(spark.createDataFrame([("leftovers", left)], "name string, n long"))


@query("select 'a' as key, count(*) as value from benchmark union all select 'b', 2 union all select 'c', 3")
def snk04_replaced_and_upserted(spark, d):
    """SNK-04, SNK-09 and SNK-10: a summary without a key, replaced by one with more keys set; the file is whole at every time."""
    uri = folder(spark, "json") + "/info.json"
    documents.write_summary(spark, uri, {"a": 1, "b": 2, "drop": 9}, without=("drop",))
    whole = documents.upsert_json(spark, uri, {"a": t(spark, d, "benchmark").count(), "c": 3})
    assert json.loads(documents.read_text(spark, uri)) == whole
    return spark.createDataFrame(sorted(whole.items()), "key string, value long")


@query("select doc_id % 3 as writer, case when quality = 1 then 'accepted' else 'rejected' end as route, count(*) as n from labels group by all")
def snk05_routed_append(spark, d):
    """Three writers append their rows, accepted or rejected; each repeats its batch, as after a failure, which changes nothing."""
    log = commits.CommitLog(spark, folder(spark, "routes"), snapshot_every=2)
    rows = t(spark, d, "labels").withColumn("writer", F.col("doc_id") % 3)
    for k in (0, 1, 2, 1, 0):
        commits.append_routed(log, f"writer-{k}", 0, rows.where(F.col("writer") == k), F.col("quality") == 1)
    return log.read(f"{rows.schema.simpleString()[7:-1].replace(':', ' ')}, route string").groupBy("writer", "route").agg(F.count("*").alias("n"))


@query("""
with s as (select (doc_id % 300)::int as idx, lang as bench_id, source as edited_type, case when doc_id % 4 = 0 then '' else 'refined ' || doc_id end as refined_prompt, 'raw ' || doc_id as raw_prompt, doc_id % 6 <> 0 as success, doc_id from documents)
select idx, bench_id, edited_type, coalesce(nullif(refined_prompt, ''), raw_prompt) as prompt from (select *, row_number() over (partition by idx, bench_id order by doc_id desc) as k from s) where k = 1 and success
""")
def snk06_merged_shards(spark, d):
    """Ranks append their results to one table; the last of each key that succeeded is written as CSV and read again."""
    k = F.col("doc_id")
    rows = t(spark, d, "documents").select((k % 300).cast("int").alias("idx"), F.col("lang").alias("bench_id"), F.col("source").alias("edited_type"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("refined "), k.cast("string"))).alias("refined_prompt"), F.concat(F.lit("raw "), k.cast("string")).alias("raw_prompt"), (k % 6 != 0).alias("success"), "doc_id")
    log = commits.CommitLog(spark, folder(spark, "shards"))
    for rank in range(2):
        log.append(f"rank-{rank}", 0, rows.where(k % 2 == rank))
    path = folder(spark, "merged")
    merged = documents.merged_results(log.read(rows.schema), "doc_id")
    records.write_csv(merged.orderBy("idx", "bench_id"), path)
    return records.metadata_csv(spark, path, merged.schema)


@query("select lang, mean from (select lang, avg(n_chars) as mean from documents group by lang) union all select 'Average', avg(mean) from (select avg(n_chars) as mean from documents group by lang)")
def snk07_average_row(spark, d):
    """A table and its last row of means as CSV, read again."""
    path = folder(spark, "averages")
    records.write_csv(records.with_average_row(t(spark, d, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mean")), "lang", ["mean"]), path)
    return records.metadata_csv(spark, path, "lang string, mean double")


@query("select printf('%08d', doc_id // 100) as part, sha256(string_agg(text || chr(10), '' order by doc_id)) as digest from documents where text is not null group by doc_id // 100")
def hsh03_file_digests(spark, d):
    """Digests of files of a hundred texts each, read a chunk at a time."""
    root = _numbered(t(spark, d, "documents").where("text is not null"), "texts", F.col("text"), "doc_id", 100)
    return digests.file_manifest(spark, root, "part-*").select(F.regexp_extract("path", "part=([0-9]+)/", 1).alias("part"), F.col("sha256").alias("digest"))


@query("select sha256(repeat('m', n_nationkey + 1)) || '  ' || case when n_nationkey % 2 = 1 then 'a/' else 'b/' end || n_name || '.mp4' as line from nation")
def snk08_sorted_manifest(spark, d):
    """Digests of files as a manifest's lines, in order of their paths."""
    root = _small_files(spark, d)
    manifest = digests.file_manifest(spark, root).where(F.col("path").endswith(".mp4")).orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("line"))
    path = folder(spark, "manifest")
    manifest.coalesce(1).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# Audits


@query("select case when n_nationkey = 3 then 'changed' when n_nationkey = 4 then 'missing' else 'unlisted' end as rule, case when n_nationkey % 2 = 1 then 'a/' else 'b/' end || n_name || '.mp4' as path from nation where n_nationkey in (3, 4, 5)")
def int01_manifest_audit(spark, d):
    """A manifest against the files: one file changed, one is listed but not there, one is there but not listed."""
    found = digests.file_manifest(spark, _small_files(spark, d)).where(F.col("path").endswith(".mp4")).select("path", "sha256")
    listed = found.where("path not like '%NATION_5.mp4'").withColumn("sha256", F.when(F.col("path").endswith("NATION_3.mp4"), "0" * 64).otherwise(F.col("sha256")))
    return records.verify_manifest(listed, found.where("path not like '%NATION_4.mp4'"))


@query("""
with p as (select printf('%08d', doc_id // 50) as part, min(doc_id // 50) as k from documents where text is not null group by doc_id // 50)
select case when k % 7 = 1 then 'changed' when k % 7 = 2 then 'missing' else 'unlisted' end as rule, case when k % 7 = 3 then 'part=' || part || '/new' else 'part=' || part end as place from p where k % 7 in (1, 2, 3)
""")
def int02_changed_inputs(spark, d):
    """Files of a run hashed before and after it: some were replaced, some went, some came."""
    root = _numbered(t(spark, d, "documents").where("text is not null"), "inputs", F.col("text"), "doc_id", 50)
    before = fixed(digests.file_manifest(spark, root, "[!_.]*"), "before")
    # A few files, one in seven: what another program does meanwhile.
    for r in before.where("cast(regexp_extract(path, 'part=([0-9]+)/', 1) as int) % 7 in (1, 2, 3)").orderBy("path").collect():
        k = int(r["path"].split("/")[0].removeprefix("part="))
        if k % 7 == 1:
            documents.replace_text(spark, f"{root}/{r['path']}", "other")
        elif k % 7 == 2:
            path, fs = located(spark, f"{root}/{r['path']}")
            fs.delete(path, False)
        else:
            documents.replace_text(spark, f"{root}/part={k:08d}/new", "n")
    found = records.verify_manifest(before.select("path", "sha256"), digests.file_manifest(spark, root, "[!_.]*"))
    return found.select("rule", F.when(F.col("rule") == "unlisted", F.col("path")).otherwise(F.split_part("path", F.lit("/"), F.lit(1))).alias("place"))


@query("select 'share' as rule, lang as key, count_if(doc_id % 2 = 0)::varchar || ' of ' || count(*) as message from documents where lang in ('de', 'en') group by lang")
def int03_recomputed_figures(spark, d):
    """A report's figures against the raw rows: two of them are off."""
    docs = t(spark, d, "documents")
    real = docs.groupBy(F.col("lang").alias("key")).agg((F.count_if(F.col("doc_id") % 2 == 0) / F.count("*")).alias("value"), F.concat_ws(" of ", F.count_if(F.col("doc_id") % 2 == 0).cast("string"), F.count("*").cast("string")).alias("told"))
    said = real.withColumn("value", F.when(F.col("key").isin("de", "en"), F.col("value") + 1e-9).otherwise(F.col("value")))
    return audits.not_recomputed(said, real, "share").drop("message").join(real.select("key", F.col("told").alias("message")), "key")


@query("select 'literal' as rule, k as key, m as message from (values ('langs', 'is ' || (select count(distinct lang) from documents) || ', expected 99'), ('extra', 'not expected'), ('lost', 'missing')) v(k, m)")
def int04_expected_literals(spark, d):
    langs = t(spark, d, "documents").agg(F.count_distinct("lang").cast("string").alias("value")).select(F.lit("langs").alias("key"), "value")
    observed = langs.unionByName(spark.createDataFrame([("extra", "1"), ("same", "x")], "key string, value string"))
    return audits.not_as_expected(observed, spark.createDataFrame([("langs", "99"), ("lost", "2"), ("same", "x")], "key string, value string"), "literal")


@query("""
select 'quality_known' as rule, doc_id::varchar as key, 'broken' as message from labels where coalesce(quality not in (0, 1), true) union all select 'not_both', doc_id::varchar, 'broken' from labels where quality = 1 and toxic = 1
union all select 'lang_counts', lang, count(*) || ' of ' || case lang when 'en' then 400 else 0 end from documents group by lang having count(*) <> case lang when 'en' then 400 else 0 end or lang <> 'en'
""")
def int05_policy_violations(spark, d):
    rules = [("quality_known", F.col("quality").isin(0, 1)), ("not_both", F.coalesce(~((F.col("quality") == 1) & (F.col("toxic") == 1)), F.lit(True)))]
    return audits.together(audits.failing(t(spark, d, "labels"), "doc_id", rules), audits.wrong_counts(t(spark, d, "documents"), "lang", {"en": 400}, "lang_counts"))


@query("""
select rule, key, 'broken' as message from (
  select 'file_there' as rule, 'f' || item_id as key from benchmark where item_id % 10 = 1 union all select 'digest', 'f' || item_id from benchmark where item_id % 10 in (2, 3)
  union all select 'digest_form', 'f' || item_id from benchmark where item_id % 10 = 3 union all select 'flag_once', '--seed') 
""")
def int06_run_manifest(spark, d):
    k = F.col("item_id")
    items = t(spark, d, "benchmark").select("item_id", F.concat(F.lit("f"), k.cast("string")).alias("path"), F.sha2("text", 256).alias("real"))
    said = F.when(k % 10 == 2, F.sha2(F.lit("other"), 256)).when(k % 10 == 3, "XYZ").otherwise(F.col("real"))
    none = F.lit(None).cast("string")
    entries = items.select(F.when(k % 2 == 0, "input").otherwise("output").alias("kind"), "path", said.alias("sha256"), none.alias("flag"), none.alias("value"))
    flags = spark.createDataFrame([("flag", None, None, "--seed", "1"), ("flag", None, None, "--seed", "2"), ("flag", None, None, "--model", "m")], entries.schema)
    return audits.run_manifest(entries.unionByName(flags), items.where("item_id % 10 <> 1").select("path", F.col("real").alias("sha256")))


@query("select 'required_file' as rule, 'gone.json' as key, 'missing' as message union all select distinct 'split_overlap', source, 'in both' from documents where source in (select source from documents where doc_id % 2 = 0) and doc_id % 2 = 1")
def int09_bundle_profile(spark, d):
    docs = t(spark, d, "documents")
    listing = documents.files(spark, _small_files(spark, d))
    return audits.bundle_profile(listing, ["a/NATION_1.mp4", "gone.json"], docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "source")


@query("""
select rule, item_id::varchar as key, 'broken' as message from (select 'in_both' as rule, item_id from benchmark where item_id % 20 = 1 union all select 'order', item_id from benchmark where item_id % 20 in (1, 2)
  union all select 'shared_prompt', item_id from benchmark where item_id % 20 in (1, 3) union all select 'search_by_category', item_id from benchmark where item_id % 20 in (1, 4))
""")
def int10_case_gold_contract(spark, d):
    k = F.col("item_id")
    cases = t(spark, d, "benchmark").select("item_id", F.col("item_id").alias("at"), F.col("text").alias("prompt"), F.when(k % 2 == 0, "search").otherwise("plain").alias("category"))
    gold = cases.where("item_id % 20 <> 1").select("item_id", F.when(k % 20 == 2, -1).otherwise(F.col("at")).alias("at"), F.when(k % 20 == 3, "other").otherwise(F.col("prompt")).alias("prompt"), ((k % 2 == 0) != (k % 20 == 4)).alias("search"))
    return audits.case_gold_contract(cases, gold, "item_id", "at", ["prompt"], "category", F.col("search"), ["search"])


@query("select rule, key, message from (select 'exit' as rule, 'r' || item_id as key, 'broken' as message from benchmark where item_id % 9 = 0 union all select 'errors', 'r' || item_id, 'broken' from benchmark where item_id % 7 = 0) union all select 'id_not_unique', 'r5', '2'")
def int11_evaluation_runs(spark, d):
    """Runs of an evaluation: how they ended, their errors, and ids that stand once."""
    k = F.col("item_id")
    runs = t(spark, d, "benchmark").select(F.concat(F.lit("r"), k.cast("string")).alias("id"), F.when(k % 9 == 0, 1).otherwise(0).alias("code"), F.when(k % 7 == 0, 3).otherwise(0).alias("n_errors"))
    ok = audits.failing(runs, "id", [("exit", F.col("code") == 0), ("errors", F.col("n_errors") == 0)])
    return audits.together(ok, audits.repeated(runs.unionByName(runs.where("id = 'r5'")), ["id"]))


@query("select 'endpoint' as rule, 'e' || n_nationkey as key, 'is ' || n_name || ', expected NATION_X' as message from nation where n_nationkey % 6 = 0")
def int12_cross_audit(spark, d):
    rows = t(spark, d, "nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"), "n_nationkey")
    expected = rows.withColumn("value", F.when(F.col("n_nationkey") % 6 == 0, "NATION_X").otherwise(F.col("value")))
    return audits.not_as_expected(rows, expected, "endpoint")


@query("select 'declared_once' as rule, 'user:' as key, count_if(role = 'user')::varchar as message from conversations having count_if(role = 'user') <> 1 union all select 'declared_once', 'nobody:', '0'")
def flt31_declared_once(spark, d):
    """Prefixes that not exactly one line of a log begins with."""
    lines = t(spark, d, "conversations").select(F.concat("role", F.lit(": "), "text").alias("value")).unionByName(spark.createDataFrame([("once: x",)], "value string"))
    return audits.declared_once(lines, ["user:", "nobody:", "once:"])


@query("select doc_id, case doc_id % 4 when 0 then n_chars::varchar end as seed from documents")
def flt32_command_flags(spark, d):
    """The value of a flag that a command names once; twice, last or not at all gives none."""
    k = F.col("doc_id") % 4
    command = F.concat(F.lit("run --model m"), F.when(k == 0, F.concat(F.lit(" --seed "), F.col("n_chars").cast("string"))).when(k == 1, " --seed 1 --seed 2").when(k == 2, " --seed").otherwise(""))
    return t(spark, d, "documents").select("doc_id", audits.flag_value(F.split(command, " "), "--seed").alias("seed"))


@query("select rule, key from (select 'unlisted' as rule, source as key from documents where lang = 'en' except select 'unlisted', source from documents where lang = 'de') union (select 'missing', source from documents where lang = 'de' except select 'missing', source from documents where lang = 'en')")
def join24_registered_artifacts(spark, d):
    """What is registered against what is found: missing and extra."""
    side = lambda lang: t(spark, d, "documents").where(F.col("lang") == lang).select(F.col("source").alias("path"), F.lit("x").alias("sha256")).distinct()
    return records.verify_manifest(side("de"), side("en")).select("rule", F.col("path").alias("key"))


# Streams and batch work


@query("select source as grp, least(5, count(distinct doc_id)) as n from documents group by source")
def stm01_bounded_pull(spark, d):
    """At most five new ids a group over two runs of a stream; the second run finds nothing more to take."""
    root = folder(spark, "stream")
    docs = t(spark, d, "documents").select("doc_id", F.col("source").alias("grp"))
    docs.unionByName(docs.where("doc_id % 3 = 0")).write.parquet(f"{root}/in")
    for _ in range(2):
        incremental.bounded_pull(spark.readStream.schema(docs.schema).parquet(f"{root}/in"), "grp", "doc_id", 5, f"{root}/out", f"{root}/state")
    return spark.read.schema(docs.schema).parquet(f"{root}/out").groupBy("grp").agg(F.count_distinct("doc_id").alias("n"))


@query("""
select doc_id, grp from (select doc_id, grp, row_number() over (partition by grp order by part, sha256('mix' || chr(31) || doc_id)) as place
  from (select doc_id, lang as grp, (doc_id % 5 >= 3)::int as part from documents)) where place <= 20
""")
def src15_shuffled_pull(spark, d):
    """20 rows a language of a stream that comes in two parts, shuffled within each; the second run goes on where the first one stopped."""
    root = folder(spark, "shuffled")
    docs = t(spark, d, "documents").select("doc_id", F.col("lang").alias("grp"))
    for rest in ("doc_id % 5 < 3", "doc_id % 5 >= 3"):
        docs.where(rest).write.mode("append").parquet(f"{root}/in")
        incremental.bounded_pull(spark.readStream.schema(docs.schema).parquet(f"{root}/in"), "grp", "doc_id", 20, f"{root}/out", f"{root}/state", "mix")
    return spark.read.schema(docs.schema).parquet(f"{root}/out")


@query("select 'good' as route, count(*) as n from labels where quality = 1 union all select 'bad', count(*) from labels where quality is distinct from 1")
def stm02_routed_batches(spark, d):
    root = folder(spark, "routed")
    labels = t(spark, d, "labels")
    labels.write.parquet(f"{root}/in")
    incremental.run_routed(spark.readStream.schema(labels.schema).parquet(f"{root}/in"), lambda df: df, F.col("quality") == 1, f"{root}/good", f"{root}/bad", f"{root}/state")
    parts = [spark.read.parquet(f"{root}/{r}").agg(F.lit(r).alias("route"), F.count("*").alias("n")) for r in ("good", "bad")]
    return parts[0].unionByName(parts[1])


def _client(prompts: list[str]) -> list[str]:
    if any("7" in p for p in prompts):
        raise RuntimeError("no sevens")
    return [f"said {p}" for p in prompts]


@query("select item_id, case when not contains(item_id::varchar, '7') then 'said p' || item_id end as answer, case when contains(item_id::varchar, '7') then 'RuntimeError: no sevens' end as error from benchmark")
def udf04_model_calls(spark, d):
    """STM-03, STM-10, UDF-03 and UDF-04: a client that fails on some prompts; its batches fall back to single items, whose errors are rows."""
    rows = t(spark, d, "benchmark").select("item_id", F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("prompt"))
    return batches.called(rows, "item_id", "prompt", _client, retries=1, at_once=8)


@query("select count(*) as n, count(distinct doc_id) as n_ids, 0::bigint as parts_left from documents")
def stm04_partial_results(spark, d):
    """Work in parts: a run that stopped after some of them goes on with the rest, and a third run has nothing to do."""
    out = folder(spark, "parts")
    docs = t(spark, d, "documents").select("doc_id", "n_chars")
    work = lambda df: df.withColumn("n", F.col("n_chars") * 2)
    batches.in_parts(docs.where("doc_id % 3 = 0"), "doc_id", work, out, 4)
    batches.in_parts(docs, "doc_id", work, out, 4)
    left = batches.in_parts(docs, "doc_id", work, out, 4)
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_ids")).withColumn("parts_left", F.lit(left).cast("long"))


@query("select n_nationkey from nation where n_nationkey % 4 = 0")
def stm05_unfinished(spark, d):
    """Rows whose output file is not there."""
    done = documents.files(spark, _small_files(spark, d), "*.txt")
    k = F.col("n_nationkey")
    return batches.unfinished(t(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", done, F.concat(F.when(k % 2 == 1, "a/").otherwise("b/"), "n_name", F.lit(".txt"))).select("n_nationkey")


@query("select step, generation from (values ('first', 0), ('second rank', 0), ('full again', 1), ('other data', 2), ('more ranks', 3)) v(step, generation)")
def stm06_generations(spark, d):
    """Which generation ranks join: a new one for other data, by the signature of all of it, for other numbers of ranks, and after all have joined."""
    g = batches.Generation(spark, folder(spark, "generation") + "/state.json")
    docs = t(spark, d, "documents")
    s, t_ = batches.signature(docs, "doc_id", ["text"]), batches.signature(docs.withColumn("text", F.upper("text")), "doc_id", ["text"])
    steps = [("first", 0, 2, s), ("second rank", 1, 2, s), ("full again", 0, 2, s), ("other data", 1, 2, t_), ("more ranks", 0, 3, t_)]
    return spark.createDataFrame([(name, g.join(rank, ranks, sign)) for name, rank, ranks, sign in steps], "step string, generation int")


@query("select 'order' as field, true as differs union all select 'rows', false")
def stm07_order_signature(spark, d):
    """A run must not go on if the order of its data changed."""
    docs = t(spark, d, "documents").select("doc_id", "source")
    sign = lambda df: {"order": batches.signature(df, "doc_id", ["source"]), "rows": str(df.count())}
    refused = batches.resume_refused(sign(docs), sign(docs.withColumn("doc_id", F.col("doc_id") + 1)))
    assert batches.resume_refused(sign(docs), sign(docs.orderBy(F.desc("doc_id")))) == []
    return spark.createDataFrame([(f, f in refused) for f in ("order", "rows")], "field string, differs boolean")


@query("select 'good' as label, 0 as code, true as timed union all select 'bad', 1, true")
def stm08_run_events(spark, d):
    """DAT-01 and STM-08: a record of each run, with its beginning in UTC, its duration and how it ended."""
    events = folder(spark, "events")
    with batches.timed(spark, events, "good"):
        t(spark, d, "nation").count()
    try:
        with batches.timed(spark, events, "bad"):
            raise KeyError("x")
    except KeyError:
        pass
    return spark.read.schema("label string, began string, seconds double, code int").json(events).select("label", "code", (F.col("began").rlike(r"^\d{4}-\d\d-\d\dT.*Z$") & (F.col("seconds") >= 0)).alias("timed"))


@query("""
with r as (select rank, total // 3 * rank + least(rank, total % 3) as first, total // 3 + (rank < total % 3)::int as size, total from (select count(*) as total from documents), (values (0), (1), (2)) v(rank))
select rank, doc_id from r, (select doc_id, row_number() over (order by doc_id) - 1 as position from documents) p where position >= first + 20 and position < first + size
""")
def win12_resumed_ranks(spark, d):
    """Three ranks take up their contiguous ranges after twenty rows; files that lie before are not opened."""
    table = positions.write_positioned(t(spark, d, "documents").select("doc_id"), ["doc_id"], folder(spark, "ranks"), 16)
    parts = [table.read(spark, [positions.rank_range(table.rows, 3, k, 20)]).select(F.lit(k).alias("rank"), "doc_id") for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
with c as (select least((select count(*) from benchmark) // 2 // 1, (select count(*) from part) // 2 // 2) as cycles), n as (select count(*) as b from benchmark), m as (select count(*) as p from part),
s as (select unnest(range((select cycles * 3 from c))) as slot), k as (select slot, (slot + 1) % 3 as spot, slot // 3 as cycle from s)
select slot, case when spot = 1 then 'items' else 'parts' end as loader,
  case when spot = 1 then (select b // 2 + least(1, b % 2) from n) + cycle else (select p // 2 + least(1, p % 2) from m) + cycle * 2 + case when spot = 2 then 0 else 1 end end as position
from k where slot >= 7
""")
def win13_resumed_mix(spark, d):
    """The second of two staggered ranks takes up a mix of parts, items, parts at its eighth place."""
    tables = {"items": positions.write_positioned(t(spark, d, "benchmark").select("item_id"), ["item_id"], folder(spark, "items"), 4), "parts": positions.write_positioned(t(spark, d, "part").select("p_partkey"), ["p_partkey"], folder(spark, "parts"), 64)}
    return positions.mixed(spark, tables, ["parts", "items", "parts"], ranks=2, rank=1, staggered=True, skip=7)


_MEDIA = "case when n_nationkey % 2 = 1 then 'a/' else 'b/' end || n_name || case when n_nationkey % 6 = 5 then '.mov' else '.mp4' end"


@query(f"""
select case when n_nationkey % 6 = 5 then 'missing' when n_nationkey + 1 < 8 then 'too_small' else 'changed' end as rule, {_MEDIA} as key,
  case when n_nationkey % 6 = 5 then 'has no bytes' else 'has ' || n_nationkey + 1 || ' bytes' end as message
from nation where n_nationkey % 6 = 5 or n_nationkey + 1 < 8 or n_nationkey % 5 = 4
""")
def flt20_media_checks(spark, d):
    """Media that cases name: whether they are there, large enough, and what they were."""
    k = F.col("n_nationkey")
    path = F.concat(F.when(k % 2 == 1, "a/").otherwise("b/"), "n_name", F.when(k % 6 == 5, ".mov").otherwise(".mp4"))
    content = F.repeat(F.lit("m"), (k + 1).cast("int"))
    wanted = t(spark, d, "nation").select(path.alias("path"), F.lit(8).alias("least"), F.when(k % 5 == 4, F.sha2(F.lit("other"), 256)).when(k % 5 > 0, F.sha2(content, 256)).alias("sha256"))
    return audits.media_faults(wanted, digests.file_manifest(spark, _small_files(spark, d)))