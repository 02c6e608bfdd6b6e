"""Registered queries of projections, predicates, joins and scalars that build and check records."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import lexicon, numbers, text
from siltstone.functions.exact import py_round
from siltstone.operators import audits, digests, metrics, ranking, relations, selection, transforms
from siltstone.operators.exact_sums import exact_statistics
from siltstone.plans.catalog import _WORDS, query, t
from siltstone.sources.shared import fixed

# Projections and row transforms


@query("select 'web_' || nullif(trim(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), '') as sample_id, 'clips/' || page_id || '.mp4' as video_path, coalesce(case when page_id % 2 = 0 then 'even' end, 'web') as subset, case page_id % 3 when 0 then 'cc-by' when 1 then 'cc0' else 'consult upstream dataset terms' end as license from pages")
def prj02_manifest_rows(spark, d):
    """Nested samples as flat rows of a manifest; a licence that is not in the table gets the default."""
    k = F.col("page_id")
    sample = F.struct(F.col("url").alias("__key__"), F.struct(F.when(k % 2 == 0, "even").alias("subset"), F.concat(F.lit("set"), (k % 3).cast("string")).alias("config")).alias("json"))
    licenses = F.create_map(F.lit("set0"), F.lit("cc-by"), F.lit("set1"), F.lit("cc0"))
    rows = t(spark, d, "pages").select("page_id", sample.alias("s"))
    return rows.select(
        text.safe_id(F.col("s")["__key__"], None, F.lit("web")).alias("sample_id"), F.concat(F.lit("clips/"), k.cast("string"), F.lit(".mp4")).alias("video_path"),
        F.coalesce(F.col("s.json.subset"), F.lit("web")).alias("subset"), F.coalesce(F.try_element_at(licenses, F.col("s.json.config")), F.lit("consult upstream dataset terms")).alias("license"),
    )


@query("""
with r as (select doc_id, case doc_id % 4 when 0 then 'Please remove' when 1 then 'Add' when 2 then 'REPLACE' else 'Change' end || '  the ' || source || '.' as request, ('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint % 5 as pick from documents),
f as (select doc_id, pick, regexp_replace(rtrim(trim(request), '.'), '\\s+', ' ', 'g') as x from r),
p as (select doc_id, case pick when 0 then x when 1 then regexp_replace(x, '(?i)^(Please\\s+)?Remove\\b', 'get rid of') when 2 then regexp_replace(x, '(?i)^(Please\\s+)?Add\\b', 'put') when 3 then regexp_replace(x, '(?i)^(Please\\s+)?Replace\\b', 'swap') else regexp_replace(x, '(?i)^(Please\\s+)?Change\\b', 'make') end as y from f)
select doc_id, lower(substr(y, 1, 1)) || substr(y, 2) as request from p
""")
def prj10_paraphrases(spark, d):
    k = F.col("doc_id")
    verb = F.get(F.array(*(F.lit(x) for x in ("Please remove", "Add", "REPLACE", "Change"))), (k % 4).cast("int"))
    request = F.concat(verb, F.lit("  the "), "source", F.lit("."))
    return t(spark, d, "documents").select("doc_id", text.paraphrase(k.cast("string"), request, numbers.hash_choice(k.cast("string"), 5)).alias("request"))


_HIT = "case when page_id % 5 < {0} then '' else '{1}' || page_id end"


@query("select page_id, coalesce(nullif(case when page_id % 5 < 3 then '' else 'a' || page_id end, ''), nullif(case when page_id % 5 < 2 then '' else 'b' || page_id end, ''), nullif(case when page_id % 5 < 1 then null else 'c' || page_id end, ''), '') as image_url, coalesce(nullif(trim(case when page_id % 2 = 0 then ' ' else 't' end), ''), 'image') as title from pages where page_id % 5 >= 1")
def prj12_search_hits(spark, d):
    """Hits of a search, whose image, title and page stand under one of several names; hits without an image go."""
    k, i = F.col("page_id") % 5, F.col("page_id").cast("string")
    hit = t(spark, d, "pages").select("page_id", F.when(k < 3, "").otherwise(F.concat(F.lit("a"), i)).alias("imageUrl"), F.when(k < 2, "").otherwise(F.concat(F.lit("b"), i)).alias("image_url"), F.when(k >= 1, F.concat(F.lit("c"), i)).alias("url"), F.when(F.col("page_id") % 2 == 0, " ").otherwise("t").alias("title"))
    image = text.first_filled(F.col("imageUrl"), F.col("image_url"), F.col("url"))
    return hit.select("page_id", image.alias("image_url"), F.coalesce(F.nullif(text.strip(F.col("title")), F.lit("")), F.lit("image")).alias("title")).where("image_url <> ''")


@query("select doc_id, case when doc_id % 3 = 0 and doc_id % 2 = 1 then trim(source) || ' logo' when doc_id % 2 = 0 then source || ' LOGO' else source end as query from documents")
def prj13_refined_query(spark, d):
    k = F.col("doc_id")
    asked = F.concat(F.lit(" "), "source", F.when(k % 2 == 0, " LOGO ").otherwise("  "))
    return t(spark, d, "documents").select("doc_id", text.refined_query(asked, F.when(k % 3 == 0, "put the Logo there").otherwise("nothing")).alias("query"))


@query("select 'interp_' || lpad((row_number() over (order by item_id) - 1)::varchar, 4, '0') as bench_id, item_id, 'plan ' || item_id as wish, item_id % 2 = 0 as search from benchmark")
def prj15_case_and_gold(spark, d):
    """Cases with nested gold plans, named by their place."""
    items = ranking.with_positions(t(spark, d, "benchmark").select("item_id"), ["item_id"])
    gold = F.struct(F.concat(F.lit("plan "), F.col("item_id").cast("string")).alias("refined_text_instruction"), (F.col("item_id") % 2 == 0).alias("image_search"))
    rows = items.select(F.format_string("interp_%04d", "_pos").alias("bench_id"), "item_id", gold.alias("gold_plan"))
    return rows.select("bench_id", "item_id", F.col("gold_plan.refined_text_instruction").alias("wish"), F.col("gold_plan.image_search").alias("search"))


@query("select doc_id, source, 'combined_tasks' as subtask, null::varchar as image_search, 0 as n_messages from documents")
def prj16_default_records(spark, d):
    blank = F.struct(F.lit("combined_tasks").alias("subtask"), F.lit(None).cast("string").alias("image_search"), F.array().cast("array<string>").alias("messages"))
    return t(spark, d, "documents").select("doc_id", "source", blank.alias("r")).select("doc_id", "source", "r.subtask", "r.image_search", F.size("r.messages").alias("n_messages"))


@query("select doc_id, case lang when 'en' then 16 else 24 end as fps from documents where lang in ('en', 'fr') union all select -1, count(distinct lang) from documents where lang not in ('en', 'fr')")
def prj17_config_by_tag(spark, d):
    """Rows with their tag's configuration; tags without one are counted under -1."""
    config = spark.createDataFrame([("en", 16), ("fr", 24)], "lang string, fps int")
    rows, unknown = transforms.with_config(t(spark, d, "documents").select("doc_id", "lang"), config, "lang")
    return rows.select("doc_id", F.col("fps").cast("long").alias("fps")).unionByName(unknown.agg(F.lit(-1).cast("long").alias("doc_id"), F.count("*").alias("fps")))


@query("select event_id, coalesce(nullif(case when event_id % 3 = 0 then '' else event_type end, ''), 'user ' || user_id) as prompt from events")
def prj18_mapped_fields(spark, d):
    """Fields by precedence of their names, and none may be missing."""
    rows = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("instruction"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("prompt"))
    mapped = rows.select("event_id", text.first_filled(F.col("instruction"), F.col("prompt")).alias("prompt"))
    return mapped.where(text.not_blank(F.col("prompt")))


@query("select page_id, case page_id % 4 when 0 then '/data/' || page_id || '.PNG' when 1 then 'video:' || page_id || '.mp4' when 2 then 'other' end as loaded, page_id + 1 as n, [page_id + 0.5::double] as x from pages")
def prj19_operator_pipelines(spark, d):
    """PRJ-19 and UDF-01: steps chained with >>, chosen by the suffix of a name and by the type of a column."""
    k = F.col("page_id")
    name = F.concat(k.cast("string"), F.get(F.array(F.lit(".PNG"), F.lit(".mp4"), F.lit(".txt"), F.lit("")), (k % 4).cast("int")))
    load = transforms.by_suffix({("png", "jpg"): transforms.to_text >> transforms.to_absolute("/data"), ("mp4",): transforms.Step(lambda c: F.concat(F.lit("video:"), c)), ("txt",): transforms.Step(lambda c: F.lit("other"))})
    rows = t(spark, d, "pages").select("page_id", name.alias("name"), k.alias("n"), (k + 0.5).cast("double").alias("x"))
    by_kind = transforms.by_type({"bigint": transforms.Step(lambda c: c + 1), "double": transforms.to_list >> transforms.each(transforms.to_double), "string": load}, dict(rows.dtypes))
    return rows.select("page_id", by_kind("name").alias("loaded"), by_kind("n").alias("n"), by_kind("x").alias("x"))


@query("select doc_id, case when doc_id % 3 = 0 or doc_id % 5 = 0 then 'first' else 'none' end as start_tag from documents")
def prj21_start_tags(spark, d):
    k = F.col("doc_id")
    name, path = F.when(k % 3 == 0, "ditto_x").otherwise("x_ditto"), F.when(k % 5 == 0, "a/insv2v/b").otherwise("a/b")
    return t(spark, d, "documents").select("doc_id", F.when(name.startswith("ditto") | path.contains("/insv2v/"), "first").otherwise("none").alias("start_tag"))


@query("select conv_id, count(*) as n, count(distinct text) as n_distinct from conversations where role = 'user' and trim(text) <> '' group by conv_id")
def prj22_gathered_values(spark, d):
    """Prompts of a record from several optional fields and the messages of a role, as rows."""
    said = t(spark, d, "conversations").select("conv_id", "turn", F.array_compact(F.array(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "nobody", F.col("text")))).alias("values"))
    rows = said.select("conv_id", F.explode("values").alias("value")).where(F.trim("value") != "")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"))


@query("select doc_id, case when doc_id % 2 = 0 then 'red ' || source || ' 2' else 'red ' || source || ' 1' end as request from documents")
def prj23_values_by_type(spark, d):
    """A request from a map of constraint types; of a type that stands twice the last value counts."""
    c = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    held = F.array(c("color", F.lit("red")), c("count", F.lit("1")), c("object", F.col("source")), c("count", F.when(F.col("doc_id") % 2 == 0, "2").otherwise("1")))
    m = t(spark, d, "documents").select("doc_id", transforms.typed_values(held).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("doc_id", F.concat_ws(" ", get("color"), get("object"), get("count")).alias("request"))


@query("select doc_id, n_chars + 0.5::double as average, 2 as n_scores, 'line one' || chr(10) || source as response from documents")
def prj25_typed_score_rows(spark, d):
    """Cached score rows as they were written: numbers as texts, lists as JSON, line breaks escaped."""
    row = t(spark, d, "documents").select("doc_id", F.concat(F.col("n_chars").cast("string"), F.lit(".5")).alias("average"), F.concat(F.lit("["), F.col("n_chars").cast("string"), F.lit(", 1.5]")).alias("scores"), F.concat(F.lit("line one\\n"), "source").alias("response"))
    return row.select("doc_id", F.col("average").cast("double").alias("average"), F.size(F.from_json("scores", "array<double>")).alias("n_scores"), F.replace("response", F.lit("\\n"), F.lit("\n")).alias("response"))


@query("select doc_id, coalesce(case when doc_id % 3 = 0 then 'own' end, case when doc_id % 2 = 0 then 'found' end) as asset from documents where doc_id % 3 = 0 or doc_id % 2 = 0")
def prj26_resolved_assets(spark, d):
    """The asset of a pair: its own or the one that was found; pairs without either are violations, which flt30 counts."""
    k = F.col("doc_id")
    return t(spark, d, "documents").select("doc_id", F.coalesce(F.when(k % 3 == 0, "own"), F.when(k % 2 == 0, "found")).alias("asset")).where("asset is not null")


@query(f"select doc_id, coalesce(case when doc_id % 2 = 0 then lower(source) end, lower(lang)) as concept_id, 'prompt_' || substr(sha256(lower(source) || ' ' || lang), 1, 16) as template_id from documents")
def prj27_built_rows(spark, d):
    """Concept and template ids: the searched thing or else the wish, and a prefix of the normalised prompt's hash."""
    concept = F.coalesce(F.when(F.col("doc_id") % 2 == 0, text.normalize(F.col("source"))), text.normalize(F.col("lang")))
    prompt = text.normalize(F.concat("source", F.lit(",  "), "lang"))
    return t(spark, d, "documents").select("doc_id", concept.alias("concept_id"), F.concat(F.lit("prompt_"), F.substring(F.sha2(prompt, 256), 1, 16)).alias("template_id"))


@query("select item_id, 'v/' || item_id || '.mp4' as video, text as prompt, 1 as n_refs from benchmark")
def prj28_editor_records(spark, d):
    i = F.col("item_id").cast("string")
    base = F.struct(F.concat(F.lit("v/"), i, F.lit(".mp4")).alias("video"), F.col("text").alias("prompt"), F.array(F.concat(F.lit("r/"), i)).alias("refs"))
    return t(spark, d, "benchmark").select("item_id", base.alias("b")).select("item_id", "b.video", "b.prompt", F.size("b.refs").alias("n_refs"))


@query("select 'p' || n_nationkey as path, case n_nationkey % 4 when 0 then '/a/p' || n_nationkey when 1 then '/b/p' || n_nationkey end as at_path, case n_nationkey % 4 when 2 then 2 when 3 then 0 end as n from nation")
def prj29_resolved_paths(spark, d):
    """Relative paths against two roots: one place is right, none or two are errors."""
    k, p = F.col("n_nationkey") % 4, F.concat(F.lit("p"), F.col("n_nationkey").cast("string"))
    rows = t(spark, d, "nation").select("n_nationkey", p.alias("path"))
    places = F.array_compact(F.array(F.when(k.isin(0, 2), F.concat(F.lit("/a/"), "path")), F.when(k.isin(1, 2), F.concat(F.lit("/b/"), "path"))))
    good, bad = transforms.resolved(rows.select("path"), "path", rows.select(F.explode(places).alias("path")), ["/a", "/b/"])
    none = F.lit(None)
    return good.select("path", F.col("at").alias("at_path"), none.cast("long").alias("n")).unionByName(bad.select("path", none.cast("string").alias("at_path"), "n"))


@query("select doc_id, '{\"source\":\"' || source || '\",\"plan\":{\"lang\":\"' || lang || '\",\"mask\":null},\"n\":[' || n_chars || ',1]}' as record from documents")
def prj05_compact_json(spark, d):
    """Nested records in compact JSON, in the order of their fields and with nulls."""
    plan = F.struct("lang", F.lit(None).cast("string").alias("mask"))
    return t(spark, d, "documents").select("doc_id", F.to_json(F.struct("source", plan.alias("plan"), F.array("n_chars", F.lit(1).cast("long")).alias("n")), {"ignoreNullFields": "false"}).alias("record"))


@query("select p_partkey, regexp_full_match(lower(p_brand), 'brand#.+?1.+?') or lower(p_brand) = 'brand#2' as matches from part")
def flt13_signature_match(spark, d):
    """Does a text match one of two signatures, of which one has slots?"""
    brand = F.lower("p_brand")
    tests = [F.rlike(brand, text.signature_pattern(F.lit(s))) for s in ("brand#__slot__1__slot__", "brand#2")]
    return t(spark, d, "part").select("p_partkey", (tests[0] | tests[1]).alias("matches"))


# Filters and predicates


@query("""
with d as (select doc_id, n_chars % 6 as n_refs from documents), v as (select doc_id, n_refs, row_number() over (order by doc_id) - 1 as place, count(*) over () as n from d where n_refs <= 3)
select d.doc_id, v.doc_id as taken, v.n_refs from d join v on case when d.n_refs <= 3 then v.doc_id = d.doc_id else v.place = ('0x' || substr(sha256('again' || chr(31) || d.doc_id), 1, 8))::bigint % v.n end
""")
def flt07_reference_limit(spark, d):
    """Rows with at most three reference images; for one with more another row is taken, by a hash of its id."""
    rows = t(spark, d, "documents").select("doc_id", (F.col("n_chars") % 6).alias("n_refs"))
    return selection.resampled(rows, "doc_id", F.col("n_refs") <= 3, "again").select("doc_id", "taken", "n_refs")


@query("select id, known from (select doc_id as id, true as known from documents where doc_id in (select o_custkey from orders) union select o_custkey, false from orders where o_custkey not in (select doc_id from documents))")
def flt18_id_list(spark, d):
    """Rows of a list of ids, and the ids of the list that no row has."""
    docs, wanted = t(spark, d, "documents").select(F.col("doc_id").alias("id")), t(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return docs.join(wanted, "id", "left_semi").distinct().withColumn("known", F.lit(True)).unionByName(wanted.join(docs, "id", "left_anti").withColumn("known", F.lit(False)))


@query("select page_id, regexp_matches(lower(regexp_replace(u, '[?#].*$', '')), '\\.(png|jpe?g|webp|gif|bmp)$') as image, octet_length(encode(html)) >= 1024 as large_enough from (select page_id, html, case page_id % 3 when 0 then url else 'http://h/' || page_id || case page_id % 3 when 1 then '.JPG?w=1' else '.html' end end as u from pages)")
def flt23_candidate_shape(spark, d):
    k = F.col("page_id") % 3
    url = F.when(k == 0, F.col("url")).otherwise(F.concat(F.lit("http://h/"), F.col("page_id").cast("string"), F.when(k == 1, ".JPG?w=1").otherwise(".html")))
    return t(spark, d, "pages").select("page_id", text.looks_like_image(url).alias("image"), (F.octet_length("html") >= 1024).alias("large_enough"))


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by case when doc_id % 3 = 0 then 999.0 else n_chars + doc_id / 1e7 end) as k from documents where lang in ('en', 'fr') and n_chars % 5 <> 0) where k = 1 and doc_id % 3 <> 0")
def flt24_first_candidate(spark, d):
    """Of each source the candidate of lowest index with an allowed type and a licence mark; those without an index count as 999."""
    k = F.col("doc_id")
    rows = t(spark, d, "documents").select("source", "doc_id", F.when(k % 3 != 0, F.col("n_chars") + k / 1e7).alias("index"), "lang", F.when(F.col("n_chars") % 5 == 0, "all rights").otherwise("CC BY 4.0").alias("licence"))
    ok = F.col("lang").isin("en", "fr") & F.col("licence").startswith("CC")
    first = transforms.lowest_with(rows, "source", "index", ok, 999)
    return first.where("index is not null").select("source", "doc_id")


@query(f"select doc_id from documents where doc_id % 3 = 1 and doc_id % 4 <> 0 and ' ' || lower(source) || ' ' || lang not in (select ' ' || lower(source) || ' ' || lang from documents where doc_id % 50 = 0)")
def flt26_original_like(spark, d):
    """Rows without violations and search whose prompt is none of the templates'."""
    k = F.col("doc_id")
    docs = t(spark, d, "documents").select("doc_id", text.normalize(F.concat("source", F.lit(" "), "lang")).alias("prompt"))
    templates = docs.where(k % 50 == 0).select("prompt").distinct()
    return docs.where((k % 3 == 1) & (k % 4 != 0)).join(templates, "prompt", "left_anti").select("doc_id")


@query("select doc_id from documents where doc_id % 2 = 0 or n_chars % 3 = 0")
def flt27_any_condition(spark, d):
    video, refs = F.when(F.col("doc_id") % 2 == 0, "v").otherwise(""), F.when(F.col("n_chars") % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return t(spark, d, "documents").where(transforms.any_condition(video != "", F.size(refs) > 0)).select("doc_id")


@query("select doc_id, list_filter([case when doc_id % 5 = 0 then 'height' end, case when doc_id % 7 = 0 then 'frames' end], lambda x: x is not null) as differing from documents")
def flt28_paired_sizes(spark, d):
    """Sizes of a source and its target that differ, by name."""
    k = F.col("doc_id")
    pairs = [("width", F.lit(640), F.lit(640)), ("height", F.lit(480), F.when(k % 5 == 0, 481).otherwise(480)), ("frames", F.lit(81), F.when(k % 7 != 0, 81))]
    return t(spark, d, "documents").select("doc_id", relations.violations([(n, ~a.eqNullSafe(b)) for n, a, b in pairs]).alias("differing"))


@query("select doc_id from documents where lang = 'de' or source = 'src3'")
def flt29_forbidden_on_specs(spark, d):
    """Specs whose rendered text holds a forbidden phrase."""
    spec = text.normalize(F.concat_ws(" ", F.lit("make it"), "source", F.lit("in"), "lang"))
    return t(spark, d, "documents").where(relations.forbidden_phrases(spec, ["src3", "in de"])).select("doc_id")


@query("select rule, count(*) as n from (select unnest(list_filter([case when doc_id % 4 = 1 then 'digest' end, case when doc_id % 5 = 0 then 'finite' end, case when n_chars % 9 = 0 then 'positive' end], lambda x: x is not null)) as rule from documents) group by rule")
def flt30_scalar_guards(spark, d):
    """Digests of 64 hexadecimal digits, finite numbers, positive whole numbers: violations by rule."""
    k = F.col("doc_id")
    digest, number, count = F.when(k % 4 == 1, "0" * 63 + "G").otherwise(F.sha2("source", 256)), F.when(k % 5 == 0, float("nan")).otherwise(1.5), F.col("n_chars") % 9
    rules = [("digest", digest.rlike("^[0-9a-f]{64}$")), ("finite", ~F.isnan(number) & (F.abs(number) < float("inf"))), ("positive", count > 0)]
    return audits.failing(t(spark, d, "documents"), "doc_id", rules).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"select doc_id, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' like '% la %' as has_term from documents")
def str04_padded_terms(spark, d):
    return t(spark, d, "documents").select("doc_id", text.padded(text.normalize(F.col("text"))).contains(" la ").alias("has_term"))


# Joins


_ID = "original || '|' || result"


@query("""
with todo as (select doc_id as idx, lang as original, source || (doc_id % 40) as result from documents), dup as (select original, result from todo group by all having count(*) > 1),
scored as (select doc_id as pos, case when doc_id % 3 <> 0 then doc_id end as idx, case when doc_id % 10 = 1 then 'changed' else lang end as original, source || (doc_id % 40) as result, n_chars as score from documents),
by_idx as (select s.idx, s.score from scored s join todo t on t.idx = s.idx and t.original = s.original and t.result = s.result),
by_id as (select t.idx, s.score, s.pos from scored s join todo t on t.original = s.original and t.result = s.result where s.idx is null and (t.original, t.result) not in (select (original, result) from dup))
select t.idx, coalesce(a.score, b.score) as score from todo t left join by_idx a on a.idx = t.idx left join (select idx, max_by(score, pos) as score from by_id group by idx) b on b.idx = t.idx
""")
def join15_resumed_scores(spark, d):
    """Earlier scores by index if their row is still the same, else (for rows without an index) by an identity that is unique."""
    k = F.col("doc_id")
    docs = t(spark, d, "documents")
    result = F.concat("source", (k % 40).cast("string"))
    todo = docs.select(k.alias("idx"), F.col("lang").alias("original"), result.alias("result"))
    scored = docs.select(k.alias("pos"), F.when(k % 3 != 0, k).alias("idx"), F.when(k % 10 == 1, "changed").otherwise(F.col("lang")).alias("original"), result.alias("result"), F.col("n_chars").alias("score"))
    return relations.resume_by_identity(todo, scored, "idx", ["original", "result"], "pos", "score").select("idx", "score")


@query("select source, max(case when lang = 'en' then n end) as a, max(case when lang = 'fr' then n end) as b from (select source, lang, count(*) as n from documents where lang in ('en', 'fr') group by all) group by source having count(*) = 2")
def join20_paired_factors(spark, d):
    """Both factors of each root; roots with one factor only are violations."""
    counts = t(spark, d, "documents").where(F.col("lang").isin("en", "fr")).groupBy("source", "lang").agg(F.count("*").alias("n"))
    whole, _ = transforms.paired_factors(counts, "source", "lang", ("en", "fr"), "n")
    return whole.select("source", F.col("en").alias("a"), F.col("fr").alias("b"))


@query("select n_name, p_type, size from nation, (select distinct p_type from part), (select distinct p_size as size from part where p_size < 4)")
def join22_catalog_product(spark, d):
    """Every nation with every type and small size that the parts have: tables of a few values, whose number is checked."""
    part = t(spark, d, "part")
    return relations.product([t(spark, d, "nation").select("n_name"), part.select("p_type").distinct(), part.where("p_size < 4").select(F.col("p_size").alias("size")).distinct()])


@query("select doc_id, case when source = 'src1' then 'first' when source in ('src2', 'src3') then 'second' end as grp from documents where source in ('src1', 'src2', 'src3')")
def join23_entity_groups(spark, d):
    """Entities by their normalised names, in the first group that has the name."""
    catalog = spark.createDataFrame([(0, "first", "SRC1"), (1, "second", "Src1 "), (1, "second", "src2"), (1, "second", "src3")], "ord int, grp string, entity string")
    names = catalog.select(text.normalize(F.col("entity")).alias("name"), "ord", "grp").groupBy("name").agg(F.min_by("grp", "ord").alias("grp"))
    return t(spark, d, "documents").select("doc_id", text.normalize(F.col("source")).alias("name")).join(F.broadcast(names), "name").select("doc_id", "grp")


@query("select doc_id, n from (select doc_id, (doc_id in (select doc_id from labels where quality = 1))::int + (doc_id in (select item_id from benchmark))::int + (doc_id in (select page_id from pages where page_id % 3 = 0))::int as n from documents) where n <> 1")
def join25_exactly_one_place(spark, d):
    """Candidates that lie in none or in several of the places where exactly one may hold them."""
    places = [t(spark, d, "labels").where("quality = 1").select("doc_id"), t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), t(spark, d, "pages").where("page_id % 3 = 0").select(F.col("page_id").alias("doc_id"))]
    return relations.not_exactly_one(t(spark, d, "documents").select("doc_id"), places, "doc_id")


# Aggregations and sets


@query("select lang, count(*) as n, count(distinct doc_id % 100) as n_distinct, count(distinct doc_id % 100) / 100.0::double as coverage, min(doc_id % 100) as low, max(doc_id % 100) as high, " + ", ".join(f"count_if(least(4, (doc_id % 100) * 4 // 100 + 1) = {q}) as q{q}" for q in (1, 2, 3, 4)) + " from documents group by grouping sets ((), (lang))")
def agg15_calibration_audit(spark, d):
    """How well rows cover the sources, over all and by category."""
    return metrics.audit(t(spark, d, "documents").select((F.col("doc_id") % 100).alias("at"), "lang"), "at", 100, ["lang"], overall=True)


@query("select distinct lower(source) as phrase from documents where lang = 'fr' union select 'default one' union select 'default two'")
def agg30_forbidden_sets(spark, d):
    """Forbidden concepts of case rows, with the fixed ones."""
    rows = t(spark, d, "documents").where("lang = 'fr'").select(text.normalize(F.col("source")).alias("phrase"))
    return rows.unionByName(spark.createDataFrame([("default one",), ("default two",)], "phrase string")).distinct()


@query("select 'counts' as rule, toxic::varchar as key, n || ' of ' || want as message from (select coalesce(l.toxic, w.toxic) as toxic, coalesce(n, 0) as n, coalesce(want, 0) as want from (select toxic::varchar as toxic, count(*) as n from labels where toxic is not null group by 1) l full join (values ('0', (select count(*) from labels where toxic = 0)), ('1', 7), ('2', 1)) w(toxic, want) on l.toxic = w.toxic) where n <> want")
def agg31_expected_counts(spark, d):
    labels = t(spark, d, "labels").where("toxic is not null").select(F.col("toxic").cast("string").alias("toxic"))
    clean = labels.where("toxic = '0'").count()
    return audits.wrong_counts(labels, "toxic", {"0": clean, "1": 7, "2": 1}, "counts")


@query("""
with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(source || ' la de the'), '[a-z0-9]+')) as b from documents)
select doc_id, len(list_intersect(a, b)) as both_have, len(a) - len(list_intersect(a, b)) as only_text, len(a) + len(b) - len(list_intersect(a, b)) as either from w
""")
def set08_token_sets(spark, d):
    """What two texts' token sets share, what only one has, and all of both."""
    a, b = text.ascii_token_set(F.coalesce("text", F.lit(""))), text.ascii_token_set(F.concat("source", F.lit(" la de the")))
    sets = t(spark, d, "documents").select("doc_id", a.alias("a"), b.alias("b"))
    n = lambda c: F.size(c).cast("long")
    return sets.select("doc_id", n(F.array_intersect("a", "b")).alias("both_have"), n(F.array_except("a", "b")).alias("only_text"), n(F.array_union("a", "b")).alias("either"))


# Scalars


@query("select p_partkey, case when p_name like '% ring' or p_name = 'ring' then regexp_replace(p_name, 'ring$', 'ringes') else p_name || 's' end as plural from part")
def str10_pluralize(spark, d):
    """Names of one and of several words, with an irregular last word."""
    return t(spark, d, "part").select("p_partkey", text.pluralize(F.col("p_name"), {"ring": "ringes"}).alias("plural"))


@query("select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' as root from pages")
def str14_host_roots(spark, d):
    return t(spark, d, "pages").select("page_id", F.concat(F.coalesce(text.host_root(F.col("url")), F.lit("https://www.google.com")), F.lit("/")).alias("root"))


@query("select doc_id, doc_id % 6 not in (0, 1, 2, 3) as enabled from documents")
def json08_enabled_flags(spark, d):
    """Null, "", "false" and "False" are off; "no" and "0" are on."""
    flag = F.get(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("false"), F.lit("False"), F.lit("no"), F.lit("0")), (F.col("doc_id") % 6).cast("int"))
    return t(spark, d, "documents").select("doc_id", text.is_enabled(flag).alias("enabled"))


@query("select doc_id, sha256(source) as content, md5(lang) as url, substr(sha256(lang || source), 1, 12) as token from documents")
def hsh03_digests(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("source", 256).alias("content"), F.md5("lang").alias("url"), F.substring(F.sha2(F.concat("lang", "source"), 256), 1, 12).alias("token"))


@query("select lang, case when count(l.quality) = 0 then 0.0 else sum(l.quality) / count(l.quality) end::double as zero, case when count(l.quality) = 0 then 1.0 else sum(l.quality) / count(l.quality) end::double as one, sum(l.quality) / nullif(count(l.quality), 0)::double as none from (select lang, quality from documents d left join labels l on d.doc_id = l.doc_id union all select 'zz', null) l group by lang")
def mth01_safe_ratios(spark, d):
    """Ratios of a group without rows: 0, 1 or nothing, as the metric says."""
    joined = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("lang", "quality").unionByName(spark.createDataFrame([("zz", None)], "lang string, quality int"))
    s = joined.groupBy("lang").agg(F.coalesce(F.sum("quality"), F.lit(0)).alias("a"), F.count("quality").alias("b"))
    return s.select("lang", *(numbers.ratio(F.col("a"), F.col("b"), x).alias(n) for n, x in (("zero", 0.0), ("one", 1.0), ("none", None))))


#: Thousandths at two places: a tie in decimals is none in binary, where it is above or below by what the double is exactly.
_THOUSANDTH = "floor(i / 10) + case when i % 10 > 5 then 1 when i % 10 < 5 then 0 when exact > half then 1 when exact < half then 0 else floor(i / 10) % 2 end"


@query(f"""
select o_orderkey, round_even(o_totalprice / 8, 0)::double as whole, (o_orderkey % 8 / 8.0 * 8)::double as eighths, ({_THOUSANDTH})::double / 100 as thousandths, 2.67::double as two, 1.0::double as one
from (select *, o_orderkey % 1000 as i, ((o_orderkey % 1000)::double / 1000 * 2.0::double ** 60)::hugeint * 1000 as exact, (o_orderkey % 1000)::hugeint << 60 as half from orders)
""")
def mth02_python_rounding(spark, d):
    """round() as Python does it, of the exact binary value: halves go to even, and 2.675 and 1.005 are below their decimal forms."""
    k = F.col("o_orderkey")
    rounded = {"whole": (F.col("o_totalprice") / 8, 0), "eighths": (k % 8 / 8.0 * 8, 1), "thousandths": ((k % 1000).cast("double") / 1000, 2), "two": (F.lit(2.675), 2), "one": (F.lit(1.005), 2)}
    return t(spark, d, "orders").select("o_orderkey", *(py_round(x, n).alias(name) for name, (x, n) in rounded.items()))


@query("select doc_id, [round_even(i * (n - 1) / 7.0::double, 0)::bigint for i in range(8)] as positions from (select doc_id, greatest(1, n_chars) as n from documents)")
def mth03_resample_positions(spark, d):
    return t(spark, d, "documents").select("doc_id", numbers.resample_positions(F.greatest("n_chars", F.lit(1)), 8).alias("positions"))


@query("select doc_id, range(0, n, greatest(1, n // 3)) as strided, [i * greatest(1, n // 3) for i in range(3)] as exactly from (select doc_id, greatest(1, n_chars % 50) as n from documents)")
def mth04_sampled_frames(spark, d):
    """Frames at every third of a clip, which can be more than three, and exactly three."""
    n = F.greatest(F.lit(1).cast("long"), F.col("n_chars") % 50)
    return t(spark, d, "documents").select("doc_id", numbers.strided_frames(n, 3).alias("strided"), numbers.spaced_frames(n, 3).alias("exactly"))


@query("select doc_id, n - (n - 1) % 4 as aligned from (select doc_id, greatest(1, n_chars) as n from documents)")
def mth05_aligned_lengths(spark, d):
    return t(spark, d, "documents").select("doc_id", numbers.align_frames(F.greatest(F.lit(1).cast("long"), "n_chars")).alias("aligned"))


@query("select p_partkey, (floor(h / s / 16) * 16)::bigint as height, (floor(w / s / 16) * 16)::bigint as width from (select p_partkey, p_size * 40 as h, p_size * 70 as w, greatest(1.0, sqrt(p_size * 40 * p_size * 70 / 400000.0::double)) as s from part)")
def mth06_pixel_budget(spark, d):
    fit = numbers.fit_pixels(F.col("p_size") * 40, F.col("p_size") * 70, 400_000)
    return t(spark, d, "part").select("p_partkey", fit.alias("f")).select("p_partkey", "f.height", "f.width")


@query("select doc_id, least(4, doc_id * 4 // t + 1) as quarter from documents, (select max(doc_id) + 1 as t from documents)")
def mth07_quarters(spark, d):
    docs = t(spark, d, "documents").select("doc_id")
    total = docs.agg(F.max("doc_id") + 1).first()[0]
    return docs.select("doc_id", numbers.quartile(F.col("doc_id"), F.lit(total or 1)).cast("long").alias("quarter"))


@query("select source, greatest(10, least(250, ceil(sum(n_chars) / 8.0)::bigint // 6))::bigint as warmup from documents group by source")
def mth08_warmup_steps(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(numbers.warmup_steps(F.sum("n_chars")).cast("long").alias("warmup"))


def _once_rounded(whole: str, bits: int) -> str:
    """SQL: whole / 2 ** bits as the nearest double: the lowest bits become one that says whether any was set."""
    cut = f"greatest(0, floor(log2({whole}::double))::int - 60)"
    return f"((({whole} >> {cut}) | ({whole} & ((1::hugeint << {cut}) - 1) <> 0)::int::hugeint)::bigint::double * 2.0::double ** ({cut} - {bits}))"


@query(f"""
with s as (select o_orderpriority, count(*) as n, sum((o_totalprice * 2.0::double ** 44)::hugeint)::hugeint as h from orders group by o_orderpriority),
m as (select o_orderpriority, n, {_once_rounded("h", 44)} / n as mean from s),
v as (select o_orderpriority, n, mean, sum(((o_totalprice - mean) * (o_totalprice - mean) * 2.0::double ** 66)::hugeint)::hugeint as h from orders join m using (o_orderpriority) group by all)
select o_orderpriority, n, mean, {_once_rounded("h", 66)} / (n - 1) as variance from v
""")
def mth09_accurate_means(spark, d):
    """Means and sample variances of prices, of sums that are rounded once; the SQL adds whole numbers of 128 bits."""
    return exact_statistics(t(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


@query(f"""
with x as (select lang, doc_id, (n_chars % 1000)::double / 1000 as score from documents),
s as (select lang, count(*) as n, sha256('[' || string_agg(score::varchar, ',' order by doc_id) || ']') as digest, sum((score * 2.0::double ** 70)::hugeint)::hugeint as h from x group by lang)
select lang, n, digest, {_once_rounded("h", 70)} as total, {_once_rounded("h", 70)} / n as mean from s
""")
def agg22_stratum_summary(spark, d):
    """Scores of every stratum: how many, their sum, their mean, and the digest of all of them in order."""
    scores = t(spark, d, "documents").select("lang", "doc_id", ((F.col("n_chars") % 1000).cast("double") / 1000).alias("score"))
    return digests.score_summary(scores, "score", ["lang"], ["doc_id"])


@query("select n_nationkey, n_nationkey / 24.0::double as weight, 'lambda_' || lpad(round_even(n_nationkey / 24.0::double * 1000, 0)::int::varchar, 4, '0') as slug from nation")
def mth10_lambda_slugs(spark, d):
    weight = F.col("n_nationkey") / 24.0
    return t(spark, d, "nation").select("n_nationkey", weight.alias("weight"), numbers.lambda_slug(weight).alias("slug"))


@query("select doc_id, case doc_id % 4 when 0 then 30000 / 1001.0::double when 1 then 24.0::double when 2 then null else (doc_id % 60) / 2.0::double end as fps from documents")
def mth11_frame_rates(spark, d):
    k = F.col("doc_id")
    rate = F.when(k % 4 == 0, "30000/1001").when(k % 4 == 1, "24").when(k % 4 == 2, "25/0").otherwise(F.concat((k % 60).cast("string"), F.lit("/2")))
    return t(spark, d, "documents").select("doc_id", numbers.frame_rate(rate).alias("fps"))


# Arrays


@query("select conv_id, sum(case when role = 'user' then 2 else 0 end)::int as n, string_agg(case when role = 'user' then turn || 'a,' || turn || 'b' end, ',' order by turn, text) as urls from conversations group by conv_id")
def arr02_nested_annotations(spark, d):
    """Annotations of one type out of messages of a type, flattened."""
    note = lambda kind, s: F.struct(F.lit(kind).alias("type"), F.concat(F.col("turn").cast("string"), F.lit(s)).alias("url"))
    said = F.struct("turn", "text", F.when(F.col("role") == "user", "message").otherwise("reasoning").alias("type"), F.array(note("url_citation", "a"), note("file", "x"), note("url_citation", "b")).alias("annotations"))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("output"))
    notes = F.flatten(F.transform(F.filter("output", lambda o: o["type"] == "message"), lambda o: F.filter(o["annotations"], lambda a: a["type"] == "url_citation")))
    return rows.select("conv_id", notes.alias("a")).select("conv_id", F.size("a").alias("n"), F.when(F.size("a") > 0, F.array_join(F.transform("a", lambda x: x["url"]), ",")).alias("urls"))


@query("select doc_id, case doc_id % 3 when 0 then ['a+m', 'b', 'base+n'] when 1 then ['base+m'] else ['a', 'b'] end as refs from documents")
def arr04_zipped_with_fallback(spark, d):
    """Reference images under masks: beyond the images a mask is laid over the first frame."""
    k = F.col("doc_id") % 3
    lits = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    images, masks = F.when(k == 1, lits()).otherwise(lits("a", "b")), F.when(k == 0, lits("m", None, "n")).when(k == 1, lits("m")).otherwise(lits())
    return t(spark, d, "documents").select("doc_id", transforms.zipped_with_fallback(images, masks, F.lit("base"), lambda a, b: F.concat(a, F.lit("+"), b)).alias("refs"))


@query("select doc_id, case doc_id % 3 when 0 then ['image', 'video'] when 1 then ['video', 'video', 'image'] end as types, case doc_id % 3 when 2 then ['xyz'] else []::varchar[] end as unknown from documents")
def arr05_parsed_patterns(spark, d):
    """Patterns of names with aliases; those with an unknown name give it."""
    k = F.col("doc_id") % 3
    pattern = F.when(k == 0, "img , video").when(k == 1, "vid,vid,,image").otherwise("img,xyz")
    known = F.create_map(*(F.lit(x) for p in {"img": "image", "image": "image", "vid": "video", "video": "video"}.items() for x in p))
    names = F.filter(F.transform(F.split(pattern, ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = t(spark, d, "documents").select("doc_id", names.alias("n")).withColumn("unknown", F.filter("n", lambda x: F.try_element_at(known, x).isNull()))
    return rows.select("doc_id", F.when(F.size("unknown") == 0, F.transform("n", lambda x: F.try_element_at(known, x))).alias("types"), "unknown")


@query("select conv_id, coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, text), '') as said from conversations group by conv_id")
def arr06_joined_texts(spark, d):
    """The texts of all contents of an answer, joined."""
    part = F.struct("turn", "text", F.when(F.col("role") == "assistant", F.array(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("content"))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("output"))
    return rows.select("conv_id", F.array_join(F.flatten(F.transform("output", lambda o: o["content"])), "").alias("said"))


@query("select lang, count(*) as n, sum(n_chars)::bigint as total from documents where n_chars > 100 group by lang")
def udf02_predicate_callback(spark, d):
    """UDF-02 and UDF-06: a predicate and aggregates handed in as functions of columns."""
    predicate = lambda: F.col("n_chars") > 100
    return fixed(t(spark, d, "documents").where(predicate()).select("lang", "n_chars"), "picked").groupBy("lang").agg(*(f.alias(n) for n, f in {"n": F.count("*"), "total": F.sum("n_chars")}.items()))


@query("select item_id, place - 1 as place, word from (select item_id, unnest(w) as word, generate_subscripts(w, 1) as place from (select item_id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from benchmark))")
def udf05_table_function(spark, d):
    """A table function: one text, many rows; it is an object that is joined laterally, without a name in the session."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="place int, word string")
    class Words:
        def eval(self, text: str):
            yield from enumerate(w for w in (text or "").split(" ") if w)

    return t(spark, d, "benchmark").lateralJoin(Words(F.col("text").outer())).select("item_id", "place", "word")


@query("select doc_id, lang in ('" + "', '".join(lexicon.SEARCHABLE_SUBTASKS) + "') as searchable, 'interp_' || lpad(doc_id::varchar, 4, '0') as name from documents")
def int13_recipe_contract(spark, d):
    """Rows of a recipe: whether their kind may search, and the names under which files must lie."""
    return t(spark, d, "documents").select("doc_id", F.col("lang").isin(*lexicon.SEARCHABLE_SUBTASKS).alias("searchable"), F.concat(F.lit("interp_"), F.when(F.col("doc_id") < 10_000, F.lpad(F.col("doc_id").cast("string"), 4, "0")).otherwise(F.substring(F.col("doc_id").cast("string"), 1, 4))).alias("name"))
