"""Registered queries of selections, orders, cycles and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import lexicon, numbers, text
from siltstone.operators import ranking, relations, selection
from siltstone.plans.catalog import _WORDS, query, t


def _rows(spark, d):
    """Candidate rows: fingerprint, prompt, route and video of every document."""
    k = F.col("doc_id")
    routes = F.array(*(F.lit(x) for x in lexicon.SUBTASKS))
    return t(spark, d, "documents").select(
        "doc_id", F.sha2(F.concat("source", F.lit("|"), "lang", (k % 29).cast("string")), 256).alias("fingerprint"), F.concat("source", F.lit(" "), "lang").alias("prompt"),
        F.get(routes, (k % 11).cast("int")).alias("route"), F.concat(F.lit("v"), (k % 17).cast("string")).alias("video"), "n_chars",
    )


_ROWS = f"(select doc_id, sha256(source || '|' || lang || (doc_id % 29)::varchar) as fingerprint, source || ' ' || lang as prompt, ([{', '.join(repr(x) for x in lexicon.SUBTASKS)}])[doc_id % 11 + 1] as route, 'v' || (doc_id % 17) as video, n_chars from documents)"


@query(f"""
with c as (select *, sha256('pick' || chr(31) || fingerprint) as h from {_ROWS} where n_chars > 50 and fingerprint not in (select fingerprint from {_ROWS} where doc_id < 20) and prompt not in (select prompt from {_ROWS} where doc_id < 3))
select prompt, fingerprint from (select prompt, fingerprint, h, row_number() over (partition by prompt order by h, fingerprint) as k from c) where k = 1 order by h, fingerprint limit 25
""")
def win05_exact_selection(spark, d):
    """25 rows by hash, none of them used before by fingerprint or prompt, and no prompt twice."""
    rows = _rows(spark, d)
    used, prompts = rows.where("doc_id < 20").select("fingerprint").distinct(), rows.where("doc_id < 3").select("prompt").distinct()
    return selection.select_exact(rows.where("n_chars > 50"), 25, "pick", "fingerprint", used, "prompt", prompts).select("prompt", "fingerprint")


_QUOTAS = selection.balanced_counts(60, list(lexicon.SUBTASKS))


@query(f"""
with q(route, n) as (values {', '.join(f"('{k}', {v})" for k, v in _QUOTAS.items())}),
c as (select distinct r.route, fingerprint, q.n, sha256('route-' || r.route || chr(31) || fingerprint) as h from {_ROWS} r join q on q.route = r.route),
f as (select *, row_number() over (partition by fingerprint order by h) as k from c)
select route, fingerprint from (select route, fingerprint, n, row_number() over (partition by route order by h) as p from f where k = 1) where p <= n
""")
def win16_route_replay(spark, d):
    return selection.replay(_rows(spark, d).select("route", "fingerprint"), "route", _QUOTAS, "route", "fingerprint").select("route", "fingerprint")


@query("""
with s as (select lang, count(*) as n from documents group by lang), c as (select *, row_number() over (order by case lang when 'fr' then 0 when 'en' then 1 when 'es' then 2 else 3 end) - 1 as r, count(*) over () as m from s where lang in ('fr', 'en', 'es', 'de')),
q as (select lang, n, 90 // m + (r < 90 % m)::int as q from c), p as (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as pos from documents)
select p.doc_id, p.lang from p join q on p.lang = q.lang where (q >= n and pos < n) or (q < n and pos in (select ((2 * i + 1) * n) // (2 * q) from range(90) r(i) where i < q))
""")
def win08_stratified_sample(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang")
    return selection.stratified(docs, "lang", ["fr", "en", "es", "de"], "doc_id", 90).select("doc_id", "lang")


@query("""
with o as (select doc_id, source, row_number() over (partition by source order by doc_id) as occurrence from documents)
select doc_id, source, occurrence, row_number() over (order by least(occurrence, 2), sha256('concept' || chr(31) || source), doc_id) - 1 as place from o
""")
def win03_distinct_concept_first(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source")
    return ranking.distinct_first(docs, "source", numbers.stable_hash(F.lit("concept"), "source"), ["doc_id"])


@query("select doc_id, lang, turn, row_number() over (order by turn, lang) - 1 as place from (select doc_id, lang, row_number() over (partition by lang order by n_chars desc, doc_id) as turn from documents)")
def win04_round_robin(spark, d):
    return ranking.round_robin(t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "lang", [F.desc("n_chars"), "doc_id"]).select("doc_id", "lang", "turn", "place")


@query(f"""
with recursive r as (select *, row_number() over (partition by route order by h, key) as place from (
    select route, list_position([{', '.join(repr(x) for x in lexicon.SUBTASKS)}], route) - 1 as pool, video, doc_id::varchar as key, sha256('replay-' || route || chr(31) || doc_id) as h from {_ROWS})),
g as (select 0 as step, 0 as pool, 0 as again, 0 as idle, []::varchar[] as keys, []::varchar[] as seen
  union all select step + 1, case when idle_now = {len(lexicon.SUBTASKS)} then 0 else (pool + 1) % {len(lexicon.SUBTASKS)} end, case when idle_now = {len(lexicon.SUBTASKS)} then 1 else again end, case when idle_now = {len(lexicon.SUBTASKS)} then 0 else idle_now end, keys_now, seen_now from (
    select g.step, g.pool, g.again, case when p.key is null then g.idle + 1 else 0 end as idle_now,
      case when p.key is null then g.keys else list_append(g.keys, p.key) end as keys_now, case when p.key is null then g.seen else list_append(g.seen, p.video) end as seen_now
    from g left join lateral (select arg_min(r.key, r.place) as key, arg_min(r.video, r.place) as video from r
      where r.pool = g.pool and not list_contains(g.keys, r.key) and (g.again = 1 or not list_contains(g.seen, r.video))) p on true
    where len(g.keys) < 40 and g.step < 2000))
select unnest(range(40)) as place, unnest(keys) as key from (select keys from g where len(keys) = 40 order by step limit 1)
""")
def win04_diverse_replay(spark, d):
    """40 rows, route by route in turn, first of videos that were not taken yet."""
    rows = _rows(spark, d).select("route", "video", F.col("doc_id").cast("string").alias("key"))
    return selection.diverse(rows, "route", list(lexicon.SUBTASKS), "video", "key", "replay", 40)


_SOURCES = """
select row_number() over (order by doc_id) as pos, doc_id, lower('S' || doc_id) as id, lower('clip_' || doc_id % 397 || '.MP4') as name, lower('clip_' || doc_id % 397) as stem, md5((n_chars // 3)::varchar) as h from documents
"""


@query(f"""
with recursive s as ({_SOURCES}), b as (select *, case when id in (select 's' || item_id * 3 from benchmark) then 'prior_sample_id' when name in (select 'clip_' || item_id * 5 || '.mp4' from benchmark) then 'prior_basename'
  when h in (select md5(item_id::varchar) from benchmark where item_id < 40) then 'prior_video_sha256' end as prior from s),
g as (select 0::bigint as pos, null::bigint as doc_id, null::varchar as reason, []::varchar[] as names, []::varchar[] as hashes
  union all select b.pos, b.doc_id, r.reason, case when r.reason is null then list_append(g.names, b.stem) else g.names end, case when r.reason is null then list_append(g.hashes, b.h) else g.hashes end
  from g join b on b.pos = g.pos + 1, lateral (select case when b.prior is not null then b.prior when list_contains(g.names, b.stem) then 'duplicate_fresh_basename' when list_contains(g.hashes, b.h) then 'duplicate_fresh_video_sha256' end as reason) r)
select doc_id, reason from g where pos > 0
""")
def flt15_fresh_sources(spark, d):
    k = F.col("doc_id")
    rows = t(spark, d, "documents").select(k.alias("position"), F.concat(F.lit(" S"), k.cast("string")).alias("sample_id"), F.concat(F.lit("a/"), "source", F.lit("/Clip_"), (k % 397).cast("string"), F.lit(".MP4")).alias("path"), F.md5(F.floor(F.col("n_chars") / 3).cast("string")).alias("sha256"))
    items = t(spark, d, "benchmark").select("item_id")
    names = items.select(F.concat(F.lit("S"), (F.col("item_id") * 3).cast("string")).alias("name")).unionByName(items.select(F.concat(F.lit("clip_"), (F.col("item_id") * 5).cast("string"), F.lit(".mp4")).alias("name")))
    hashes = items.where("item_id < 40").select(F.md5(F.col("item_id").cast("string")).alias("sha256"))
    return selection.fresh_sources(rows, names, hashes).select(F.col("position").alias("doc_id"), "reason")


@query("""
with l as (select 'items' as loader, count(*) as n, 2 as want, 1 as c from benchmark union all select 'parts', count(*), 1, 2 from part), m as (select max(n * want // (4 * c)) as cycles from l)
select loader, repeat, n * repeat as n_rows from (select loader, n, greatest(want, ceil(cycles * 4 * c / n::double)::bigint) as repeat from l, m)
""")
def win14_auto_repeats(spark, d):
    """Repeats with which two loaders last equally long under the pattern parts, items, parts on four ranks; each is repeated so often."""
    tables = {"items": t(spark, d, "benchmark"), "parts": t(spark, d, "part")}
    lengths = {k: v.count() for k, v in tables.items()}
    repeats, _ = selection.auto_repeats(lengths, {"items": 2, "parts": 1}, ["parts", "items", "parts"], 4)
    out = [v.select(F.lit(k).alias("loader"), F.explode(F.sequence(F.lit(1), F.lit(repeats[k])))).groupBy("loader").agg(F.count("*").alias("n_rows")).withColumn("repeat", F.lit(repeats[k]).cast("long")) for k, v in tables.items()]
    return out[0].unionByName(out[1]).select("loader", "repeat", "n_rows")


@query("select rank, count_if(p = 0) as n_a, count_if(p = 1 or p = 3) as n_b, count_if(p = 2) as n_c from (select rank, (i + rank) % 4 as p from (select item_id as rank from benchmark) r, range(1, 18) s(i) where i <= 17) group by rank")
def win19_consumed_counts(spark, d):
    """Of the pattern a, b, c, b, begun one place later on each rank: what 17 places took of each type."""
    slot = F.explode(F.sequence(F.lit(0), F.lit(16))).alias("i")
    places = t(spark, d, "benchmark").select(F.col("item_id").alias("rank"), slot).withColumn("p", (F.col("i") + 1 + F.col("rank")) % 4)
    return places.groupBy("rank").agg(F.count_if(F.col("p") == 0).alias("n_a"), F.count_if(F.col("p").isin(1, 3)).alias("n_b"), F.count_if(F.col("p") == 2).alias("n_c"))


@query("select kind, count(*) as n from (select unnest(['image', 'video', 'image', 'video_ref']) as kind) group by kind union all select 'rows:' || lang, count(*) from documents group by lang")
def agg32_pattern_counts(spark, d):
    """Places of each type in a pattern with aliases, beside raw lengths."""
    types = selection.pattern_types("img, vid ,img,vid_ref", {"img": "image", "vid": "video", "vid_ref": "video_ref", "image": "image"})
    counts = spark.createDataFrame([(x,) for x in types], "kind string").groupBy("kind").agg(F.count("*").alias("n"))
    return counts.unionByName(t(spark, d, "documents").groupBy(F.concat(F.lit("rows:"), "lang").alias("kind")).agg(F.count("*").alias("n")))


@query("select item_id, (i // 25 + i) % 4 as template, n.n_name from (select item_id, row_number() over (order by item_id) - 1 as i from benchmark) b join nation n on n.n_nationkey = b.i % 25")
def win17_cyclic_phase(spark, d):
    """Items by concepts and templates: every round of concepts begins one template later."""
    items = ranking.with_positions(t(spark, d, "benchmark").select("item_id"), ["item_id"], "i")
    phased = items.select("item_id", F.expr("(i div 25 + i) % 4").alias("template"), (F.col("i") % 25).cast("int").alias("n_nationkey"))
    return phased.join(t(spark, d, "nation"), "n_nationkey").select("item_id", "template", "n_name")


@query("""
select place, n_name, p_type, size from (select row_number() over (order by n_nationkey, p_type, size) - 1 as place, n_name, p_type, size
  from nation, (select distinct p_type from part), (values (1), (2), (3)) s(size) where (n_nationkey * 7 + length(p_type) + size) % 3 <> 0) where place < 40
""")
def win18_truncated_catalog(spark, d):
    """Nations, types and sizes in nested order; the first 40 eligible combinations."""
    sizes = spark.createDataFrame([(1,), (2,), (3,)], "size int")
    all_ = relations.product([t(spark, d, "nation").select("n_nationkey", "n_name"), t(spark, d, "part").select("p_type").distinct(), sizes])
    eligible = all_.where((F.col("n_nationkey") * 7 + F.length("p_type") + F.col("size")) % 3 != 0)
    head = eligible.orderBy("n_nationkey", "p_type", "size").limit(40)
    return ranking.with_positions(head, ["n_nationkey", "p_type", "size"], "place").select("place", "n_name", "p_type", "size")


@query("select lang, ord, total // m + (ord < total % m)::int as quota from (select lang, row_number() over (order by lang) - 1 as ord, count(*) over () as m, 1234 as total from (select distinct lang from documents))")
def win09_balanced_counts(spark, d):
    return selection.balanced_quotas(t(spark, d, "documents").select("lang").distinct(), "lang", 1234)


@query("select doc_id, sha256('salt' || chr(31) || sha256(source || '|' || lang || (doc_id % 29)::varchar)) as rank_hash from documents")
def srt01_hash_order(spark, d):
    return _rows(spark, d).select("doc_id", numbers.stable_hash(F.lit("salt"), "fingerprint").alias("rank_hash"))


@query("select lang, case when best_ok then best else fallback end as chosen, best_ok as primary_used from (select lang, first(source order by n desc, source desc) as best, max(n) >= 20 as best_ok, min(source) as fallback from (select lang, source, count(*) as n from documents group by lang, source) group by lang)")
def srt06_primary_or_fallback(spark, d):
    """The commonest source of a language, the last by name of equals, if it has 20 documents; else the first by name."""
    counts = t(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    s = counts.groupBy("lang").agg(F.max(F.struct("n", "source")).alias("b"), F.min("source").alias("fallback"))
    ok = F.col("b.n") >= 20
    return s.select("lang", selection.decide(F.col("b.source"), ok, F.col("fallback")).alias("chosen"), ok.alias("primary_used"))


@query("select doc_id from documents order by doc_id limit 64")
def srt07_head(spark, d):
    return t(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(64)


@query("select doc_id from documents order by sha256('42' || chr(31) || doc_id), doc_id limit 50")
def srt08_seeded_sample(spark, d):
    """A uniform sample without replacement: the lowest salted hashes stand for a generator's draws."""
    return ranking.hash_ranked(t(spark, d, "documents").select("doc_id"), "42", "doc_id", 50).select("doc_id")


@query("select doc_id, row_number() over (order by sha256((7 + length(lang))::varchar || chr(31) || doc_id), doc_id) - 1 as place from documents")
def srt09_seeded_shuffle(spark, d):
    """A full shuffle with a seed of its own for every type of row."""
    seed = (F.lit(7) + F.length("lang")).cast("string")
    docs = t(spark, d, "documents").select("doc_id", numbers.stable_hash(seed, F.col("doc_id").cast("string")).alias("_h"))
    return ranking.with_positions(docs, ["_h", "doc_id"], "place").select("doc_id", "place")


@query("select page_id, row_number() over (partition by 1 order by (page_id // 7) % 10, page_id) - 1 as place from pages")
def srt12_natural_names(spark, d):
    """File names in natural order: digit runs compare as numbers."""
    name = F.concat(F.lit("frame"), F.floor(F.col("page_id") / 7 % 10).cast("string"), F.lit("_"), F.col("page_id").cast("string"), F.lit(".png"))
    pages = t(spark, d, "pages").select("page_id", ranking.natural_key(name).alias("_key"))
    return ranking.with_positions(pages, ["_key"], "place").select("page_id", "place")


@query("""
with a as (select url as key, page_id as pos, 0 as part from pages where page_id % 3 = 0), b as (select regexp_replace(url, '^https', 'http') as key, page_id as pos, 1 as part from pages where page_id % 2 = 0),
u as (select *, row_number() over (partition by key order by part, pos) as k from (select * from a union all select * from b) where key <> '')
select key, place from (select key, row_number() over (order by part, pos) - 1 as place from u where k = 1) where place < 30
""")
def set07_merged_hits(spark, d):
    pages = t(spark, d, "pages")
    first = pages.where("page_id % 3 = 0").select(F.col("url").alias("key"), F.col("page_id").alias("at"))
    second = pages.where("page_id % 2 = 0").select(F.regexp_replace("url", "^https", "http").alias("key"), F.col("page_id").alias("at"))
    return selection.merged_hits(first, second, "key", "at", 30).select("key", "place")


@query("select doc_id, q.p_partkey from (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents where lang = 'en') d join (select p_partkey, row_number() over (order by sha256('spec' || chr(31) || p_partkey), p_partkey) - 1 as pos from part) q on d.pos = q.pos")
def join06_sources_by_specs(spark, d):
    """Sources and specs zipped by place, specs in hashed order."""
    a = ranking.with_positions(t(spark, d, "documents").where("lang = 'en'").select("doc_id"), ["doc_id"], "pos")
    hashed = t(spark, d, "part").select("p_partkey", numbers.stable_hash(F.lit("spec"), F.col("p_partkey").cast("string")).alias("_h"))
    return a.join(ranking.with_positions(hashed, ["_h", "p_partkey"], "pos"), "pos").select("doc_id", "p_partkey")


@query(f"""
with s as (select p_partkey, ' ' || array_to_string({_WORDS.format('p_name')}, ' ') || ' ' as n from part), g as (select p_partkey, trim(replace(replace(n, ' ring ', ' __slot__ '), ' red ', ' __slot__ ')) as signature from s)
select signature, count(*) as n from g group by signature
""")
def str07_template_signatures(spark, d):
    names = t(spark, d, "part").select(text.template_signature(text.normalize(F.col("p_name")), ["ring", "red"]).alias("signature"))
    return names.groupBy("signature").agg(F.count("*").alias("n"))


@query(f"""
with r as (select distinct array_to_string(w[i:i+2], ' ') as g from (select w, unnest(range(1, len(w) - 1)) as i from (select {_WORDS.format('text')} as w from documents) where len(w) >= 3)),
v as (select distinct item_id, kind, array_to_string(w, ' ') as norm, w from (select item_id, 'head' as kind, {_WORDS.format("substr(text, 1, length(text) // 2)")} as w from benchmark union all select item_id, 'tail', {_WORDS.format("substr(text, length(text) // 2 + 1)")} from benchmark)),
e as (select item_id, kind, array_to_string(w[i:i+2], ' ') as g from (select *, unnest(range(1, len(w) - 1)) as i from v where len(w) >= 3))
select item_id, kind, count(distinct g) as n_shared from e where g in (select g from r) group by item_id, kind
""")
def agg29_value_ngrams(spark, d):
    """Runs of three words of items' values that stand anywhere in the documents: a semi-join with the union of their runs."""
    values = t(spark, d, "benchmark").select("item_id", F.inline(F.array(F.struct(F.lit("head").alias("kind"), F.expr("left(text, length(text) div 2)").alias("value")), F.struct(F.lit("tail").alias("kind"), F.expr("substr(text, length(text) div 2 + 1)").alias("value")))))
    return relations.value_overlap(values, t(spark, d, "documents"), ["item_id", "kind"], "value", "text", 3)
