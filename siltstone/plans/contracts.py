"""More registered queries: record contracts, keyed overrides, rubrics, quotas, cycles, text, JSON and array operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import numbers, text
from siltstone.operators import audits, metrics, ranking, relations
from siltstone.plans.catalog import _WORDS, query, t

# Projections and row transforms


@query("select doc_id, 'xx' as lang, source, 1 as version from documents")
def prj03_struct_override(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang", "source").withColumns({"lang": F.lit("xx"), "version": F.lit(1)})


@query("select d.doc_id, case when l.quality = 1 then 'trusted' else d.source end as source from documents d left join labels l on d.doc_id = l.doc_id")
def prj14_override_by_flag(spark, d):
    labels = t(spark, d, "labels").select("doc_id", "quality")
    return t(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, "trusted").otherwise(F.col("source")).alias("source"))


@query("select conv_id, arg_max(text, turn) as last_text from conversations where role = 'assistant' and trim(text) <> '' group by conv_id")
def prj24_last_matching(spark, d):
    said = t(spark, d, "conversations").where((F.col("role") == "assistant") & (F.trim("text") != ""))
    return said.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"))


# Filters and validators


@query(f"select doc_id from documents where contains(' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ', ' of the ')")
def flt09_phrase_containment(spark, d):
    return t(spark, d, "documents").where(text.contains_phrase(text.normalize(F.col("text")), F.lit("of the"))).select("doc_id")


@query("""
select event_type, count_if(not list_contains(json_keys(p), 'error')) as n from (
  select event_type, case when event_id % 3 = 0 then '{"error": null, "k": ' || event_id || '}' when event_id % 3 = 1 then '{"error": "x"}' else props end as p from events
) where p is not null group by event_type
""")
def flt22_error_rows(spark, d):
    """A row is an error if it has the key, whatever its value is."""
    k = F.col("event_id")
    text_ = F.when(k % 3 == 0, F.concat(F.lit('{"error": null, "k": '), k.cast("string"), F.lit("}"))).when(k % 3 == 1, '{"error": "x"}').otherwise(F.col("props"))
    rows = t(spark, d, "events").select("event_type", text_.alias("p")).where("p is not null")
    return rows.groupBy("event_type").agg(F.count_if(~F.array_contains(F.json_object_keys("p"), "error")).alias("n"))


# Joins


@query("""
with b as (select doc_id, row_number() over (order by doc_id) - 1 as place, n_chars from documents), x as (select doc_id * 3 as doc_id, quality from labels)
select coalesce(b.doc_id, x.doc_id) as doc_id, place, n_chars, quality, case when b.doc_id is null then 'unknown' when x.doc_id is null then 'missing' else 'joined' end as status from b full join x on b.doc_id = x.doc_id
""")
def join04_override_base(spark, d):
    """Base rows in their order with what overrides them; ids that the base does not know and those without an override are told."""
    base = ranking.with_positions(t(spark, d, "documents").select("doc_id", "n_chars"), ["doc_id"], "place")
    return relations.overridden(base, t(spark, d, "labels").select((F.col("doc_id") * 3).alias("doc_id"), "quality"), "doc_id", "place")


@query("""
with r as (select (doc_id // 2)::varchar || case when doc_id % 2 = 0 then '_A' else '_B' end as id, n_chars as score from documents where lang in ('en', 'de', 'fr')),
h as (select doc_id::varchar as pair, case quality when 1 then 'A' when 0 then 'B' end as human from labels)
select h.pair, a.score as a_score, b.score as b_score, human, case when a.score > b.score then 'A' when a.score < b.score then 'B' else 'tie' end as label
from h join r a on a.id = h.pair || '_A' join r b on b.id = h.pair || '_B' where human is not null
""")
def join08_judged_pairs(spark, d):
    """Judged results of both sides of a pair, by the pair's id and the side, with the human label; pairs with one side alone are left out."""
    k = F.col("doc_id")
    results = t(spark, d, "documents").where(F.col("lang").isin("en", "de", "fr")).select(F.concat(F.floor(k / 2).cast("string"), F.when(k % 2 == 0, "_A").otherwise("_B")).alias("id"), F.col("n_chars").alias("score"))
    human = t(spark, d, "labels").select(k.cast("string").alias("pair"), F.when(F.col("quality") == 1, "A").when(F.col("quality") == 0, "B").alias("human")).where("human is not null")
    sides = results.select(F.regexp_replace("id", "_[AB]$", "").alias("pair"), F.right("id", F.lit(1)).alias("side"), "score")
    both = sides.groupBy("pair").agg(F.max(F.when(F.col("side") == "A", F.col("score"))).alias("a_score"), F.max(F.when(F.col("side") == "B", F.col("score"))).alias("b_score"))
    label = F.when(F.col("a_score") > F.col("b_score"), "A").when(F.col("a_score") < F.col("b_score"), "B").otherwise("tie")
    return both.where("a_score is not null and b_score is not null").join(human, "pair").select("pair", "a_score", "b_score", "human", label.alias("label"))


@query("select doc_id::varchar as key from documents where doc_id % 4 <> 0 and text is not null")
def join19_paired_members(spark, d):
    """Members of tar shards that have a partner of their stem: three of four records have their clip in the same shard, the others in none."""
    from siltstone.sources import tar
    from siltstone.sources.shared import folder

    k = F.col("doc_id")
    record, clip = F.struct(F.concat(k.cast("string"), F.lit(".json")).alias("name"), F.lit(b"{}").alias("content")), F.struct(F.concat(k.cast("string"), F.lit(".mp4")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    rows = t(spark, d, "documents").where("text is not null").select((k % 5).alias("shard"), F.inline(F.when(k % 4 == 0, F.array(record)).otherwise(F.array(record, clip))))
    root = folder(spark, "pairs")
    tar.write_shards(rows, "shard", "name", "content", root)
    return tar.paired_members(tar.tar_index(spark, root), ["json", "mp4"]).select("key")


# Aggregations


@query("select lang, case when count(l.quality) = 0 then 1.0 else sum(l.quality) / count(l.quality) end::double as retention from documents d left join labels l on d.doc_id = l.doc_id group by lang")
def agg03_ratio_with_default(spark, d):
    joined = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("lang").agg(numbers.ratio(F.sum("quality"), F.count("quality"), 1.0).alias("retention"))


_METHODS = {"five": ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"], "four": ["l_quantity", "l_discount", "l_tax", "l_partkey"], "one": ["l_quantity"]}


def _method_sql(name: str, dims: list[str]) -> str:
    side = lambda x: f"({' + '.join(f'{x}.{c}::double' for c in dims)}) / {len(dims)}"
    return f"select '{name}' as method, case when {side('a')} > {side('b')} then 'A' when {side('a')} < {side('b')} then 'B' else 'tie' end as label from a join b using (l_orderkey)"


@query(f"""
with u as (select *, row_number() over (partition by l_orderkey, l_linenumber order by {", ".join(f"{c} desc" for c in _METHODS["five"])}) as k from lineitem),
a as (select * from u where l_linenumber = 1 and k = 1), b as (select * from u where l_linenumber = 2 and k = 1),
l as ({' union all '.join(_method_sql(m, dims) for m, dims in _METHODS.items())})
select method, count_if(label = 'A') as n_a, count_if(label = 'B') as n_b, count_if(label = 'tie') as n_tie from l group by method
""")
def agg12_three_methods(spark, d):
    """Sides A and B of every order by the means of five, four and one dimensions; of a side that stands twice the highest counts."""
    items = t(spark, d, "lineitem").where("l_linenumber in (1, 2)")
    dims = _METHODS["five"]
    side = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.struct(*dims)))
    pairs = items.groupBy("l_orderkey").agg(side(1).alias("a"), side(2).alias("b")).where("a is not null and b is not null")
    labels = metrics.compared_sides(pairs, _METHODS, "a", "b")
    return labels.groupBy("method").agg(*(F.count_if(F.col("label") == x).alias(f"n_{x.lower()}") for x in ("A", "B", "tie")))


@query("select source || ':' || lang as cell, count(*) as n, count(distinct text) as n_distinct from documents group by source, lang")
def agg16_distribution_matrix(spark, d):
    cells = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_distinct"))
    return cells.select(F.concat("source", F.lit(":"), "lang").alias("cell"), "n", "n_distinct")


_UNIQUE = {"id": "doc_id", "text": "md5(text)", "length": "n_chars", "head": "substr(text, 1, 40)", "place": "source || ':' || doc_id", "kind": "lang || n_chars"}
_SHARES = {"lang": ("lang", {"en": 40, "de": 12, "fr": 1}), "long": ("(n_chars > 500)", {"true": 60, "false": 40}), "source": ("source", {"src1": 5, "none": 2}), "quality": ("(n_chars % 3)", {"0": 1, "1": 2, "2": 3})}


@query(" union all ".join(
    [f"select 'not_unique:{n}' as rule, ({e})::varchar as key, 'stands ' || count(*) || ' times' as message from documents group by ({e}) having count(*) > 1" for n, e in _UNIQUE.items()]
    + [f"select 'distribution:{n}', coalesce(w.k, h.k), case when h.k is null then 'missing' when w.k is null then 'not expected' else 'is ' || h.n || ', expected ' || w.n end from (values {', '.join(f"('{k}', {v})" for k, v in want.items())}) w(k, n) full join (select ({e})::varchar as k, count(*) as n from documents group by ({e})) h on w.k is not distinct from h.k where w.n is distinct from h.n" for n, (e, want) in _SHARES.items()]
))
def agg23_uniqueness_contract(spark, d):
    """Ten assertions on a set of cases, six of uniqueness and four of distributions, and what breaks each."""
    docs = t(spark, d, "documents").select("doc_id", "text", "n_chars", "source", "lang")
    unique = audits.not_unique(docs, {n: F.expr(e) for n, e in _UNIQUE.items()})
    return audits.together(unique, *(audits.off_distribution(docs, F.expr(e), want, f"distribution:{n}") for n, (e, want) in _SHARES.items()))


# Windows and ranking


@query("""
with c as (select doc_id, source, lang, n_chars % 7 as concept, n_chars // 50 as prompt, sha256('concept' || chr(31) || (n_chars % 7)) as ch, sha256('row' || chr(31) || doc_id) as rh from documents),
o as (select *, row_number() over (partition by source, lang, concept order by rh) as again from c),
f as (select *, row_number() over (partition by source, lang, prompt order by least(again, 2), ch, rh) as same from o),
p as (select *, row_number() over (partition by source, lang order by least(again, 2), ch, rh) as place from f where same = 1)
select source, lang, place - 1 as place, doc_id from p where place <= 4
""")
def win10_matrix_selection(spark, d):
    """Four rows of every cell of source and language, of as many concepts as there are, without a prompt twice in a cell."""
    k = F.col("doc_id").cast("string")
    docs = t(spark, d, "documents").select("doc_id", "source", "lang", (F.col("n_chars") % 7).alias("concept"), F.floor(F.col("n_chars") / 50).alias("prompt"), numbers.stable_hash(F.lit("row"), k).alias("_row"))
    return ranking.cell_selection(docs, ["source", "lang"], "concept", numbers.stable_hash(F.lit("concept"), F.col("concept").cast("string")), ["_row"], "prompt", 4).select("source", "lang", "place", "doc_id")


@query("select item_id, i % 6 as concept, (i % 6 + i // 6) % 4 as template from (select item_id, row_number() over (order by item_id) - 1 as i from benchmark)")
def win15_rotating_template(spark, d):
    items = ranking.with_positions(t(spark, d, "benchmark").select("item_id"), ["item_id"], "i")
    return items.selectExpr("item_id", "i % 6 as concept", "(i % 6 + i div 6) % 4 as template")


@query("select s.i, b.item_id from (select row_number() over (order by item_id) - 1 as p, item_id from benchmark) b, (select count(*) as n from benchmark), (select unnest(range(3)) as r), lateral (select r * n + p as i) s")
def win20_wrapped_repeat(spark, d):
    bench = t(spark, d, "benchmark").select("item_id")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r")
    return ranking.with_positions(bench, ["item_id"], "p").select("item_id", "p", rounds).select((F.col("r") * F.lit(bench.count()) + F.col("p")).alias("i"), "item_id")


# Sorts and sets


@query("select item_id, case when ('0x' || substr(sha256('side' || item_id::varchar), 1, 8))::bigint % 2 = 0 then 'A' else 'B' end as side from benchmark")
def srt10_blind_sides(spark, d):
    side = numbers.hash_choice(F.concat(F.lit("side"), F.col("item_id").cast("string")), 2)
    return t(spark, d, "benchmark").select("item_id", F.when(side == 0, "A").otherwise("B").alias("side"))


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 25")
def srt03_multi_key_top(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@query("select doc_id from documents where lang = 'fr' union select doc_id from labels where toxic = 1")
def set04_union_of_sets(spark, d):
    return t(spark, d, "documents").where("lang = 'fr'").select("doc_id").union(t(spark, d, "labels").where("toxic = 1").select("doc_id")).distinct()


@query("select count(*) as shared, count(*) = 0 as disjoint from (select source from documents where doc_id % 2 = 0 intersect select source from documents where doc_id % 2 = 1)")
def set06_group_overlap(spark, d):
    docs = t(spark, d, "documents").select("source", "doc_id")
    both = docs.groupBy("source").agg(F.count_distinct(F.col("doc_id") % 2).alias("k")).where("k = 2")
    return both.agg(F.count("*").alias("shared"), (F.count("*") == 0).alias("disjoint"))


# Text, JSON, numbers, arrays and maps


@query("select item_id, rtrim(trim(regexp_replace(text, '\\s+', ' ', 'g')), '.') as flat from benchmark")
def str09_collapse(spark, d):
    return t(spark, d, "benchmark").select("item_id", text.collapse(F.col("text")).alias("flat"))


@query("select o_orderkey, len(list(l_linenumber)) as n, list_sort(list(l_linenumber))[1:3] as head, list_reverse_sort(list(l_linenumber)) as back from lineitem join orders on l_orderkey = o_orderkey group by o_orderkey")
def arr01_array_operations(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    every = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    return every.select("o_orderkey", F.size("x").cast("long").alias("n"), F.slice("x", 1, 3).alias("head"), F.reverse("x").alias("back"))


@query("select item_id, case when contains(text, ' the ') then substr(text, 1, instr(text, ' the ') - 1) else text end as head, case when contains(text, ' the ') then substr(text, instr(text, ' the ') + 5) end as tail from benchmark")
def arr03_split_once(spark, d):
    parts = F.split("text", " the ", 2)
    return t(spark, d, "benchmark").select("item_id", F.get(parts, F.lit(0)).alias("head"), F.get(parts, F.lit(1)).alias("tail"))


@query("select source, coalesce(max(case when lang = 'en' then n end), 0) as en, coalesce(max(case when lang = 'zz' then n end), 0) as zz, count(*) as n_keys from (select source, lang, count(*) as n from documents group by source, lang) group by source")
def map01_map_lookup(spark, d):
    counts = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    m = counts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0).cast("long"))
    return m.select("source", get("en").alias("en"), get("zz").alias("zz"), F.size("m").cast("long").alias("n_keys"))


