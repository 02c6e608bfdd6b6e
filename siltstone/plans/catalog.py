"""Registered queries for the reference operators, by name, each with the SQL that must give the same rows.

The driver's tables stand in for the record files that the operators were made for: documents for prompts, benchmark for
held-out cases, labels for gold and predicted flags, conversations for chat rows, events for records with JSON text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import numbers, text
from siltstone.operators import digests, metrics, overlap, patterns, ranking, relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: In these tables only sharp s folds to more than its lower case.
_WORDS = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"


def query(sql: str | None = None):
    """Register a function under its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Projections and row transforms


@query("select doc_id, coalesce(nullif(trim(source), ''), 'unknown') as origin, case when lang in ('en', 'de') then lang else 'other' end as lang_group from documents")
def prj01_rename_with_default(spark, d):
    return t(spark, d, "documents").select(
        "doc_id", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown")).alias("origin"), F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("other").alias("lang_group")
    )


@query("select event_id, case when event_type like '%purchase%' then 'buy' when event_type like '%click%' then 'tap' else 'other' end as route from events")
def prj07_route_by_rule(spark, d):
    e = F.col("event_type")
    return t(spark, d, "events").select("event_id", F.when(e.contains("purchase"), "buy").when(e.contains("click"), "tap").otherwise("other").alias("route"))


@query("""
select conv_id, coalesce(first(text order by turn) filter (where role = 'system'), '') as system, ['conv_' || conv_id || '.mp4'] as videos,
  to_json(list({'role': role, 'content': case when role = 'user' then '<video>' || chr(10) || text else text end} order by turn, role) filter (where role in ('user', 'assistant')))::varchar as messages
from conversations group by conv_id having count_if(role in ('user', 'assistant')) > 0
""")
def prj04_chat_record(spark, d):
    """One record a conversation: system, messages in order (a request names its video) and videos."""
    rows = t(spark, d, "conversations")
    said = F.when(F.col("role") == "user", F.concat(F.lit("<video>\n"), "text")).otherwise(F.col("text"))
    message = F.when(F.col("role").isin("user", "assistant"), F.struct("turn", "role", said.alias("content")))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"), F.min_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn"))).alias("s"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return grouped.where(F.size("m") > 0).select("conv_id", F.coalesce("s", F.lit("")).alias("system"), F.array(F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".mp4"))).alias("videos"), F.to_json(messages).alias("messages"))


@query("select doc_id, 'Rewrite ' || source || ' in ' || lang as request from documents")
def prj06_template_expansion(spark, d):
    return t(spark, d, "documents").select("doc_id", text.template("Rewrite {source} in {lang}", source=F.col("source"), lang=F.col("lang")).alias("request"))


@query("select item_id, u.side, case when u.side = 'good' then text else text || ' (edited)' end as text from benchmark, (values ('good'), ('bad')) u(side)")
def prj11_counterfactual_pairs(spark, d):
    pair = F.array(F.struct(F.lit("good").alias("side"), F.col("text")), F.struct(F.lit("bad").alias("side"), F.concat("text", F.lit(" (edited)")).alias("text")))
    return t(spark, d, "benchmark").select("item_id", F.inline(pair))


@query("select doc_id, case when ('0x' || substr(sha256('drop' || doc_id::varchar), 1, 8))::bigint / 4294967296.0 < 0.1 then '' else source end as source from documents")
def prj20_conditional_dropout(spark, d):
    u = numbers.hash_uniform(F.concat(F.lit("drop"), F.col("doc_id").cast("string")))
    return t(spark, d, "documents").select("doc_id", F.when(u < 0.1, "").otherwise(F.col("source")).alias("source"))


# Filters and validators


@query("""
select rule, count(*) as n from (select case when lang = 'en' and source = 'src1' then 0 when lang = 'fr' then 1 end as rule from documents) where rule is not null group by rule
""")
def flt06_exclude_rules(spark, d):
    docs = t(spark, d, "documents")
    return docs.withColumn("rule", relations.matching_rule(docs, "lang=en,source=src1;lang=fr")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))


@query("""
select doc_id, case when text is null or trim(text) = '' then 'empty' when n_chars < 100 then 'short' when lang <> 'en' then 'language' end as reason from documents
where text is null or trim(text) = '' or n_chars < 100 or lang <> 'en'
""")
def flt14_first_reason(spark, d):
    rules = [("empty", F.col("text").isNull() | (F.trim("text") == "")), ("short", F.col("n_chars") < 100), ("language", F.col("lang") != "en")]
    return t(spark, d, "documents").select("doc_id", relations.first_reason(rules).alias("reason")).where("reason is not null")


@query("""
select code, count(*) as n from (
  select unnest(list_filter([case when n_chars < 100 then 'short' end, case when lang <> 'en' then 'language' end, case when source = 'src0' then 'source' end], lambda x: x is not null)) as code from documents
) group by code
""")
def agg17_violation_counts(spark, d):
    rules = [("short", F.col("n_chars") < 100), ("language", F.col("lang") != "en"), ("source", F.col("source") == "src0")]
    return t(spark, d, "documents").select(F.explode(relations.violations(rules)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("select text as value, count(*) as n from documents group by text having count(*) > 1")
def flt21_duplicate_keys(spark, d):
    return relations.duplicate_keys(t(spark, d, "documents").select(F.col("text").alias("value")), ["value"])


@query(f"""
select doc_id from (select doc_id, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' as n from documents)
where contains(n, ' the ') or contains(n, ' que la ') or contains(n, ' für ')
""")
def flt10_forbidden_phrases(spark, d):
    docs = t(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("n"))
    return docs.where(relations.forbidden_phrases(F.col("n"), ["the", "que la", "für"])).select("doc_id")


@query("select name, value, operator, bound, passed from (select 'rows' as name, count(*)::double as value, '>=' as operator, 100.0::double as bound, count(*) >= 100 as passed from documents union all select 'toxic_share', avg(toxic), '<=', 0.05, avg(toxic) <= 0.05 from labels)")
def flt16_threshold_gates(spark, d):
    rows = t(spark, d, "documents").agg(F.count("*").cast("double").alias("value")).select(F.lit("rows").alias("name"), "value")
    share = t(spark, d, "labels").agg(F.avg("toxic").alias("value")).select(F.lit("toxic_share").alias("name"), "value")
    return metrics.gates(rows.unionByName(share), [("rows", ">=", 100.0), ("toxic_share", "<=", 0.05)])


@query("select event_id, value from events where value between 1 and 5")
def flt17_score_range(spark, d):
    """Rows whose score lies in the range of scores; null does not."""
    return t(spark, d, "events").where(F.col("value").between(1, 5)).select("event_id", "value")


# Joins


@query("select d.doc_id, d.lang, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id where l.quality is not null")
def join01_inner_keyed(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels").where("quality is not null"), "doc_id")


@query("select d.doc_id, coalesce(l.quality, -1) as quality, l.doc_id is null as missing from documents d left join labels l on d.doc_id = l.doc_id")
def join02_left_keyed(spark, d):
    labels = t(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("_have"))
    return t(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("_have").isNull().alias("missing"))


@query("select doc_id, text from documents where doc_id not in (select doc_id from labels)")
def join03_anti(spark, d):
    return t(spark, d, "documents").select("doc_id", "text").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select coalesce(a.pos, b.pos) as pos, a.item_id, b.conv_id, a.pos is not null and b.pos is not null as whole from (select row_number() over (order by item_id) - 1 as pos, item_id from benchmark) a full join (select row_number() over (order by conv_id) - 1 as pos, conv_id from (select distinct conv_id from conversations)) b on a.pos = b.pos")
def join05_positional_zip(spark, d):
    """Items and conversations by their places; the longer table's rest shows that the lengths differ."""
    a = ranking.with_positions(t(spark, d, "benchmark").select("item_id"), ["item_id"], "pos")
    b = ranking.with_positions(t(spark, d, "conversations").select("conv_id").distinct(), ["conv_id"], "pos")
    return relations.zipped(a, b, "pos").select("pos", "item_id", "conv_id", "whole")


def _grams(table: str, key: str, column: str, n: int) -> str:
    w = _WORDS.format(column)
    return f"(select distinct {key}, array_to_string(w[i:i+{n - 1}], ' ') as g from (select {key}, w, unnest(range(1, len(w) - {n - 2})) as i from (select {key}, {w} as w from {table}) where len(w) >= {n}))"


@query(f"select a.doc_id, b.item_id, count(*) as n_shared from {_grams('documents', 'doc_id', 'text', 8)} a join {_grams('benchmark', 'item_id', 'text', 8)} b on a.g = b.g group by a.doc_id, b.item_id")
def join11_ngram_contamination(spark, d):
    return relations.shared_ngrams(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "item_id", "text", 8)


@query(f"select count(*) as pair_count, count(distinct doc_id) as n_docs, count(distinct item_id) as n_items from (select a.doc_id, b.item_id from {_grams('documents', 'doc_id', 'text', 4)} a join {_grams('benchmark', 'item_id', 'text', 4)} b on a.g = b.g group by a.doc_id, b.item_id)")
def agg20_overlap_summary(spark, d):
    """Of all pairs that share a run of four words, counted without a row for each of those that common runs make."""
    found = overlap.paired_overlap(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "item_id", {"text": 4}, rare=100)
    return found.summary().select("pair_count", F.col("n_left").alias("n_docs"), F.col("n_right").alias("n_items"))


_TONES = "(select *, 'keep the ' || {0} || ' voice of it all in {1}' as tone from {1})"


@query(f"""
with a as {_grams(_TONES.format("lang", "documents"), 'doc_id', 'text', 4)}, b as {_grams(_TONES.format("['en', 'de', 'fr', 'es'][item_id % 4 + 1]", "benchmark"), 'item_id', 'text', 4)},
x as {_grams(_TONES.format("lang", "documents"), 'doc_id', 'tone', 5)}, y as {_grams(_TONES.format("['en', 'de', 'fr', 'es'][item_id % 4 + 1]", "benchmark"), 'item_id', 'tone', 5)}
select doc_id, count(*) as n from (select distinct a.doc_id, b.item_id from a join b on a.g = b.g intersect select distinct x.doc_id, y.item_id from x join y on x.g = y.g) group by doc_id
""")
def join11_paired_overlap(spark, d):
    """Texts and instructions must both overlap; instructions of a language are alike in a quarter of either side, which makes no rows."""
    docs = t(spark, d, "documents").withColumn("tone", F.concat(F.lit("keep the "), "lang", F.lit(" voice of it all in documents")))
    langs = F.get(F.array(*(F.lit(x) for x in ("en", "de", "fr", "es"))), (F.col("item_id") % 4).cast("int"))
    items = t(spark, d, "benchmark").withColumn("tone", F.concat(F.lit("keep the "), langs, F.lit(" voice of it all in benchmark")))
    return overlap.paired_overlap(docs, items, "doc_id", "item_id", {"text": 4, "tone": 5}, rare=100).partners().select(F.col("left").alias("doc_id"), "n")


@query("""
with p as (select p_partkey, lower(p_brand) as brand from part), g as (select distinct regexp_replace(brand, '[0-9]', '__slot__', 'g') as signature from p union select distinct brand from p where p_partkey % 50 = 0)
select p_partkey, count(*) as n from p, g where case when contains(signature, '__slot__') then regexp_full_match(brand, replace(signature, '__slot__', '.+?')) else brand = signature end group by p_partkey
""")
def join12_template_signatures(spark, d):
    """Texts by template: the patterns come from the brands, __slot__ for their digits, and some brands as they are."""
    part = t(spark, d, "part").select("p_partkey", F.lower("p_brand").alias("brand"))
    signatures = part.select(F.regexp_replace("brand", "[0-9]", "__slot__").alias("signature")).unionByName(part.where("p_partkey % 50 = 0").select(F.col("brand").alias("signature")))
    return patterns.signature_matches(signatures, part, "signature", "brand").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query(f"""
with n as (select doc_id, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' as n from documents),
p as (select distinct array_to_string(w[1:3], ' ') as phrase from (select {_WORDS.format('text')} as w from benchmark) where len(w) >= 3)
select distinct doc_id, phrase from n, p where contains(n, ' ' || phrase || ' ')
""")
def join13_phrase_hits(spark, d):
    docs = t(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("n"))
    words = text.tokens(F.col("text"))
    phrases = t(spark, d, "benchmark").where(F.size(words) >= 3).select(F.array_join(F.slice(words, 1, 3), " ").alias("phrase")).distinct()
    return relations.phrase_hits(docs, phrases, "doc_id", "n", "phrase")


@query("select event_id, event_type from events e where not exists (select 1 from events x where x.event_id = e.event_id and x.value > 10)")
def join14_resume_accepted_only(spark, d):
    events = t(spark, d, "events")
    return relations.resume(events.select("event_id", "event_type"), events.select("event_id", "value"), "event_id", F.col("value") > 10)


@query("select doc_id, case when o then 'left' else 'right' end as only_in from (select doc_id, true as o from (select doc_id from documents except select doc_id from labels) union all select doc_id, false from (select doc_id from labels except select doc_id from documents))")
def join16_id_set_difference(spark, d):
    return relations.symmetric_difference(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id")


@query("""
select doc_id, unnest(list_filter([case when quality is distinct from 1 then 'quality' end, case when toxic is distinct from 0 then 'toxic' end], lambda x: x is not null)) as "column" from labels
""")
def join17_disagreements(spark, d):
    labels = t(spark, d, "labels")
    return relations.disagreements(labels, labels.withColumns({"quality": F.lit(1), "toxic": F.lit(0)}), "doc_id", ["quality", "toxic"])


@query("select r_name, o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, o_orderpriority")
def join18_lookup_joins(spark, d):
    small = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = t(spark, d, "customer").join(small, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    orders = t(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select n_nationkey * 3 + k as case_no, n_name, task from nation, (values (0, 'add'), (1, 'remove'), (2, 'replace')) v(k, task)")
def join21_sources_by_templates(spark, d):
    tasks = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("task")) for k, x in enumerate(("add", "remove", "replace"))))
    return t(spark, d, "nation").select("n_nationkey", "n_name", F.inline(tasks)).select((F.col("n_nationkey") * 3 + F.col("k")).alias("case_no"), "n_name", "task")


# Aggregations

_COUNTS = "count_if(g = 1 and p = 1) as tp, count_if(g = 0 and p = 1) as fp, count_if(g = 1 and p = 0) as fn, count_if(g = 0 and p = 0) as tn"
_PRF = "case when tp + fp = 0 then 0.0 else tp / (tp + fp) end::double as precision, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end::double as recall, case when 2 * tp + fp + fn = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end::double as f1"
_FLAGS = "select lang, quality as g, case when n_chars > 1000 then 1 else 0 end as p from documents d join labels l on d.doc_id = l.doc_id"


def _flags(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 1000).cast("int").alias("p"))
    return docs.join(t(spark, d, "labels").select("doc_id", F.col("quality").alias("g")), "doc_id")


@query(f"select tp, fp, fn, tn, {_PRF} from (select {_COUNTS} from ({_FLAGS}))")
def agg01_confusion(spark, d):
    return metrics.binary_metrics(_flags(spark, d), "g", "p")


@query(f"select lang, sum(kept)::bigint as kept, sum(n)::bigint as n, sum(kept) / sum(n)::double as micro, count_if(kept = n) as whole from (select lang, len(w) as n, len(list_filter(w, lambda x: length(x) > 3)) as kept from (select lang, {_WORDS.format('text')} as w from documents) where len(w) > 0) group by lang")
def agg04_micro_and_case_ratio(spark, d):
    w = text.tokens(F.col("text"))
    rows = t(spark, d, "documents").select("lang", F.size(w).alias("n"), F.size(F.filter(w, lambda x: F.length(x) > 3)).alias("kept")).where("n > 0")
    return rows.groupBy("lang").agg(F.sum("kept").alias("kept"), F.sum("n").alias("n"), (F.sum("kept") / F.sum("n")).alias("micro"), F.count_if(F.col("kept") == F.col("n")).alias("whole"))


def _votes(spark, d):
    pick = lambda c, k: F.when(F.pmod(c, F.lit(k)) == 0, "A").when(F.pmod(c, F.lit(k)) == 1, "B").when(F.pmod(c, F.lit(k)) == 2, "tie").otherwise("invalid")
    return t(spark, d, "documents").select("doc_id", "source", pick(F.col("doc_id"), 4).alias("a"), pick(F.col("doc_id") + F.length("lang") + F.col("n_chars"), 5).alias("b"))


_VOTE = "case {0} % {1} when 0 then 'A' when 1 then 'B' when 2 then 'tie' else 'invalid' end"
_VOTES = f"select {_VOTE.format('doc_id', 4)} as a, {_VOTE.format('(doc_id + length(lang) + n_chars)', 5)} as b from documents"


@query(f"""
with v as ({_VOTES}), u as (select * from v where a in ('A', 'B', 'tie') and b in ('A', 'B', 'tie')),
s as (select count(*) as n, count_if(a = b) as agreed, count_if(a <> 'tie' and b <> 'tie') as directed, count_if(a <> 'tie' and a = b) as da,
  count_if(a = 'A') * count_if(b = 'A') + count_if(a = 'B') * count_if(b = 'B') + count_if(a = 'tie') * count_if(b = 'tie') as chance, count_if(a = 'tie') as ties_a, count_if(b = 'tie') as ties_b from u)
select (select count(*) from v) as rows, n as usable, (select count(*) from v) - n as excluded, n / (select count(*) from v)::double as coverage, agreed / n::double as exact,
  da / directed::double as directional, ties_a / n::double as a_tie_rate, ties_b / n::double as b_tie_rate, (n * agreed - chance)::double / (n * n - chance) as kappa from s
""")
def agg06_agreement_and_kappa(spark, d):
    return metrics.agreement(_votes(spark, d), "a", "b")


@query(f"select x.l as a, y.l as b, coalesce(n, 0) as n from (values ('A'), ('B'), ('tie')) x(l) cross join (values ('A'), ('B'), ('tie')) y(l) left join (select a, b, count(*) as n from ({_VOTES}) group by a, b) c on c.a = x.l and c.b = y.l")
def agg07_confusion_table(spark, d):
    return metrics.confusion_table(_votes(spark, d), "a", "b", ["A", "B", "tie"])


@query("select lang, source, grouping(lang) * 2 + grouping(source) as level, count(*) as n, avg(n_chars) as mean_n_chars from documents group by grouping sets ((), (lang), (source), (lang, source))")
def agg09_rollup_means(spark, d):
    return metrics.rollup_means(t(spark, d, "documents"), ["lang", "source"], ["n_chars"])


@query("""
select lang, count(*) as n, count(distinct doc_id) as n_distinct, count(distinct doc_id) / t::double as coverage, min(doc_id) as low, max(doc_id) as high,
  count_if(q = 1) as q1, count_if(q = 2) as q2, count_if(q = 3) as q3, count_if(q = 4) as q4
from (select d.*, least(4, doc_id * 4 // t + 1) as q, t from documents d, (select max(doc_id) + 1 as t from documents)) group by lang, t
""")
def agg14_source_audit(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang")
    return metrics.audit(docs, "doc_id", docs.agg(F.max("doc_id")).first()[0] + 1, ["lang"])


@query("select event_type as reason, count(*) as n, list_sort(list(event_id))[1:5] as examples from events group by event_type")
def agg18_reasons_with_examples(spark, d):
    return metrics.examples(t(spark, d, "events").select(F.col("event_type").alias("reason"), "event_id", F.col("event_id").alias("key")), "reason", "event_id", "key", 5)


@query("select lang, sha256(string_agg(source, chr(10) order by source)) as digest, count(*) as n from (select distinct lang, source from documents) group by lang")
def agg21_set_digest(spark, d):
    return digests.set_digest(t(spark, d, "documents"), "source", ["lang"])


@query("""
with p as (select source, max(case when lang = 'en' then n_chars end) as en, max(case when lang = 'fr' then n_chars end) as fr, max(case when lang = 'de' then n_chars end) as de from documents group by source)
select source, en, fr, de, coalesce(en = (select max(en) from p), false) as best_en, coalesce(fr = (select max(fr) from p), false) as best_fr, coalesce(de = (select min(de) from p), false) as best_de from p
""")
def agg19_score_pivot(spark, d):
    """Methods by types, and who is best in each: two columns where more is better, one where less is."""
    pivot = t(spark, d, "documents").groupBy("source").pivot("lang", ["en", "fr", "de"]).agg(F.max("n_chars"))
    return metrics.best_marked(pivot, {"en": True, "fr": True, "de": False})


@query("select kind, n, total, total::double / n as mean from (select coalesce(l_returnflag, 'global') as kind, count(*) as n, sum(l_quantity) as total from lineitem group by rollup (l_returnflag))")
def agg26_counts_and_sums(spark, d):
    """Counts, sums and means of each kind, and of all rows."""
    return metrics.means_by_type(t(spark, d, "lineitem"), "l_returnflag", "l_quantity")


@query()
def agg24_paired_bootstrap(spark, d):
    """Standard errors of two candidates' mean scores, strata by toxicity; the indices of 10,000 draws come from one stream of Python's generator."""
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    pos = F.row_number().over(Window.partitionBy("toxic").orderBy("doc_id")) - 1
    rows = rows.select(F.col("toxic").cast("string").alias("stratum"), pos.cast("long").alias("case_pos"), "quality", "n_chars")
    pair = F.array(F.struct(F.lit("label").alias("candidate"), F.col("quality").cast("double").alias("score")), F.struct(F.lit("length").alias("candidate"), (F.col("n_chars") > 1000).cast("double").alias("score")))
    return metrics.paired_bootstrap(rows.select("stratum", "case_pos", F.inline(pair)), draws=10_000, seed=20260916)


# Windows and ranking


@query("select text, doc_id, source from (select *, row_number() over (partition by text order by doc_id) as k from documents) where k = 1")
def win01_first_wins(spark, d):
    return ranking.first_wins(t(spark, d, "documents").select("text", "doc_id", "source"), ["text"], ["doc_id"])


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) where k = 1")
def win01_last_wins(spark, d):
    return ranking.last_wins(t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("select source, doc_id from (select *, row_number() over (partition by source order by sha256('q' || chr(31) || doc_id::varchar), doc_id) as k from documents) where k <= 10")
def win02_group_quota(spark, d):
    h = numbers.stable_hash(F.lit("q"), F.col("doc_id").cast("string"))
    return ranking.quota(t(spark, d, "documents").select("source", "doc_id"), ["source"], [h, "doc_id"], 10)


@query("select i.item_id, n.n_name from (select item_id, (row_number() over (order by item_id) - 1) % 25 as r from benchmark) i join nation n on i.r = n.n_nationkey")
def win06_cyclic_assignment(spark, d):
    items = ranking.with_positions(t(spark, d, "benchmark").select("item_id"), ["item_id"])
    return items.withColumn("r", F.pmod("_pos", F.lit(25))).join(t(spark, d, "nation"), F.col("r") == F.col("n_nationkey")).select("item_id", "n_name")


@query("with t as (select count(*) as n from documents), p as (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents) select slot, pos, doc_id from range(50) r(slot), t, p where p.pos = least(t.n - 1, ((2 * slot + 1) * t.n) // 100)")
def win07_evenly_spaced(spark, d):
    docs = ranking.with_positions(t(spark, d, "documents").select("doc_id"), ["doc_id"], "pos")
    return ranking.evenly_spaced_rows(docs, "pos", t(spark, d, "documents").count(), 50).select("slot", "pos", "doc_id")


@query("select case when backwards then 'backwards' else 'forwards' end as way, shard, count(*) as n, min(doc_id) as low from (select doc_id, backwards, case when backwards then row_number() over (partition by backwards order by doc_id desc) - 1 else row_number() over (partition by backwards order by doc_id) - 1 end % 8 as shard from documents, (values (true), (false)) v(backwards)) group by all")
def win11_modulo_shards(spark, d):
    """Shards by remainder, of positions from the beginning and from the end."""
    docs = ranking.with_positions(t(spark, d, "documents").select("doc_id"), ["doc_id"])
    total = F.lit(docs.count())
    ways = {"forwards": ranking.shard(F.col("_pos"), 8), "backwards": ranking.shard(F.col("_pos"), 8, total)}
    rows = docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(w).alias("way"), s.alias("shard")) for w, s in ways.items()))))
    return rows.groupBy("way", "shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))


@query("select rank, min(doc_id) as low, max(doc_id) as high, count(*) as n from (select doc_id, ntile(7) over (order by doc_id) - 1 as rank from documents) group by rank")
def win12_contiguous_ranks(spark, d):
    docs = t(spark, d, "documents").select("doc_id")
    placed = ranking.with_positions(docs, ["doc_id"])
    rank = ranking.contiguous_rank(F.col("_pos"), F.lit(docs.count()), 7)
    return placed.groupBy(rank.cast("long").alias("rank")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))


@query("""
with b as (select item_id as _pos from benchmark), c as (select row_number() over (order by p_partkey) - 1 as _pos from part),
n as (select least((select count(*) from b) // 1, (select count(*) from c) // 2) as cycles)
select _pos * 3 + 1 as slot, 'items' as loader, _pos from b, n where _pos < cycles
union all select (_pos // 2) * 3 + case when _pos % 2 = 0 then 0 else 2 end, 'parts', _pos from c, n where _pos < cycles * 2
""")
def win13_pattern_interleave(spark, d):
    items = ranking.with_positions(t(spark, d, "benchmark").select("item_id"), ["item_id"])
    parts = ranking.with_positions(t(spark, d, "part").select("p_partkey"), ["p_partkey"])
    sizes = {"items": t(spark, d, "benchmark").count(), "parts": t(spark, d, "part").count()}
    return ranking.interleave({"items": items, "parts": parts}, ["parts", "items", "parts"], sizes)


# Sorts, limits and samples


@query("select doc_id, sha256('pick' || chr(31) || doc_id::varchar) as rank_hash from documents order by rank_hash, doc_id limit 100")
def srt02_hash_ranked_sample(spark, d):
    return ranking.hash_ranked(t(spark, d, "documents").select("doc_id"), "pick", "doc_id", 100)


@query("select o_custkey, min_by(o_orderkey, (o_totalprice, o_orderkey)) as cheapest from orders group by o_custkey")
def srt04_argmin_with_ties(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"))


@query("with c as (select p_partkey, p_retailprice from part), m as (select max(p_retailprice) as b from c) select p_partkey, p_retailprice from c, m where p_retailprice >= b - 50 order by p_partkey limit 1")
def srt05_one_standard_error(spark, d):
    return metrics.one_standard_error(t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 50.0)


@query("""
with g as (select source, row_number() over (order by sha256(source), source) as k, count(*) over () as n from (select distinct source from documents))
select d.doc_id, case when k <= least(n - 1, greatest(1, round_even(n * 0.1, 0)::int)) then 'eval' else 'train' end as split from documents d join g on d.source = g.source
""")
def srt11_grouped_split(spark, d):
    return ranking.grouped_split(t(spark, d, "documents").select("doc_id", "source"), "source", 0.1).select("doc_id", "split")


# Sets


@query("select doc_id as id, 'document' as part from documents union all select item_id, 'benchmark' from benchmark")
def set01_concatenation(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("part"))
    return docs.unionByName(t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("part")))


@query("select count(*) as shared from (select doc_id from documents intersect select doc_id from labels)")
def set02_intersection_size(spark, d):
    return t(spark, d, "documents").select("doc_id").intersect(t(spark, d, "labels").select("doc_id")).agg(F.count("*").alias("shared"))


@query("select l_orderkey as id from lineitem except select o_orderkey from orders where o_orderstatus = 'F'")
def set03_difference(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).subtract(t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@query("select count(*) = 0 as is_subset from (select doc_id from labels except select doc_id from documents)")
def set05_subset_proof(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id", "left_anti").agg((F.count("*") == 0).alias("is_subset"))


# Scalar functions


@query(f"select doc_id, array_to_string({_WORDS.format('text')}, ' ') as normal from documents")
def str01_normalize(spark, d):
    return t(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query("select doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as tokens from documents")
def str02_ascii_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_sort(text.ascii_token_set(F.col("text"))).alias("tokens"))


@query("select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') as squashed from documents")
def str03_squash(spark, d):
    return t(spark, d, "documents").select("doc_id", text.squash(F.col("text")).alias("squashed"))


@query(f"select doc_id, count(*) as n_grams from {_grams('documents', 'doc_id', 'text', 3)} group by doc_id")
def str05_ngram_sets(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(text.ngrams(text.tokens(F.col("text")), 3)).cast("long").alias("n_grams")).where("n_grams > 0")


@query("select page_id, 'web_' || nullif(trim(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), '') as id from pages")
def str08_safe_ids(spark, d):
    return t(spark, d, "pages").select("page_id", text.safe_id(F.col("url"), None, F.lit("web")).alias("id"))


@query("select page_id, regexp_replace('<b>' || html || '</b>', '</?b>', '', 'g') as plain from pages")
def str11_strip_tags(spark, d):
    return t(spark, d, "pages").select("page_id", text.strip_bold(F.concat(F.lit("<b>"), "html", F.lit("</b>"))).alias("plain"))


@query("select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as escaped from pages")
def str12_html_escape(spark, d):
    return t(spark, d, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query("select page_id, split_part(url, '/', -1) as base, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1), '') as root from pages")
def str13_paths_and_hosts(spark, d):
    return t(spark, d, "pages").select("page_id", text.basename(F.col("url")).alias("base"), text.host_root(F.col("url")).alias("root"))


@query("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value, len(json_keys(props)) as n_keys from events where props is not null")
def json05_json_lookup(spark, d):
    keys = F.json_object_keys("props")
    values = F.from_json("props", "map<string, string>")
    return t(spark, d, "events").where("props is not null").select("event_id", F.element_at(values, F.get(keys, F.lit(0))).alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


@query("select doc_id, sha256(source || chr(31) || lang || chr(31) || doc_id::varchar) as h, md5(source) as m from documents")
def hsh01_stable_hashes(spark, d):
    return t(spark, d, "documents").select("doc_id", numbers.stable_hash("source", "lang", F.col("doc_id").cast("string")).alias("h"), F.md5("source").alias("m"))


