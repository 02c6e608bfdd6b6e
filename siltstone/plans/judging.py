"""Registered queries on scores that models write as text, rubric roll-ups and agreement."""

from __future__ import annotations


from pyspark.sql import functions as F

from siltstone.functions import lexicon, text
from siltstone.operators import judging, metrics, relations
from siltstone.plans.catalog import _VOTES, _votes, query, t

_AXES = list(lexicon.RUBRIC_AXES)


def _said(k):
    """A judge's answer: an axis has the score (k + its number) % 5, in one of several notations; 4 and a range are no scores."""
    lines = []
    for i, label in enumerate(lexicon.RUBRIC_AXES.values()):
        score = F.pmod(k + i, F.lit(5)).cast("string")
        shape = F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit(f"- **{label}** (0-3): **"), score, F.lit("**"))).when(F.pmod(k, F.lit(4)) == 1, F.concat(F.lit(f"{i + 1}. {label.lower()}: ["), score, F.lit("] good")))
        lines.append(shape.when(F.pmod(k, F.lit(4)) == 2, F.concat(F.lit(f"{label}: "), score, F.lit("-3"))).otherwise(F.concat(F.lit(f"The {label}: "), score)))
    total = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("\nTotal: "), F.pmod(k, F.lit(22)).cast("string"))).otherwise("")
    return F.concat(F.concat_ws("\n", *lines), total)


_ONE = "case when doc_id % 4 in (0, 1) and (doc_id + {0}) % 5 < 4 then (doc_id + {0}) % 5 end"
_SUM = " + ".join("(" + _ONE.format(i) + ")" for i in range(len(_AXES)))


@query("select doc_id, " + ", ".join(f"{_ONE.format(i)} as {a}" for i, a in enumerate(_AXES)) + f", case when doc_id % 3 = 0 then doc_id % 22 else {_SUM} end as total from documents")
def json06_judge_scores(spark, d):
    return t(spark, d, "documents").select("doc_id", _said(F.col("doc_id")).alias("said")).select("doc_id", *(c.cast("long").alias(k) for k, c in judging.axis_scores(F.col("said")).items()))


@query("select page_id, case when len(n) > 0 then round_even(list_sum(n) / len(n), 2) end as mean from (select page_id, list_transform(regexp_extract_all(html, ':\\s*([0-9]+\\.?[0-9]*)', 1), lambda x: x::double) as n from pages)")
def json07_numbers_after_colons(spark, d):
    """The mean of all numbers after colons in pages as they are."""
    return t(spark, d, "pages").select("page_id", judging.mean_after_colons(F.col("html")).alias("mean"))


_KIND = "['removal', 'swap', 'reasoning', 'insert'][doc_id % 4 + 1]"


def _frames(spark, d):
    """Three frames a document with a score for each axis; some are missing."""
    k, f = F.col("doc_id"), F.col("frame")
    docs = t(spark, d, "documents").select("doc_id", F.get(F.array(*(F.lit(x) for x in ("removal", "swap", "reasoning", "insert"))), (k % 4).cast("int")).alias("kind"), F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("frame"))
    score = lambda i: F.when((k + f + i) % 13 != 0, ((k * (i + 2) + f * 3) % 4).cast("int"))
    return docs.select("doc_id", "kind", *(score(i).alias(a) for i, a in enumerate(_AXES)))


def _frame_sql() -> str:
    scores = ", ".join(f"case when (doc_id + f + {i}) % 13 <> 0 then (doc_id * {i + 2} + f * 3) % 4 end as {a}" for i, a in enumerate(_AXES))
    relevant = lambda a: f"case when {'kind in (' + repr('swap') + ', ' + repr('insert') + ')' if a in lexicon.ENTITY_AXES else 'true'} then {a} end"
    total = " + ".join(f"case when kind in ('removal', 'reasoning') and {a in lexicon.ENTITY_AXES} then 0 else {a} end" for a in _AXES)
    frames = f"select *, {total} as total from (select doc_id, {_KIND} as kind, {scores} from documents, range(3) r(f))"
    cases = f"select doc_id, kind, case when kind in ('swap', 'insert') then 21 else 15 end as total_max, avg(total) as m, {', '.join(f'round_even(avg({relevant(a)}), 4) as {a}' for a in _AXES)} from ({frames}) group by doc_id, kind"
    return f"select doc_id, kind, total_max, round_even(m, 4) as average, round_even(m / total_max, 4) as fair_fraction, round_even(round_even(m / total_max, 4) * 21, 4) as fair_total, {', '.join(_AXES)} from ({cases})"


@query(_frame_sql())
def agg11_rubric_cases(spark, d):
    return judging.rubric_cases(_frames(spark, d), "doc_id", "kind")


@query(f"select kind, count(*) as n, avg(average) as average, avg(fair_fraction) as fair_fraction, {', '.join(f'avg({a}) as {a}, count({a}) as n_{a}' for a in _AXES)} from ({_frame_sql()}) where average is not null group by grouping sets ((), (kind))")
def agg11_rubric_summary(spark, d):
    return judging.rubric_summary(judging.rubric_cases(_frames(spark, d), "doc_id", "kind"), "kind")


@query("select doc_id, list_filter([" + ", ".join(f"'{a}'" if a not in lexicon.ENTITY_AXES else f"case when doc_id % 4 in (1, 3) then '{a}' end" for a in _AXES) + "], lambda x: x is not null) as axes, case when doc_id % 4 in (1, 3) then 21 else 15 end as total_max from documents")
def flt19_relevant_axes(spark, d):
    kind = F.get(F.array(*(F.lit(x) for x in ("removal", "swap", "reasoning", "insert"))), (F.col("doc_id") % 4).cast("int"))
    return t(spark, d, "documents").select("doc_id", relations.violations([(a, judging.is_relevant(a, kind)) for a in _AXES]).alias("axes"), judging.total_max(kind).alias("total_max"))


@query("select source as kind, count(*) as n, avg(n_chars % 7) as mean from documents where n_chars % 7 between 1 and 5 group by grouping sets ((), (source))")
def agg10_valid_score_means(spark, d):
    return metrics.valid_score_means(t(spark, d, "documents").select(F.col("source").alias("kind"), (F.col("n_chars") % 7).alias("score")), "score", "kind")


_LABELLED = _VOTES.replace(" from documents", ", case when doc_id % 10 <> 3 then source end as axis from documents")


@query(f"""
with v as (select a, b, coalesce(axis, 'unknown') as axis, a in ('A', 'B', 'tie') and b in ('A', 'B', 'tie') as ok from ({_LABELLED})),
s as (select axis, count(*) as rows, count_if(ok) as n, count_if(ok and a = b) as agreed, count_if(ok and a <> 'tie' and b <> 'tie') as directed, count_if(ok and a <> 'tie' and a = b) as da, count_if(ok and a = 'tie') as ta, count_if(ok and b = 'tie') as tb,
  count_if(ok and a = 'A') * count_if(ok and b = 'A') + count_if(ok and a = 'B') * count_if(ok and b = 'B') + count_if(ok and a = 'tie') * count_if(ok and b = 'tie') as chance from v group by grouping sets ((), (axis)))
select axis, rows, n as usable, rows - n as excluded, n / rows::double as coverage, case when n > 0 then agreed / n::double end as exact, case when directed > 0 then da / directed::double end as directional,
  case when n = 0 then 0.0 else ta / n::double end as a_tie_rate, case when n = 0 then 0.0 else tb / n::double end as b_tie_rate, case when n = 0 then null when chance = n * n then 1.0 else (n * agreed - chance)::double / (n * n - chance) end as kappa from s
""")
def agg08_agreement_by_axis(spark, d):
    votes = _votes(spark, d).withColumn("axis", F.when(F.col("doc_id") % 10 != 3, F.col("source")))
    return metrics.agreement(votes, "a", "b", by="axis")


@query(f"select doc_id, 'missing_or_invalid_label' as reason from (select doc_id, a, b from ({_VOTES.replace('from documents', ', doc_id from documents')})) where a = 'invalid' or b = 'invalid'")
def agg08_excluded_rows(spark, d):
    return _votes(spark, d).where("a = 'invalid' or b = 'invalid'").select("doc_id", F.lit("missing_or_invalid_label").alias("reason"))


@query(f"""
with s as (select count(*) as num_pairs, count_if(a = b) as same, count_if(a = 'invalid' and b = 'invalid') as hit, count_if(b = 'invalid') as said, count_if(a = 'invalid') as truth from ({_VOTES}))
select num_pairs, same / num_pairs::double as four_way_agreement, hit / said::double as invalid_precision, hit / truth::double as invalid_recall, 2 * (hit / said::double) * (hit / truth::double) / (hit / said::double + hit / truth::double) as invalid_f1 from s
""")
def agg13_four_way_agreement(spark, d):
    return metrics.four_way(_votes(spark, d), "a", "b")


@query("select d.doc_id, l.toxic, d.a as judge from (select doc_id, case doc_id % 4 when 0 then 'A' when 1 then 'B' when 2 then 'tie' else 'invalid' end as a from documents) d join labels l on d.doc_id = l.doc_id where d.a <> 'invalid'")
def join09_judge_with_human(spark, d):
    """Judgements beside the human labels; every judgement must have one, which join07_missing_partners reports."""
    judged = _votes(spark, d).select("doc_id", F.col("a").alias("judge")).where("judge <> 'invalid'")
    return judged.join(t(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


@query("select doc_id, 'no label' as violation from documents where doc_id not in (select doc_id from labels) and doc_id % 4 <> 3")
def join07_missing_partners(spark, d):
    judged = _votes(spark, d).select("doc_id", F.col("a").alias("judge")).where("judge <> 'invalid'")
    return relations.missing_partners(judged, t(spark, d, "labels"), "doc_id", "no label")


@query("select d.doc_id, l.quality from documents d left join labels l on d.doc_id = l.doc_id where l.doc_id is not null or d.doc_id % 2 = 0")
def join10_optional_records(spark, d):
    """Cases with their records: those that require one go without."""
    docs = t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2 != 0).alias("requires"))
    return relations.with_records(docs, t(spark, d, "labels").select("doc_id", "quality"), "doc_id", F.col("requires")).select("doc_id", "quality")


@query("select model, count(*) as n, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens from (select source as model, n_chars // 4 as i, n_chars % 50 as o from documents) group by model")
def agg28_usage_totals(spark, d):
    """Token usage from the JSON records of calls, summed by agent."""
    usage = F.concat(F.lit('{"usage": {"input_tokens": '), F.floor(F.col("n_chars") / 4).cast("string"), F.lit(', "output_tokens": '), (F.col("n_chars") % 50).cast("string"), F.lit("}}"))
    calls = t(spark, d, "documents").select(F.col("source").alias("model"), usage.alias("record"))
    read = lambda k: F.get_json_object("record", f"$.usage.{k}").cast("long")
    return calls.groupBy("model").agg(F.count("*").alias("n"), F.sum(read("input_tokens")).alias("input_tokens"), F.sum(read("output_tokens")).alias("output_tokens"))


@query("select doc_id, upper(source) as json from documents where n_chars > 0")
def json04_embedded_object(spark, d):
    """The object that a model wrapped in prose and code fences."""
    made = F.concat(F.lit('Sure!\n```json\n{"a": {"b": "'), F.upper("source"), F.lit('"}}\n``` Anything else?'))
    return t(spark, d, "documents").where("n_chars > 0").select("doc_id", F.get_json_object(text.strip_fences(made), "$.a.b").alias("json"))


@query("select doc_id, least(1 + n_chars % 3, greatest(1, case when doc_id % 3 = 0 then doc_id % 7 else 1 end)) as chosen from documents")
def flt24_chosen_candidate(spark, d):
    """The candidate that a model's answer names, 1 without a number, within the candidates there are."""
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("I take Image  "), (F.col("doc_id") % 7).cast("string"), F.lit("."))).otherwise("none of them")
    return t(spark, d, "documents").select("doc_id", text.candidate_number(said, F.col("n_chars") % 3 + 1).cast("long").alias("chosen"))


@query("select lang, source, n, n <> 5 as wrong from (select lang, source, count(*) as n from documents group by all) where n <> 5")
def agg27_balance_check(spark, d):
    return metrics.unequal_groups(t(spark, d, "documents"), ["lang", "source"], 5).withColumn("wrong", F.lit(True))


@query("select source, sum(quality) / count(quality)::double * 0.5 + (1 - sum(toxic) / count(toxic)::double) * 0.5 as utility from documents d join labels l on d.doc_id = l.doc_id group by source having count(quality) > 0 and count(toxic) > 0")
def agg25_utility(spark, d):
    """Half specificity, half retention, of the labelled documents of each source."""
    joined = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id")
    parts = joined.groupBy("source").agg(F.avg("quality").alias("retention"), (1 - F.avg("toxic")).alias("specificity")).where("retention is not null and specificity is not null")
    return parts.select("source", (F.lit(0.5) * F.col("specificity") + F.lit(0.5) * F.col("retention")).alias("utility"))


@query("select doc_id, abs(mean - metric) <= 1e-12 as agrees from (select doc_id, (quality + toxic) / 2.0 as mean, (quality + toxic + case when doc_id % 9 = 0 then 1 else 0 end) / 2.0 as metric from labels)")
def agg25_cross_check(spark, d):
    """Recomputed means against the figures of a report, within a tolerance."""
    mean = (F.col("quality") + F.col("toxic")) / 2
    metric = (F.col("quality") + F.col("toxic") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)) / 2
    return t(spark, d, "labels").select("doc_id", (F.abs(mean - metric) <= 1e-12).alias("agrees"))


@query("select lang, n_sources, n_texts, reduce_ok from (select lang, count(distinct source) as n_sources, count(distinct text) as n_texts, count(distinct source) = count(distinct lower(source)) as reduce_ok from documents group by lang)")
def agg33_invariants(spark, d):
    """Across candidates: what must be one value, and what must be different everywhere."""
    return t(spark, d, "documents").groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("text").alias("n_texts"), (F.count_distinct("source") == F.count_distinct(F.lower("source"))).alias("reduce_ok"))


@query("select doc_id, reason from (select doc_id, case when quality is null then 'no quality' when toxic = 1 then 'toxic' when quality = 0 then 'poor' end as reason from labels) where reason is not null")
def flt21_required_fields(spark, d):
    rules = [("no quality", F.col("quality").isNull()), ("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0)]
    return t(spark, d, "labels").select("doc_id", relations.first_reason(rules).alias("reason")).where("reason is not null")


