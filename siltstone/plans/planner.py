"""Registered queries of the planner's contract: JSON plans, their checks, repair and scores, and hard requests.

The plans are written as JSON text from the documents' columns, with every kind of fault at known ids; the SQL says what
must come out from the ids alone, without reading JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import lexicon, text
from siltstone.functions.exact import lenient_object, strict_object
from siltstone.operators import metrics, planner, relations, requests
from siltstone.plans.catalog import query, t

_SAID = (*lexicon.SUBTASKS, "zoom_in", "")


def _pick(values, i: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), i.cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def plan_cases(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, axis, source, lang, plan, raw, gold: one planner case a document."""
    k = F.col("doc_id")
    mod = lambda n: F.pmod(k, F.lit(n))
    text_of = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    search = F.when(mod(5) == 0, text_of(F.concat("source", F.lit(" shoe")))).when(mod(5) == 4, text_of(F.concat("lang", F.lit(" tower")))).when(mod(5) == 3, '"  "').otherwise("false")
    mask = F.when(mod(3) == 0, text_of(F.concat(F.lit("the "), "lang", F.lit(" part")))).otherwise("false")
    wish = F.when(mod(19) == 0, "  ").otherwise(F.concat(F.lit("Edit "), "source", F.lit(" in "), "lang"))
    plan = F.concat(F.lit('{"subtask": "'), _pick(_SAID, mod(13)), F.lit('", "refined_text_instruction": "'), wish, F.lit('", "image_search": '), search, F.lit(', "mask": '), mask, F.lit("}"))
    sub = lambda a, b: F.replace(F.col("_plan"), F.lit(a), F.lit(b))
    raw = (
        F.when((mod(23) == 0) | (mod(17) == 6), F.lit(None).cast("string"))
        .when(mod(17) == 0, F.concat("_plan", F.lit(" x"))).when(mod(17) == 1, sub('{"subtask"', '{"mask": false, "subtask"')).when(mod(17) == 2, sub('"mask": ', '"mask": NaN, "m": '))
        .when(mod(17) == 3, '{"subtask": "add_object"}').when(mod(17) == 4, sub("{", '{"extra": 1, ')).when(mod(17) == 5, F.concat(F.lit("["), "_plan", F.lit("]"))).when(mod(17) == 7, F.concat("_plan", F.lit("\n ")))
        .otherwise(F.col("_plan"))
    )
    gold_search = F.when(mod(20) == 4, "false").when((mod(5) == 0) | (mod(5) == 4) | (mod(20) == 1), '"x"').otherwise("false")
    gold_task = _pick(lexicon.SUBTASKS, F.when(mod(10) == 9, F.pmod(k + 1, F.lit(11))).otherwise(F.pmod(mod(13), F.lit(11))))
    gold = F.concat(F.lit('{"image_search": '), gold_search, F.lit(', "mask": '), F.when(mod(6) == 0, '"y"').otherwise("false"), F.lit(', "refined_text_instruction": "z", "subtask": "'), gold_task, F.lit('"}'))
    docs = t(spark, d, "documents").select("doc_id", F.when(mod(11) == 0, "").otherwise(F.col("lang")).alias("axis"), "source", "lang", plan.alias("_plan"))
    return docs.select("doc_id", "axis", "source", "lang", F.when((mod(17) == 8) & (mod(23) != 0), F.col("_plan")).alias("plan"), raw.alias("raw"), gold.alias("gold"))


_WHOLE = "doc_id % 19 <> 0 and doc_id % 13 < 11 and doc_id % 5 <> 3 and doc_id % 23 <> 0"
_LENIENT = "doc_id % 23 <> 0 and doc_id % 17 not in (0, 5, 6)"
_STRICT = "doc_id % 23 <> 0 and doc_id % 17 not in (0, 1, 2, 5, 6)"
_VALID = f"({_WHOLE} and doc_id % 17 not in (0, 2, 3, 4, 5, 6))"
_VALID_STRICT = f"({_WHOLE} and doc_id % 17 not in (0, 1, 2, 3, 4, 5, 6))"
_TASK = f"({_list(_SAID)})[doc_id % 13 + 1]"
_SEARCHES, _MASKS = "doc_id % 5 in (0, 4)", "doc_id % 3 = 0"


@query(f"select doc_id, {_STRICT} as is_object from documents")
def json01_strict_objects(spark, d):
    return plan_cases(spark, d).select("doc_id", strict_object("raw").isNotNull().alias("is_object"))


@query(f"select doc_id, {_LENIENT} as found, case when {_LENIENT} then case when doc_id % 17 = 3 then 'add_object' else {_TASK} end end as subtask from documents")
def json02_plan_with_fallback(spark, d):
    plan = planner.extract(F.col("plan"), F.col("raw"))
    return plan_cases(spark, d).select("doc_id", plan.alias("p")).select("doc_id", F.col("p").isNotNull().alias("found"), F.get_json_object("p", "$.subtask").alias("subtask"))


@query(f"""
select doc_id, case when doc_id % 4 = 0 and {_LENIENT} then 'gold' when doc_id % 4 = 1 and {_LENIENT} then 'target' when doc_id % 3 <> 2 then 'message ' || (doc_id % 3) end as origin from documents
""")
def json03_plan_of_a_record(spark, d):
    """gold_plan, then target_plan, then the last message of the assistant that is a JSON object."""
    k = F.col("doc_id")
    cases = plan_cases(spark, d).select("doc_id", F.when(k % 4 == 0, F.col("raw")).alias("gold_plan"), F.when(k % 4 == 1, F.col("raw")).alias("target_plan"))
    note = lambda n: F.concat(F.lit('{"note": "message '), F.lit(str(n)), F.lit('"}'))
    said = F.array(
        F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), note(9).alias("content")),
        F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.when(k % 3 != 2, note(0)).otherwise("none").alias("content")),
        F.struct(F.lit(2).alias("turn"), F.lit("assistant").alias("role"), F.when(k % 3 == 1, note(1)).otherwise("{broken").alias("content")),
    )
    messages = cases.select("doc_id", F.inline(said))
    (gold, target), last = planner.extract_from_record([F.col("gold_plan"), F.col("target_plan")], messages, "doc_id", "turn")
    origin = F.when(gold.isNotNull(), "gold").when(target.isNotNull(), "target").otherwise(F.get_json_object("message_plan", "$.note"))
    return cases.join(last, "doc_id", "left").select("doc_id", origin.alias("origin"))


@query(f"select doc_id, {_VALID} as valid, {_VALID_STRICT} as valid_strict from documents")
def flt01_plan_contract(spark, d):
    cases = plan_cases(spark, d).select("doc_id", planner.extract(F.col("plan"), F.col("raw")).alias("p"), planner.extract_strict(F.col("raw")).alias("s"))
    return cases.select("doc_id", planner.valid(F.col("p")).alias("valid"), planner.valid(F.col("s")).alias("valid_strict"))


@query(f"select doc_id, {_SEARCHES} and {_STRICT} and doc_id % 17 <> 3 as search, {_MASKS} and {_STRICT} and doc_id % 17 <> 3 as mask from documents")
def flt02_triggers(spark, d):
    cases = plan_cases(spark, d).select("doc_id", strict_object("raw").alias("p"))
    return cases.select("doc_id", *(planner.triggered(F.col("p"), x).alias(y) for x, y in (("image_search", "search"), ("mask", "mask"))))


_CODES = f"""list_filter([
  case when {_SEARCHES} and {_TASK} not in ('add_object', 'replace_object', 'change_background', 'customization') then 'image_search_not_allowed_for_subtask' end,
  case when {_TASK} = 'remove_object' and not ({_MASKS}) then 'remove_object_missing_mask' end,
  case when {_TASK} <> 'remove_object' and {_MASKS} then 'mask_not_allowed_for_subtask' end], lambda x: x is not null)"""


def _valid_plans(spark, d):
    cases = plan_cases(spark, d).select("doc_id", strict_object("raw").alias("p"))
    return cases.where(planner.valid(F.col("p"))).select("doc_id", planner.field_text(F.col("p"), "subtask").alias("subtask"), planner.contract_violations(F.col("p")).alias("codes"))


@query(f"select doc_id, {_CODES} as codes from documents where {_VALID_STRICT}")
def flt03_contract_violations(spark, d):
    return _valid_plans(spark, d).select("doc_id", "codes")


@query(f"select code, subtask, count(*) as n from (select unnest({_CODES}) as code, {_TASK} as subtask from documents where {_VALID_STRICT}) group by grouping sets ((), (code), (subtask), (code, subtask))")
def agg17_violations_by_code_and_subtask(spark, d):
    codes = F.explode("codes").alias("code")
    return _valid_plans(spark, d).select(codes, "subtask").groupingSets([[], [F.col("code")], [F.col("subtask")], [F.col("code"), F.col("subtask")]], "code", "subtask").agg(F.count("*").alias("n"))


@query(f"select {_TASK} as subtask, count(*) as n, count_if({_SEARCHES}) as n_search, count_if({_MASKS}) as n_mask, count(distinct source) as n_sources from documents where {_VALID_STRICT} group by all")
def agg16_plan_distribution(spark, d):
    cases = plan_cases(spark, d).select("source", strict_object("raw").alias("p")).where(planner.valid(F.col("p")))
    flags = [planner.triggered(F.col("p"), x).alias(x) for x in ("image_search", "mask")]
    rows = cases.select("source", planner.field_text(F.col("p"), "subtask").alias("subtask"), *flags)
    return rows.groupBy("subtask").agg(F.count("*").alias("n"), F.count_if("image_search").alias("n_search"), F.count_if("mask").alias("n_mask"), F.count_distinct("source").alias("n_sources"))


def _chat_rows(spark, d):
    """A training row a document, with one fault at the ids of each class of doc_id % 9."""
    k = F.pmod(F.col("doc_id"), F.lit(9))
    request = F.concat(F.lit("Edit "), "source")
    user = F.when(k == 1, request).when(k == 2, F.concat(F.lit("<video> <video>"), request)).when(k == 3, F.lit("<video>\n  ")).otherwise(F.concat(F.lit("<video>\n"), request))
    plan = F.concat(F.lit('{"image_search": false, "mask": '), F.when(k == 4, '"x"').otherwise("false"), F.lit(', "refined_text_instruction": "'), request, F.lit('", "subtask": "add_effect"}'))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    good = F.array(message("user", user), message("assistant", F.when(k == 5, F.lit("{}")).otherwise(plan)))
    messages = F.when(k == 6, F.slice(good, 1, 1)).when(k == 7, F.reverse(good)).otherwise(good)
    return t(spark, d, "documents").select(
        "doc_id", F.when(k == 8, " ").otherwise("You plan edits.").alias("system"), messages.alias("messages"),
        F.array(F.concat(F.lit("data/videos/"), "source", F.lit(".mp4"))).alias("videos"), request.alias("request"), plan.alias("plan"), F.concat(F.lit("videos/"), "source", F.lit(".mp4")).alias("video"),
    )


@query("""
select doc_id, case doc_id % 9 when 1 then ['video_mark'] when 2 then ['video_mark'] when 3 then ['video_mark'] when 4 then ['contract'] when 5 then ['plan']
  when 6 then ['messages', 'roles', 'plan'] when 7 then ['roles', 'video_mark', 'plan'] when 8 then ['system'] else []::varchar[] end as errors from documents
""")
def flt04_chat_row_contract(spark, d):
    return _chat_rows(spark, d).select("doc_id", planner.chat_row_errors(F.col("system"), F.col("messages"), F.col("videos")).alias("errors"))


@query("""
select doc_id, list_filter([case when doc_id % 9 in (1, 2, 3) or doc_id % 9 = 7 then 'request_mismatch' end, case when doc_id % 9 = 6 or doc_id % 9 = 7 then 'plan_not_json' end,
  case when doc_id % 9 = 5 then 'plan_mismatch' end, case when doc_id % 7 = 0 then 'video_mismatch' end], lambda x: x is not null) as errors from documents
""")
def flt05_pair_validation(spark, d):
    rows = _chat_rows(spark, d).withColumn("video", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("other/"), "video")).otherwise(F.col("video")))
    content = lambda i: F.get("messages", F.lit(i))["content"]
    return rows.select("doc_id", planner.pair_errors(F.col("request"), F.col("plan"), F.col("video"), content(0), content(1), F.col("videos")).alias("errors"))


@query(f"""
select doc_id, case when doc_id % 19 = 0 then '' else 'Edit ' || source || ' in ' || lang end as instruction, case when doc_id % 13 < 11 then {_TASK} else 'combined_tasks' end as subtask,
  case doc_id % 5 when 0 then source || ' shoe' when 4 then lang || ' tower' end as search, case when {_MASKS} then 'the ' || lang || ' part' end as mask
from documents where doc_id % 23 <> 0 and doc_id % 17 in (4, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)
""")
def prj08_normalized_plans(spark, d):
    cases = plan_cases(spark, d).where("pmod(doc_id, 23) <> 0 and pmod(doc_id, 17) in (4, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)")
    p = planner.normalized(strict_object("raw"))
    return cases.select("doc_id", p.alias("p")).selectExpr("doc_id", "p.refined_text_instruction as instruction", "p.subtask", "p.image_search as search", "p.mask")


_SCORED = f"""
select doc_id, case when doc_id % 11 = 0 then '' else lang end as axis, {_VALID} as ok, {_VALID_STRICT} as strict_ok,
  {_VALID} and {_TASK} = ({_list(lexicon.SUBTASKS)})[case when doc_id % 10 = 9 then (doc_id + 1) % 11 else doc_id % 13 % 11 end + 1] as routed,
  doc_id % 20 <> 4 and (doc_id % 5 in (0, 4) or doc_id % 20 = 1) as sg, {_VALID} and {_SEARCHES} as sp, doc_id % 6 = 0 as mg, {_VALID} and {_MASKS} as mp,
  (doc_id % 5 = 0 and doc_id % 2 = 0) or (doc_id % 5 = 4 and doc_id % 2 = 1) as alias_ok, doc_id % 3 <> 0 as entities,
  case when doc_id % 7 = 0 then 0 else 2 + (doc_id % 4 = 0)::int + (doc_id % 6 = 0)::int end as wanted,
  case when doc_id % 7 = 0 then 0 else 2 * ({_VALID})::int + (doc_id % 6 = 0)::int end as kept
from documents
"""


def _r(a: str, b: str, default: str = "0.0") -> str:
    return f"case when {b} = 0 then {default} else ({a}) / ({b})::double end::double"


def _scored_cases(spark, d) -> DataFrame:
    k = F.col("doc_id")
    item = lambda value, *aliases: F.struct(value.alias("value"), (F.array(*aliases) if aliases else F.array().cast("array<string>")).alias("aliases"))
    wanted = [item(F.col("source")), item(F.concat("lang", F.lit(" zzz")), F.concat(F.lit("IN "), "lang"))]
    constraints = F.filter(F.array(*wanted, F.when(k % 4 == 0, item(F.lit("never"))), F.when(k % 6 == 0, item(F.lit(" ?")))), lambda c: c.isNotNull())
    aliases = F.when(k % 2 == 0, F.array(F.concat("source", F.lit(" Shoe")), F.lit(""))).otherwise(F.array(F.lit("tower"), F.lit("?")))
    rows = plan_cases(spark, d).select(
        "doc_id", "axis", strict_object("gold").alias("gold"), planner.extract(F.col("plan"), F.col("raw")).alias("plan"), planner.extract_strict(F.col("raw")).alias("strict"),
        aliases.alias("aliases"), (k % 3 != 0).alias("has_entities"), F.when(k % 7 == 0, F.slice(constraints, 1, 0)).otherwise(constraints).alias("constraints"),
    )
    return planner.scored(rows)


@query(f"""
select axis, num_cases, json_validity, strict_validity, subtask_accuracy, search_tp, search_fp, search_fn, search_tn, mask_tp, mask_fp, mask_fn, mask_tn,
  {_r('search_tp', 'search_tp + search_fp')} as search_precision, {_r('search_tp', 'search_tp + search_fn')} as search_recall, {_r('2 * search_tp', '2 * search_tp + search_fp + search_fn')} as search_f1,
  {_r('mask_tp', 'mask_tp + mask_fp')} as mask_precision, {_r('mask_tp', 'mask_tp + mask_fn')} as mask_recall, {_r('2 * mask_tp', '2 * mask_tp + mask_fp + mask_fn')} as mask_f1,
  query_positive, query_triggered, query_correct, {_r('query_correct', 'query_triggered')} as query_accuracy, {_r('query_correct', 'query_positive')} as query_recall,
  {_r('kept', 'wanted', '1.0')} as constraint_retention, {_r('whole', 'cases', '1.0')} as constraint_case_accuracy, entity_cases, entity_false, {_r('entity_false', 'entity_cases')} as entity_rate
from (select axis, grouping(axis) as everything, count(*) as num_cases, count_if(ok) / count(*)::double as json_validity, count_if(strict_ok) / count(*)::double as strict_validity, count_if(routed) / count(*)::double as subtask_accuracy,
  count_if(sg and sp) as search_tp, count_if(not sg and sp) as search_fp, count_if(sg and not sp) as search_fn, count_if(not sg and not sp) as search_tn,
  count_if(mg and mp) as mask_tp, count_if(not mg and mp) as mask_fp, count_if(mg and not mp) as mask_fn, count_if(not mg and not mp) as mask_tn,
  count_if(sg) as query_positive, count_if(sg and sp) as query_triggered, count_if(sg and sp and alias_ok) as query_correct,
  sum(kept) as kept, sum(wanted) as wanted, count_if(wanted > 0) as cases, count_if(wanted > 0 and kept = wanted) as whole, count_if(entities and not sg) as entity_cases, count_if(entities and not sg and sp) as entity_false
  from ({_SCORED}) group by grouping sets ((), (axis))) where everything = 1 or axis <> ''
""")
def agg02_planner_metrics(spark, d):
    return planner.planner_metrics(_scored_cases(spark, d), "axis")


@query(f"select doc_id, wanted::bigint as wanted, kept::bigint as kept, wanted > 0 and kept = wanted as whole from ({_SCORED})")
def flt11_constraints_retained(spark, d):
    rows = _scored_cases(spark, d).select("doc_id", F.col("n_constraints").cast("long").alias("wanted"), F.col("n_retained").cast("long").alias("kept"))
    return rows.withColumn("whole", (F.col("wanted") > 0) & (F.col("kept") == F.col("wanted")))


@query(f"select doc_id from ({_SCORED}) where sg and sp and alias_ok")
def flt12_query_aliases(spark, d):
    return _scored_cases(spark, d).where("query_correct").select("doc_id")


@query(f"select verdict, count(*) as n, list_sort(list(doc_id))[1:20] as first_ids from (select doc_id, case when not ok then 'invalid' when not routed then 'routing' when sg and not sp then 'missed' when sg and sp and not alias_ok then 'wrong' end as verdict from ({_SCORED})) where verdict is not null group by verdict")
def agg05_error_ids(spark, d):
    """Errors by kind, and the first ids of each: a report of bounded size."""
    rules = [("invalid", ~F.col("is_valid")), ("routing", ~F.col("routed")), ("missed", F.col("search_gold") & ~F.col("search_said")), ("wrong", F.col("search_gold") & F.col("search_said") & ~F.col("query_correct"))]
    rows = _scored_cases(spark, d).select("doc_id", relations.first_reason(rules).alias("verdict")).where("verdict is not null")
    return metrics.examples(rows.withColumn("key", F.col("doc_id")), "verdict", "doc_id", "key", 20).withColumnRenamed("examples", "first_ids")


@query(f"""
select doc_id, sha256('videos/' || source || chr(31) || 'edit ' || source || ' in ' || lang || chr(31) || '{{"image_search": ' || case doc_id % 5 when 0 then '"' || source || ' shoe"' when 4 then '"' || lang || ' tower"' when 3 then '"  "' else 'false' end
  || ', "mask": ' || case when {_MASKS} then '"the ' || lang || ' part"' else 'false' end || ', "refined_text_instruction": "' || case when doc_id % 19 = 0 then '  ' else 'Edit ' || source || ' in ' || lang end || '", "subtask": "' || {_TASK} || '"}}') as fingerprint
from documents where doc_id % 23 <> 0 and doc_id % 17 > 6
""")
def hsh02_row_fingerprints(spark, d):
    cases = plan_cases(spark, d).where("pmod(doc_id, 23) <> 0 and pmod(doc_id, 17) > 6")
    prompt = F.concat(F.lit("Edit  "), "source", F.lit(", IN "), "lang")
    return cases.select("doc_id", planner.fingerprint(F.concat(F.lit("videos/"), "source"), prompt, F.col("raw")).alias("fingerprint"))


@query("select doc_id, '{\"a\": [' || n_chars || ', null], \"b\": \"' || source || '\", \"z\": {\"m\": ' || (doc_id % 2 = 0)::varchar || ', \"n\": 1.5}}' as canonical from documents")
def udf07_canonical_json(spark, d):
    made = F.concat(F.lit('{"z":{"n":1.5,"m":'), (F.col("doc_id") % 2 == 0).cast("string"), F.lit('},"b":"'), "source", F.lit('","a":['), F.col("n_chars").cast("string"), F.lit(",null]}"))
    return t(spark, d, "documents").select("doc_id", lenient_object(made).alias("canonical"))


# Hard requests


def _request_cases(spark, d) -> DataFrame:
    """Source requests, rewritten ones, categories and plans, from the names of parts."""
    k = F.col("p_partkey")
    source = F.concat(F.lit("Remove the "), "p_name", F.when(k % 3 == 0, " on the left").otherwise(""), F.when(k % 4 == 0, ", all 2 of them").otherwise(""))
    request = (
        F.when(k % 7 == 0, F.upper(source)).when(k % 7 == 1, F.concat(F.lit("please get rid of that "), "p_name")).when(k % 7 == 2, F.lit("swap it for a golden one, both 2"))
        .when(k % 7 == 3, F.concat(F.lit("take away the "), "p_name", F.lit(" at left, 2 of them"))).otherwise(F.concat(F.lit("paint the "), "p_name", F.lit(" red")))
    )
    task = _pick(("remove_object", "combined_tasks", "change_color", "customization", "replace_object"), k % 5)
    search = F.when(k % 6 == 0, F.concat(F.lit("the "), "p_brand")).when(k % 6 == 1, "false")
    mask = F.when(k % 5 == 0, F.concat(F.lit("the "), "p_name", F.lit(" in the top corner"))).when(k % 5 == 1, "")
    return t(spark, d, "part").select("p_partkey", source.alias("source"), request.alias("request"), _pick(lexicon.CATEGORIES, k % 9).alias("kind"), task.alias("subtask"), search.alias("search"), mask.alias("mask"))


_REQUESTS = f"""
select p_partkey, s as source, r as request, lower(s) as ls, lower(r) as lr, ({_list(lexicon.CATEGORIES)})[p_partkey % 9 + 1] as kind, ['remove_object', 'combined_tasks', 'change_color', 'customization', 'replace_object'][p_partkey % 5 + 1] as subtask,
  case when p_partkey % 6 = 0 then 'the ' || p_brand end as search, case when p_partkey % 5 = 0 then 'the ' || p_name || ' in the top corner' end as mask
from (select *, case p_partkey % 7 when 0 then upper(s) when 1 then 'please get rid of that ' || p_name when 2 then 'swap it for a golden one, both 2' when 3 then 'take away the ' || p_name || ' at left, 2 of them' else 'paint the ' || p_name || ' red' end as r
  from (select *, 'Remove the ' || p_name || case when p_partkey % 3 = 0 then ' on the left' else '' end || case when p_partkey % 4 = 0 then ', all 2 of them' else '' end as s from part))
"""
_TOK = "list_distinct(regexp_extract_all({0}, '[a-z0-9]+'))"
_PROTECTED = _list(sorted({w for g in lexicon.PROTECTED_TERM_GROUPS for w in g} | set(lexicon.CONSTRAINT_ALIASES)))
_ALIAS = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in lexicon.CONSTRAINT_ALIASES.items()) + "}"


def _terms(c: str) -> str:
    words = f"list_transform(list_filter({_TOK.format(c)}, lambda w: list_contains({_PROTECTED}, w)), lambda w: coalesce({_ALIAS}[w], w))"
    return f"list_distinct(list_concat({words}, regexp_extract_all({c}, '\\b([0-9]+(?:\\.[0-9]+)?)\\b', 1)))"


def _group_count(c: str) -> str:
    groups = " + ".join(f"list_has_any({_TOK.format(c)}, {_list(g)})::int" for g in lexicon.PROTECTED_TERM_GROUPS)
    return f"({groups} + regexp_matches({c}, '\\b[0-9]+(?:\\.[0-9]+)?\\b')::int)"


def _any(c: str, words) -> str:
    flat = f"' ' || trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g')) || ' '"
    return "(" + " or ".join(f"contains({flat}, ' {w} ')" for w in words) + ")"


@query(f"select p_partkey, list_sort({_terms('ls')}) as terms, {_group_count('ls')} as n_groups from ({_REQUESTS})")
def str06_constraint_terms(spark, d):
    s = F.col("source")
    return _request_cases(spark, d).select("p_partkey", F.array_sort(requests.constraint_terms(s)).alias("terms"), requests.constraint_groups(s).alias("n_groups"))


_LOST = f"list_sort(list_filter({_terms('ls')}, lambda x: not list_contains({_terms('lr')}, x)))"
_ERRORS = ", ".join([
    "case when trim(regexp_replace(ls, '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lr, '[^a-z0-9]+', ' ', 'g')) then 'unchanged_from_base' end",
    f"case when len({_LOST}) > 0 then 'missing_constraints:' || array_to_string({_LOST}, ',') end",
    "case when " + " or ".join(f"(subtask = '{s}' and not {_any('lr', w)})" for s, w in lexicon.ACTION_TERMS.items()) + " then 'missing_action:' || subtask end",
    *(f"case when subtask = 'combined_tasks' and {_any('ls', w)} and not {_any('lr', w)} then 'missing_combined_action:{a}' end" for a, w in lexicon.COMBINED_ACTION_GROUPS.items()),
    f"case when search is not null and len(list_filter({_TOK.format('lower(search)')}, lambda w: not list_contains({_list(lexicon.SEARCH_STOPWORDS)}, w))) > 0 and not list_has_any({_TOK.format('lr')}, list_filter({_TOK.format('lower(search)')}, lambda w: not list_contains({_list(lexicon.SEARCH_STOPWORDS)}, w))) then 'missing_search_entity' end",
    "case when (search is not null) <> (kind = 'under_search') then 'search_category_mismatch' end",
    "case when kind = 'over_search_negative' and search is not null then 'over_search_category_mismatch' end",
    f"case when kind = 'multiple_constraints' and {_group_count('ls')} < 2 then 'insufficient_source_constraints' end",
    "case when kind = 'pronoun_grounding' and not regexp_matches(lr, '\\b(it|this|that|this one|that one|the one)\\b') then 'missing_grounding_pronoun' end",
    "case when kind = 'mask_granularity' and mask is null then 'mask_category_mismatch' end",
    f"case when kind = 'mask_granularity' and mask is not null and len(m) > 0 and len(list_intersect(m, {_TOK.format('lr')})) / len(m)::double < 0.4 then 'insufficient_mask_detail' end",
    "case when kind = 'compositional_edit' and subtask <> 'combined_tasks' then 'composition_category_mismatch' end",
])


@query(f"select p_partkey, list_filter([{_ERRORS}], lambda x: x is not null) as errors from (select *, list_filter({_TOK.format('lower(mask)')}, lambda w: not list_contains({_list(lexicon.MASK_STOPWORDS)}, w)) as m from ({_REQUESTS}))")
def flt08_hard_requests(spark, d):
    c = F.col
    return _request_cases(spark, d).select("p_partkey", requests.request_errors(c("source"), c("request"), c("kind"), c("subtask"), c("search"), c("mask")).alias("errors"))


_GENERAL = [x for x in lexicon.GENERAL_CATEGORIES if x != "multiple_constraints"]


@query(f"""
select p_partkey, case when search is not null then 'under_search' when subtask = 'combined_tasks' then 'compositional_edit' when mask is not null then 'mask_granularity'
  when {_group_count('ls')} < 2 then ({_list(_GENERAL)})[h % {len(_GENERAL)} + 1] else ({_list(lexicon.GENERAL_CATEGORIES)})[h % {len(lexicon.GENERAL_CATEGORIES)} + 1] end as category
from (select *, ('0x' || substr(sha256(p_partkey::varchar), 1, 8))::bigint as h from ({_REQUESTS}))
""")
def prj09_request_category(spark, d):
    c = F.col
    return _request_cases(spark, d).select("p_partkey", requests.category(c("p_partkey").cast("string"), c("source"), c("subtask"), c("search"), c("mask")).alias("category"))


@query(f"""
select p_partkey, list_concat(list_transform(list_sort({_terms('ls')}), lambda w: 'retain the concept ''' || w || ''''), list_filter([
  {", ".join(f"case when subtask = 'combined_tasks' and {_any('ls', w)} then 'express the ''{a}'' edit action' end" for a, w in lexicon.COMBINED_ACTION_GROUPS.items())},
  case when kind = 'pronoun_grounding' then 'use a demonstrative or grounding pronoun such as ''that'', ''this'', or ''the one''' end,
  case when kind = 'under_search' and search is not null then 'name the searched identity ''' || search || '''' end,
  case when kind = 'mask_granularity' and (mask is not null or p_partkey % 5 = 1) then 'identify the mask target with these details: ' || coalesce(mask, '') end], lambda x: x is not null)) as lines from ({_REQUESTS})
""")
def str15_checklist(spark, d):
    c = F.col
    return _request_cases(spark, d).select("p_partkey", requests.checklist(c("source"), c("kind"), c("subtask"), c("search"), c("mask")).alias("lines"))


@query("select item_id, 'The ' || lower(substr(t, 1, 1)) || substr(t, 2) as x from (select item_id, rtrim(trim(regexp_replace(text, '\\s+', ' ', 'g')), '.') as t from benchmark)")
def str16_generated_text(spark, d):
    """A sentence by template, with the first letter of what is put in lowered."""
    flat = text.collapse(F.col("text"))
    return t(spark, d, "benchmark").select("item_id", text.template("The {x}", x=F.concat(F.lower(F.substring(flat, 1, 1)), F.substr(flat, F.lit(2)))).alias("x"))
