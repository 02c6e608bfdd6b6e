"""The planner's contract: plans as canonical JSON objects, their validation, repair and scoring.

A plan column holds canonical JSON (functions.exact) or null. Fields are read as variants, so a field's type is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import lexicon, text
from siltstone.functions.exact import lenient_object, strict_object
from siltstone.functions.numbers import precision_recall_f1, ratio
from siltstone.operators.metrics import confusion
from siltstone.operators.relations import violations


def is_text(plan: Column, field: str) -> Column:
    """Is the field a JSON string?"""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(plan), f"$.{field}", "variant"))
    return F.coalesce(kind == "STRING", F.lit(False))


def field_text(plan: Column, field: str) -> Column:
    """The field's string, or null if it is none."""
    return F.when(is_text(plan, field), F.get_json_object(plan, f"$.{field}"))


def is_false(plan: Column, field: str) -> Column:
    """Is the field JSON false, and not the text false?"""
    return ~is_text(plan, field) & F.coalesce(F.get_json_object(plan, f"$.{field}") == "false", F.lit(False))


def triggered(plan: Column, field: str) -> Column:
    """Is the field a string that is not blank?"""
    return text.not_blank(field_text(plan, field))


def valid(plan: Column) -> Column:
    """Exactly the fields of a plan; an instruction that is not blank, a known subtask, and search and mask false or not blank."""
    names = F.array_sort(F.json_object_keys(plan)) == F.array(*(F.lit(x) for x in sorted(lexicon.PLAN_FIELDS)))
    known = F.coalesce(field_text(plan, "subtask").isin(*lexicon.SUBTASKS), F.lit(False))
    flags = [is_false(plan, x) | triggered(plan, x) for x in ("image_search", "mask")]
    return F.coalesce(names, F.lit(False)) & triggered(plan, "refined_text_instruction") & known & flags[0] & flags[1]


def contract_violations(plan: Column) -> Column:
    """Codes of what a valid plan's tools and subtask contradict: search in a few subtasks only, a mask exactly for removal."""
    removes = field_text(plan, "subtask") == "remove_object"
    return violations([
        ("image_search_not_allowed_for_subtask", is_text(plan, "image_search") & ~field_text(plan, "subtask").isin(*lexicon.SEARCHABLE_SUBTASKS)),
        ("remove_object_missing_mask", removes & ~is_text(plan, "mask")),
        ("mask_not_allowed_for_subtask", ~removes & ~is_false(plan, "mask")),
    ])


def extract(plan: Column, raw: Column) -> Column:
    """The plan if it is an object, else what the raw answer parses to."""
    return F.coalesce(lenient_object(plan), lenient_object(raw))


def extract_strict(raw: Column) -> Column:
    """The plan of the whole raw answer, without any repair."""
    return strict_object(raw)


def extract_from_record(candidates: list[Column], messages: DataFrame, key: str, position: str) -> tuple[list[Column], DataFrame]:
    """Canonical forms of the candidate columns, first to last, and by key the last message of an assistant that is an object.

    messages: key, position, role, content. The second part is an aggregate: no record's messages are gathered.
    """
    said = messages.where("role = 'assistant'").withColumn("_plan", lenient_object("content")).where("_plan is not null")
    return [lenient_object(c) for c in candidates], said.groupBy(key).agg(F.max_by("_plan", position).alias("message_plan"))


def normalized(raw: Column) -> Column:
    """A raw plan's fields as a struct: stripped texts, an unknown subtask as combined_tasks, and null where a flag says no."""
    field = lambda x: text.strip(F.coalesce(F.get_json_object(raw, f"$.{x}"), F.lit("")))
    flag = lambda x: F.when(~text.is_false_text(F.get_json_object(raw, f"$.{x}")), field(x))
    subtask = F.when(field("subtask").isin(*lexicon.SUBTASKS), field("subtask")).otherwise("combined_tasks")
    return F.struct(field("refined_text_instruction").alias("refined_text_instruction"), subtask.alias("subtask"), flag("image_search").alias("image_search"), flag("mask").alias("mask"))


def chat_row_errors(system: Column, messages: Column, videos: Column) -> Column:
    """Codes of what a training row lacks: a system prompt, a user's and an assistant's message, one video, one <video> mark before the request, a valid plan that is consistent."""
    user, said = F.get(messages, F.lit(0))["content"], strict_object(F.get(messages, F.lit(1))["content"])
    roles = F.transform(messages, lambda m: m["role"])
    parts = F.split(user, "[<]video[>]", 2)
    marked = (text.count_of(user, "<video>") == 1) & ~text.not_blank(F.get(parts, F.lit(0))) & text.not_blank(F.get(parts, F.lit(1)))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return violations([
        ("system", ~text.not_blank(system)),
        ("messages", no(F.size(messages) == 2)),
        ("roles", no(roles == F.array(F.lit("user"), F.lit("assistant")))),
        ("videos", no(F.size(videos) == 1)),
        ("video_mark", no(marked)),
        ("plan", no(valid(said))),
        ("contract", no(F.size(contract_violations(said)) == 0)),
    ])


def path_ends_with(path: Column, end: Column) -> Column:
    """Is end the whole path, if it is absolute, or else its last parts?"""
    a, b = F.split(path, "/"), F.split(end, "/")
    return F.when(end.startswith("/"), path == end).otherwise((F.size(a) >= F.size(b)) & (F.slice(a, F.greatest(F.lit(1), F.size(a) - F.size(b) + 1), F.size(b)) == b))


def pair_errors(request: Column, plan: Column, video: Column, user: Column, said: Column, videos: Column) -> Column:
    """Codes of how a canonical record (request, plan, video) and its chat row (user and assistant content, videos) differ."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    parsed = lenient_object(said)
    return violations([
        ("no_request", ~text.not_blank(request)),
        ("no_plan", plan.isNull()),
        ("request_mismatch", no(user == F.concat(F.lit("<video>\n"), request))),
        ("plan_not_json", parsed.isNull()),
        ("plan_mismatch", parsed.isNotNull() & no(parsed == lenient_object(plan))),
        ("video_mismatch", no((F.size(videos) == 1) & text.not_blank(video) & path_ends_with(F.get(videos, F.lit(0)), video))),
    ])


def fingerprint(video: Column, prompt: Column, plan: Column) -> Column:
    """SHA-256 of the video, the normalised prompt and the canonical plan, with unit separators between them."""
    return F.sha2(F.concat_ws("\x1f", video, text.normalize(prompt), strict_object(plan)), 256)


def retained(constraints: Column, instruction: Column) -> Column:
    """How many constraints (value, aliases) have a normalised value or alias in the normalised instruction, at any place."""
    said = text.normalize(instruction)
    variants = lambda c: F.concat(F.array(c["value"]), F.coalesce(c["aliases"], F.array().cast("array<string>")))
    return F.size(F.filter(constraints, lambda c: F.exists(variants(c), lambda v: said.contains(text.normalize(v)))))


def query_matches(query: Column, aliases: Column) -> Column:
    """Does any alias stand in the query as whole words? Empty ones do not."""
    said = text.normalize(query)
    return F.exists(aliases, lambda a: text.contains_phrase(said, text.normalize(a)))


def scored(rows: DataFrame) -> DataFrame:
    """rows with the flags that the metrics count.

    rows: gold (canonical plan), plan and strict (canonical plans or null), aliases, has_entities, constraints.
    """
    gold, plan = F.col("gold"), F.when(F.col("is_valid"), F.col("plan"))
    out = rows.withColumns({"is_valid": valid(F.col("plan")), "is_strict": valid(F.col("strict"))})
    out = out.withColumns({
        "routed": F.coalesce(field_text(plan, "subtask") == field_text(gold, "subtask"), F.lit(False)),
        "search_gold": triggered(gold, "image_search"), "search_said": triggered(plan, "image_search"),
        "mask_gold": triggered(gold, "mask"), "mask_said": triggered(plan, "mask"),
    })
    correct = F.col("search_gold") & F.col("search_said") & query_matches(field_text(plan, "image_search"), F.col("aliases"))
    kept = retained(F.col("constraints"), F.coalesce(F.when(F.col("is_valid"), field_text(F.col("plan"), "refined_text_instruction")), F.lit("")))
    return out.withColumns({"query_correct": F.coalesce(correct, F.lit(False)), "n_constraints": F.size("constraints"), "n_retained": kept})


def planner_metrics(rows: DataFrame, axis: str) -> DataFrame:
    """All metrics of scored rows, overall (axis null) and by axis, in one pass; rows without an axis count overall only."""
    n = F.count("*")
    one = lambda name, c: F.count_if(c).alias(name)
    pairs = {f"{x}_{k}": v for x in ("search", "mask") for k, v in confusion(F.col(f"{x}_gold").cast("int"), F.col(f"{x}_said").cast("int")).items()}
    entity = F.col("has_entities") & ~F.col("search_gold")
    sums = rows.groupingSets([[], [F.col(axis)]], F.col(axis)).agg(
        F.grouping(axis).alias("_all"), n.alias("num_cases"),
        *(one(f"_{c}", F.col(c)) for c in ("is_valid", "is_strict", "routed")),
        *(v.alias(k) for k, v in pairs.items()),
        one("query_positive", F.col("search_gold")), one("query_triggered", F.col("search_gold") & F.col("search_said")), one("query_correct", F.col("query_correct")),
        F.sum("n_retained").alias("_kept"), F.sum("n_constraints").alias("_wanted"),
        one("_cases", F.col("n_constraints") > 0), one("_whole", (F.col("n_constraints") > 0) & (F.col("n_retained") == F.col("n_constraints"))),
        one("entity_cases", entity), one("entity_false", entity & F.col("search_said")),
    ).where(f"_all = 1 or coalesce({axis}, '') <> ''")
    rates = {f"{x}_{k}": v for x in ("search", "mask") for k, v in precision_recall_f1(F.col(f"{x}_tp"), F.col(f"{x}_fp"), F.col(f"{x}_fn")).items()}
    cases = F.col("num_cases")
    return sums.select(
        axis, "num_cases", ratio(F.col("_is_valid"), cases).alias("json_validity"), ratio(F.col("_is_strict"), cases).alias("strict_validity"), ratio(F.col("_routed"), cases).alias("subtask_accuracy"),
        *pairs, *(v.alias(k) for k, v in rates.items()),
        "query_positive", "query_triggered", "query_correct",
        ratio(F.col("query_correct"), F.col("query_triggered")).alias("query_accuracy"), ratio(F.col("query_correct"), F.col("query_positive")).alias("query_recall"),
        ratio(F.col("_kept"), F.col("_wanted"), 1.0).alias("constraint_retention"), ratio(F.col("_whole"), F.col("_cases"), 1.0).alias("constraint_case_accuracy"),
        "entity_cases", "entity_false", ratio(F.col("entity_false"), F.col("entity_cases")).alias("entity_rate"),
    )
