"""Hard requests: which category a plan gets, and whether a rewritten request keeps what the source asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import lexicon, numbers, text
from siltstone.operators.relations import violations

_NUMBER = r"\b([0-9]+(?:\.[0-9]+)?)\b"


def _lits(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def constraint_terms(request: Column) -> Column:
    """The protected words, by the name they are counted as, and the numbers of a request: a set."""
    protected = _lits(sorted({w for g in lexicon.PROTECTED_TERM_GROUPS for w in g} | set(lexicon.CONSTRAINT_ALIASES)))
    names = F.create_map(*(F.lit(x) for pair in lexicon.CONSTRAINT_ALIASES.items() for x in pair))
    words = F.filter(text.ascii_token_set(request), lambda w: F.array_contains(protected, w))
    found = F.regexp_extract_all(F.lower(request), F.lit(_NUMBER), F.lit(1))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.coalesce(F.try_element_at(names, w), w)), found))


def constraint_groups(request: Column) -> Column:
    """From how many groups of protected words, numbers being one more, the request has a word."""
    words = text.ascii_token_set(request)
    groups = [F.arrays_overlap(words, _lits(g)).cast("int") for g in lexicon.PROTECTED_TERM_GROUPS]
    return reduce(lambda a, b: a + b, groups) + request.rlike(_NUMBER).cast("int")


def category(key: Column, request: Column, subtask: Column, search: Column, mask: Column) -> Column:
    """The category of a plan: by its tools, else one of the general ones by the key's hash; that of several constraints needs two groups of them."""
    general = [c for c in lexicon.GENERAL_CATEGORIES if c != "multiple_constraints"]
    pick = lambda names: F.element_at(_lits(names), (numbers.hash_choice(key, len(names)) + 1).cast("int"))
    free = F.when(constraint_groups(request) < 2, pick(general)).otherwise(pick(lexicon.GENERAL_CATEGORIES))
    return F.when(text.is_enabled(search), "under_search").when(subtask == "combined_tasks", "compositional_edit").when(text.is_enabled(mask), "mask_granularity").otherwise(free)


def _any_term(squashed: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [text.padded(squashed).contains(f" {w} ") for w in terms])


def request_errors(source: Column, request: Column, kind: Column, subtask: Column, search: Column, mask: Column) -> Column:
    """Codes of what is wrong with a rewritten request, in order. search and mask are texts, or null where the plan says false."""
    before, after = text.squash(source), text.squash(request)
    lost = F.array_sort(F.array_except(constraint_terms(source), constraint_terms(request)))
    action = reduce(lambda a, b: a | b, [(subtask == s) & ~_any_term(after, w) for s, w in lexicon.ACTION_TERMS.items()])
    combined = [F.when((subtask == "combined_tasks") & _any_term(before, w) & ~_any_term(after, w), F.lit(f"missing_combined_action:{a}")) for a, w in lexicon.COMBINED_ACTION_GROUPS.items()]
    searches, words = text.is_enabled(search), text.ascii_token_set(request)
    anchors = F.array_except(text.ascii_token_set(F.coalesce(search, F.lit(""))), _lits(lexicon.SEARCH_STOPWORDS))
    masked, parts = text.is_enabled(mask), F.array_except(text.ascii_token_set(F.coalesce(mask, F.lit(""))), _lits(lexicon.MASK_STOPWORDS))
    little = (F.size(parts) > 0) & (F.size(F.array_intersect(parts, words)) / F.greatest(F.lit(1), F.size(parts)) < 0.4)
    first = [
        F.when(before == after, F.lit("unchanged_from_base")),
        F.when(F.size(lost) > 0, F.concat(F.lit("missing_constraints:"), F.array_join(lost, ","))),
        F.when(action, F.concat(F.lit("missing_action:"), subtask)),
        *combined,
    ]
    rest = violations([
        ("missing_search_entity", searches & (F.size(anchors) > 0) & ~F.arrays_overlap(words, anchors)),
        ("search_category_mismatch", searches != (kind == "under_search")),
        ("over_search_category_mismatch", (kind == "over_search_negative") & searches),
        ("insufficient_source_constraints", (kind == "multiple_constraints") & (constraint_groups(source) < 2)),
        ("missing_grounding_pronoun", (kind == "pronoun_grounding") & ~_any_term(after, lexicon.GROUNDING_PHRASES)),
        ("mask_category_mismatch", (kind == "mask_granularity") & ~masked),
        ("insufficient_mask_detail", (kind == "mask_granularity") & masked & little),
        ("composition_category_mismatch", (kind == "compositional_edit") & (subtask != "combined_tasks")),
    ])
    return F.concat(F.filter(F.array(*first), lambda x: x.isNotNull()), rest)


def checklist(source: Column, kind: Column, subtask: Column, search: Column, mask: Column) -> Column:
    """What a rewriter is told to keep, one line each."""
    squashed = text.squash(source)
    line = lambda test, words: F.when(test, words)
    actions = [line((subtask == "combined_tasks") & _any_term(squashed, w), F.lit(lexicon.KEEP_ACTION.format(a))) for a, w in lexicon.COMBINED_ACTION_GROUPS.items()]
    rest = [
        line(kind == "pronoun_grounding", F.lit(lexicon.KEEP_PRONOUN)),
        line((kind == "under_search") & text.is_enabled(search), text.template(lexicon.KEEP_IDENTITY, value=search)),
        line((kind == "mask_granularity") & mask.isNotNull(), text.template(lexicon.KEEP_MASK, value=mask)),
    ]
    terms = F.transform(F.array_sort(constraint_terms(source)), lambda w: text.template(lexicon.KEEP_TERM, value=w))
    return F.concat(terms, F.filter(F.array(*actions, *rest), lambda x: x.isNotNull()))
