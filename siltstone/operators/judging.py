"""Scores that models write as text, and their roll-up by frame, case, axis and kind of edit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import lexicon
from siltstone.functions.exact import py_round
from siltstone.functions.text import numbers_after_colons

AXES = tuple(lexicon.RUBRIC_AXES)


#: What can stand before a label on its line (quote and list marks, numbers, emphasis), and between a colon and a score.
_BEFORE_LABEL, _BEFORE_SCORE = " \t\r\f\v>-*#.0123456789", " \t\r\f\v\n[(`*"
_DIGITS = "0123456789"


def _answers(said: Column, label: str) -> Column:
    """What follows a colon, plain or full-width, on lines that begin with the label as a whole word, in the order of the text.

    Marks are stripped from the front. After a colon that ends its line the next lines are read.
    """
    lines = F.split(F.translate(said, "：", ":"), "\n")

    def of_line(line: Column, i: Column) -> Column:
        bare = F.ltrim(line, F.lit(_BEFORE_LABEL))
        named = F.lower(bare).startswith(label.lower()) & ~F.substring(bare, len(label) + 1, 1).rlike(r"\w")
        parts = F.split(line, ":")
        follow = F.array_join(F.slice(lines, i + 2, F.size(lines)), "\n")
        after = F.transform(parts, lambda p, k: F.ltrim(F.when((k == F.size(parts) - 1) & (F.ltrim(p, F.lit(_BEFORE_SCORE)) == ""), follow).otherwise(p), F.lit(_BEFORE_SCORE)))
        return F.when(named & (F.size(parts) > 1), F.slice(after, 2, F.size(parts))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(lines, of_line))


def _first_number(answers: Column, most_digits: int, more: Column | None = None, not_before: str = "") -> Column:
    """The number of at most so many digits, alone or before anything but a letter, digit or one of not_before, that comes first; or null."""

    def number(x: Column) -> Column:
        n = F.length(x) - F.length(F.ltrim(x, F.lit(_DIGITS)))
        value = F.left(x, n)
        follow = F.substr(x, n + 1, F.lit(1))
        fits = (n >= 1) & (n <= most_digits) & ~follow.rlike(rf"[\w{not_before}]")
        return F.when(fits, value.try_cast("int"))

    return F.get(F.filter(F.transform(answers, number), lambda v: v.isNotNull() & (v <= more if more is not None else F.lit(True))), F.lit(0))


def axis_score(said: Column, label: str) -> Column:
    """The 0 to 3 that a line which begins with the label gives after a colon, or null. A range such as 2-3 is none."""
    return _first_number(_answers(said, label), 1, F.lit(3), "-")


def axis_scores(said: Column) -> dict[str, Column]:
    """All axes of the frame rubric and total: what the text says in total, or the sum if every axis has a score."""
    scores = {k: axis_score(said, label) for k, label in lexicon.RUBRIC_AXES.items()}
    told = _first_number(_answers(said, "Total"), 2)
    return scores | {"total": F.coalesce(told, reduce(lambda a, b: a + b, scores.values()))}


def mean_after_colons(said: Column) -> Column:
    """The mean of all numbers that follow a colon, rounded to two places; null without any."""
    return py_round(F.aggregate(numbers_after_colons(said), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"])), 2)


def is_relevant(axis: str, kind: Column) -> Column:
    """Does the axis mean anything for this kind of edit? Edits without a named entity have no entity axes."""
    return ~kind.isin(*lexicon.EDITS_WITHOUT_ENTITY) if axis in lexicon.ENTITY_AXES else F.lit(True)


def total_max(kind: Column) -> Column:
    return F.when(kind.isin(*lexicon.EDITS_WITHOUT_ENTITY), 3 * (len(AXES) - len(lexicon.ENTITY_AXES))).otherwise(3 * len(AXES))


def rubric_cases(frames: DataFrame, case: str, kind: str) -> DataFrame:
    """case, kind, total_max, average, fair_fraction, fair_total and a mean for each axis: of the frames of a case.

    A frame's total counts only if all relevant axes have a score; an axis that is not relevant has no mean. Figures
    are rounded to four places where the next step reads them.
    """
    k = F.col(kind)
    parts = [F.when(is_relevant(a, k), F.col(a)).otherwise(0) for a in AXES]
    frames = frames.withColumn("_total", reduce(lambda a, b: a + b, parts))
    means = frames.groupBy(case, kind).agg(F.avg("_total").alias("_mean"), *(F.avg(F.when(is_relevant(a, k), F.col(a))).alias(a) for a in AXES))
    out = means.withColumn("total_max", total_max(k)).withColumn("fair_fraction", py_round(F.col("_mean") / F.col("total_max"), 4))
    return out.select(case, kind, "total_max", py_round(F.col("_mean"), 4).alias("average"), "fair_fraction", py_round(F.col("fair_fraction") * 21, 4).alias("fair_total"), *(py_round(F.col(a), 4).alias(a) for a in AXES))


def rubric_summary(cases: DataFrame, kind: str) -> DataFrame:
    """kind (null: all), n, means of the cases' figures and, for each axis, its mean and number of cases. Cases without an average are left out."""
    axes = [x for a in AXES for x in (F.avg(a).alias(a), F.count(a).alias(f"n_{a}"))]
    return cases.where("average is not null").groupingSets([[], [F.col(kind)]], F.col(kind)).agg(F.count("*").alias("n"), F.avg("average").alias("average"), F.avg("fair_fraction").alias("fair_fraction"), *axes)
