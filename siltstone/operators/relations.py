"""Joins, set operations and validators. Validators return violations (rule, key, message) instead of raising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import ngrams, padded, tokens


#: Distinct runs of the right side up to which their hashes are broadcast (8 bytes each) to thin out the left side's.
BROADCAST_RUNS = 500_000


def shared_ngrams(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, n: int) -> DataFrame:
    """left_id, right_id, n_shared: pairs of texts that share runs of n words. An equi-join on the runs, never a cross join.

    Most runs of the left side are in no text of the right one: they go by their hashes before anything is shuffled.
    """
    run = lambda df, key: df.select(key, F.explode(ngrams(tokens(F.col(text)), n)).alias("_run"))
    wanted, held = run(right, right_id), run(left, left_id)
    hashes = wanted.select(F.xxhash64("_run").alias("_hash")).distinct()
    if hashes.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        held = held.join(F.broadcast(hashes), F.xxhash64("_run") == F.col("_hash"), "left_semi")
    return held.join(wanted, "_run").groupBy(left_id, right_id).agg(F.count("*").alias("n_shared"))


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str, normal: str, phrase: str, most_words: int = 8) -> DataFrame:
    """key, phrase: normalised texts that contain a normalised phrase. An equi-join on runs of words of the phrase's length.

    A phrase of more than most_words words is found by its first so many, and then checked whole.
    """
    words = F.split(F.col(normal), " ")
    wanted = phrases.select(phrase).where(F.col(phrase) != "").distinct().withColumn("_n", F.least(F.size(F.split(phrase, " ")), F.lit(most_words)))
    wanted = wanted.withColumn("_head", F.array_join(F.slice(F.split(phrase, " "), 1, F.col("_n")), " "))
    sizes = sorted(r["_n"] for r in wanted.select("_n").distinct().collect())
    if not sizes:
        return texts.select(key, F.lit(None).cast("string").alias(phrase)).where("false")
    runs = reduce(DataFrame.unionByName, [texts.select(key, normal, F.explode(ngrams(words, n)).alias("_head")) for n in sizes])
    found = runs.join(wanted.drop("_n"), "_head").where(padded(F.col(normal)).contains(padded(F.col(phrase))))
    return found.select(key, phrase).distinct()


def value_overlap(values: DataFrame, texts: DataFrame, keys: list[str], value: str, text: str, n: int) -> DataFrame:
    """keys, n_shared: values that have runs of n words in common with any of the texts, and how many different ones."""
    known = texts.select(F.explode(ngrams(tokens(F.col(text)), n)).alias("_run"))
    own = values.select(*keys, F.explode(ngrams(tokens(F.col(value)), n)).alias("_run")).distinct()
    hashes = own.select(F.xxhash64("_run").alias("_hash")).distinct()
    if hashes.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        known = known.join(F.broadcast(hashes), F.xxhash64("_run") == F.col("_hash"), "left_semi").drop("_hash")
    return own.join(known.distinct(), "_run", "left_semi").groupBy(*keys).agg(F.count("*").alias("n_shared"))


def overridden(base: DataFrame, extra: DataFrame, key: str, position: str) -> DataFrame:
    """base with the columns of extra by key, in base's order, and status: joined, missing (no partner in extra) or unknown (in extra alone, without a position)."""
    rest = [c for c in extra.columns if c != key]
    both = base.withColumn("_b", F.lit(True)).join(extra.withColumn("_x", F.lit(True)), key, "full")
    status = F.when(F.col("_b").isNull(), "unknown").when(F.col("_x").isNull(), "missing").otherwise("joined")
    return both.select(key, position, *[c for c in base.columns if c not in (key, position)], *rest, status.alias("status"))


def zipped(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Rows of equal positions, with whole: whether both sides have the position. Tables of unequal lengths show in rows that are not whole."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), position, "full")
    return both.withColumn("whole", F.col("_l").isNotNull() & F.col("_r").isNotNull()).drop("_l", "_r")


def missing_partners(rows: DataFrame, partners: DataFrame, key: str, message: str) -> DataFrame:
    """key, violation: rows without a partner."""
    return rows.join(partners, key, "left_anti").select(key, F.lit(message).alias("violation"))


def with_records(cases: DataFrame, records: DataFrame, key: str, required: Column) -> DataFrame:
    """cases with their records; a case that requires one goes without it, another keeps nulls."""
    joined = cases.join(records.withColumn("_have", F.lit(True)), key, "left")
    return joined.where(F.col("_have").isNotNull() | ~required).drop("_have")


def product(tables: list[DataFrame], most: int = 10_000_000) -> DataFrame:
    """Every combination of rows of small tables; an error if there would be more than `most`. All tables but the largest are broadcast."""
    sizes = [x.count() for x in tables]
    total = reduce(lambda a, b: a * b, sizes, 1)
    if total > most:
        raise ValueError(f"{total} combinations, at most {most} are made")
    first = max(range(len(tables)), key=lambda i: sizes[i])
    return reduce(lambda a, b: a.join(F.broadcast(b)), [tables[i] for i in range(len(tables)) if i != first], tables[first])


def not_exactly_one(rows: DataFrame, places: list[DataFrame], key: str) -> DataFrame:
    """key, n: rows that lie in none or in several of the places."""
    held = reduce(DataFrame.unionByName, [p.select(key).distinct() for p in places]).groupBy(key).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return rows.select(key).join(held, key, "left").select(key, n.alias("n")).where("n <> 1")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and the side that alone has it."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("only_in", F.lit("right")))


def resume(todo: DataFrame, done: DataFrame, key: str, accepted: Column | None = None) -> DataFrame:
    """What is still to do; only accepted rows count as done, so rejected ones are tried again."""
    return todo.join(done.where(accepted) if accepted is not None else done, key, "left_anti")


def resume_by_identity(todo: DataFrame, done: DataFrame, key: str, identity: list[str], position: str, payload: str) -> DataFrame:
    """todo with the payload of earlier results, the last by position of those that count.

    A result with a key counts if the row of that key still has its identity; one without a key if exactly one row of todo has it.
    """
    rows = todo.select(key, *(F.col(c).alias(f"_{c}") for c in identity))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity])
    by_key = done.where(F.col(key).isNotNull()).join(rows, key).where(same)
    once = todo.groupBy(*identity).agg(F.count("*").alias("_n"), F.min(key).alias(key)).where("_n = 1")
    by_identity = done.where(F.col(key).isNull()).drop(key).join(once, identity)
    found = by_key.select(key, position, payload).unionByName(by_identity.select(key, position, payload))
    return todo.join(found.groupBy(key).agg(F.max_by(payload, position).alias(payload)), key, "left").select(*todo.columns, payload)


def disagreements(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column: cells that differ between two tables; null differs from everything but null."""
    left, right = a.select(key, *columns), b.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    found = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return left.join(right, key).select(key, F.explode(found).alias("column"))


def exclude_rules(spec: str) -> list[dict[str, str]]:
    """Parse k=v,k=v;k=v: and within a rule, or between rules."""
    rules = []
    for part in filter(None, (p.strip() for p in spec.split(";"))):
        pairs = [x.partition("=") for x in part.split(",") if x.strip()]
        if any(not e or not k.strip() for k, e, _ in pairs):
            raise ValueError(f"bad rule: {part}")
        rules.append({k.strip(): v.strip() for k, _, v in pairs})
    return rules


def matching_rule(df: DataFrame, spec: str) -> Column:
    """Number of the first rule that a row matches, or null. A missing column matches nothing; arrays match by membership."""
    kinds = dict(df.dtypes)

    def one(name: str, value: str) -> Column:
        if name not in kinds:
            return F.lit(False)
        if kinds[name].startswith("array"):
            return F.coalesce(F.array_contains(F.col(name), value), F.lit(False))
        return F.coalesce(F.col(name).cast("string") == value, F.lit(False))

    tests = [reduce(lambda a, b: a & b, [one(k, v) for k, v in rule.items()], F.lit(True)) for rule in exclude_rules(spec)]
    return F.coalesce(*(F.when(t, F.lit(i)) for i, t in enumerate(tests))) if tests else F.lit(None).cast("int")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The code of the first rule that holds, in order; null if none does."""
    return F.coalesce(*(F.when(test, F.lit(code)) for code, test in rules))


def violations(rules: list[tuple[str, Column]]) -> Column:
    """The codes of all rules that hold, in order."""
    return F.filter(F.array(*(F.when(test, F.lit(code)) for code, test in rules)), lambda x: x.isNotNull())


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def forbidden_phrases(text: Column, phrases: list[str]) -> Column:
    """Does the normalised text hold any of a short list of normalised phrases?"""
    tests = [padded(text).contains(f" {p} ") for p in phrases if p]
    return reduce(lambda a, b: a | b, tests, F.lit(False))
