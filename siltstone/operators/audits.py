"""Audits: each gives violations (rule, key, message) instead of raising, so the audits of a bundle can be put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def together(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def _found(df: DataFrame, rule: str, key: Column, message: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), message.cast("string").alias("message"))


def failing(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows that break a rule, once for each; a rule is a name and a test that must hold (null does not)."""
    codes = F.filter(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules)), lambda x: x.isNotNull())
    broken = df.select(F.col(key).alias("_k"), F.explode(codes).alias("_rule"))
    return broken.select(F.col("_rule").alias("rule"), F.col("_k").cast("string").alias("key"), F.lit("broken").alias("message"))


def not_as_expected(observed: DataFrame, expected: DataFrame, rule: str) -> DataFrame:
    """Both: key, value (texts). Keys that are missing, not wanted or have another value."""
    a, b = expected.select("key", F.col("value").alias("want")), observed.select("key", F.col("value").alias("have"), F.lit(True).alias("_have"))
    both = a.withColumn("_want", F.lit(True)).join(b, "key", "full")
    message = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "not expected").when(~F.col("want").eqNullSafe(F.col("have")), F.concat(F.lit("is "), F.coalesce("have", F.lit("null")), F.lit(", expected "), F.coalesce("want", F.lit("null"))))
    return _found(both.withColumn("_m", message).where("_m is not null"), rule, F.col("key"), F.col("_m"))


def media_faults(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """wanted: path, least (bytes) and sha256 (null: any); found: path, length, sha256. Files that are missing, too_small or changed, the first that holds."""
    have = found.select("path", "length", F.col("sha256").alias("_sha"))
    rule = F.when(F.col("length").isNull(), "missing").when(F.col("length") < F.col("least"), "too_small").when(F.col("_sha") != F.col("sha256"), "changed")
    told = F.concat(F.lit("has "), F.coalesce(F.col("length").cast("string"), F.lit("no")), F.lit(" bytes"))
    both = wanted.join(have, "path", "left").withColumn("rule", rule).where("rule is not null")
    return both.select("rule", F.col("path").alias("key"), told.alias("message"))


def not_unique(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """not_unique:<name>, key, how often: values of each named column that stand in several rows; null counts as a value."""
    parts = [df.groupBy(c.cast("string").alias("k")).agg(F.count("*").alias("n")).where("n > 1").withColumn("rule", F.lit(f"not_unique:{name}")) for name, c in columns.items()]
    return _found_of(reduce(DataFrame.unionByName, parts))


def _found_of(rows: DataFrame) -> DataFrame:
    return rows.select("rule", F.col("k").alias("key"), F.concat(F.lit("stands "), F.col("n").cast("string"), F.lit(" times")).alias("message"))


def off_distribution(df: DataFrame, column: Column, expected: dict[str, int], rule: str, where: Column | None = None) -> DataFrame:
    """Groups, of the rows that count, whose numbers are not the expected ones."""
    rows = df.where(where) if where is not None else df
    have = rows.groupBy(column.cast("string").alias("key")).agg(F.count("*").cast("string").alias("value"))
    want = df.sparkSession.createDataFrame([(k, str(n)) for k, n in expected.items()], "key string, value string")
    return not_as_expected(have, want, rule)


def not_recomputed(reported: DataFrame, computed: DataFrame, rule: str, tolerance: float = 1e-15) -> DataFrame:
    """Both: key, value (numbers). Figures of a report that the raw rows do not give, within a tolerance."""
    both = reported.select("key", F.col("value").alias("said")).join(computed.select("key", F.col("value").alias("real")), "key", "full")
    off = F.coalesce(F.abs(F.col("said") - F.col("real")) > tolerance, ~F.col("said").eqNullSafe(F.col("real")))
    return _found(both.where(off), rule, F.col("key"), F.concat_ws(" / ", F.coalesce(F.col("said").cast("string"), F.lit("none")), F.coalesce(F.col("real").cast("string"), F.lit("none"))))


def changed_between(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """Inputs whose digest was another one before the run than after it, or that came or went."""
    both = before.select(key, F.col(digest).alias("_a")).join(after.select(key, F.col(digest).alias("_b")), key, "full")
    return _found(both.where(~F.col("_a").eqNullSafe(F.col("_b"))), "changed_during_run", F.col(key), F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").otherwise("changed"))


def repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that stand more than once in columns that must be unique."""
    return together(*(_found(df.groupBy(c).agg(F.count("*").alias("_n")).where("_n > 1"), f"{c}_not_unique", F.col(c), F.col("_n")) for c in columns))


def wrong_counts(df: DataFrame, by: str, expected: dict[str, int], rule: str) -> DataFrame:
    """Groups whose number of rows is not the expected one; others must not be there."""
    table = df.sparkSession.createDataFrame(list(expected.items()), f"{by} string, _want long")
    have = df.groupBy(by).agg(F.count("*").alias("_n"))
    both = table.join(have, by, "full").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return _found(both.where(F.col("_want").isNull() | (F.col("_n") != F.col("_want"))), rule, F.col(by), F.concat(F.col("_n").cast("string"), F.lit(" of "), F.coalesce(F.col("_want").cast("string"), F.lit("0"))))


def case_gold_contract(cases: DataFrame, gold: DataFrame, key: str, order: str, shared: list[str], category: str, search: Column, searching: list[str]) -> DataFrame:
    """Cases and their gold rows: the same ids at the same places, equal shared fields, unique ids, and search in exactly the searching categories."""
    a, b = cases.select(key, F.col(order).alias("_at"), *shared, category), gold.select(key, F.col(order).alias("_gold_at"), *(F.col(c).alias(f"_{c}") for c in shared), search.alias("_search"))
    both = a.join(b, key, "full")
    rules = [("in_both", F.col("_at").isNotNull() & F.col("_gold_at").isNotNull()), ("order", F.col("_at") == F.col("_gold_at")), *((f"shared_{c}", F.col(c).eqNullSafe(F.col(f"_{c}"))) for c in shared), ("search_by_category", F.col(category).isin(*searching) == F.col("_search"))]
    return together(failing(both, key, rules), repeated(cases, [key]), repeated(gold, [key]).withColumn("rule", F.concat(F.lit("gold_"), "rule")))


def run_manifest(entries: DataFrame, files: DataFrame, kinds: tuple[str, ...] = ("input", "output")) -> DataFrame:
    """entries (kind, path, sha256, flag, value) of a run against the files that are there (path, sha256), and its command's flags.

    Every input and output must exist with its digest, its digest must be 64 hexadecimal digits, and a flag must be given once.
    """
    bound = entries.where(F.col("kind").isin(*kinds)).join(files.select("path", F.col("sha256").alias("_real")), "path", "left")
    rules = [("digest_form", F.col("sha256").rlike("^[0-9a-f]{64}$")), ("file_there", F.col("_real").isNotNull()), ("digest", F.col("_real").isNull() | (F.col("_real") == F.col("sha256")))]
    flags = entries.where("kind = 'flag'").groupBy("flag").agg(F.count("*").alias("_n"), F.count("value").alias("_v"))
    return together(failing(bound, "path", rules), failing(flags, "flag", [("flag_once", F.col("_n") == 1), ("flag_value", F.col("_v") == F.col("_n"))]))


def declared_once(lines: DataFrame, prefixes: list[str], line: str = "value") -> DataFrame:
    """Prefixes with which not exactly one line of a log begins."""
    counts = lines.agg(*(F.count_if(F.col(line).startswith(p)).alias(f"_{i}") for i, p in enumerate(prefixes)))
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("_p"), F.col(f"_{i}").alias("_n")) for i, p in enumerate(prefixes))))
    return _found(counts.select(pairs.alias("x")).select("x.*").where("_n <> 1"), "declared_once", F.col("_p"), F.col("_n"))


def flag_value(tokens: Column, flag: str) -> Column:
    """The token after a flag that a command names exactly once; null otherwise."""
    at = F.array_position(tokens, flag)
    once = F.size(F.filter(tokens, lambda x: x == flag)) == 1
    return F.when(once & (at < F.size(tokens)), F.get(tokens, at.cast("int")))


def bundle_profile(files: DataFrame, required: list[str], train: DataFrame, held: DataFrame, group: str) -> DataFrame:
    """Files that a bundle lacks, and groups that stand in both splits."""
    spark = files.sparkSession
    wanted = spark.createDataFrame([(p,) for p in required], "path string")
    lacking = _found(wanted.join(files.select("path"), "path", "left_anti"), "required_file", F.col("path"), F.lit("missing"))
    both = train.select(group).distinct().join(held.select(group).distinct(), group, "left_semi")
    return together(lacking, _found(both, "split_overlap", F.col(group), F.lit("in both")))
