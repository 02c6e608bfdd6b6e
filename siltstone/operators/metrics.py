"""Evaluation metrics as aggregates: one pass over the rows, grouping sets where overall and per-group figures are both wanted."""

from __future__ import annotations

from functools import reduce

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shared import fixed

from siltstone.functions.numbers import precision_recall_f1, ratio

LABELS = ("A", "B", "tie")


def confusion(gold: Column, predicted: Column) -> dict[str, Column]:
    """Counts of true and false positives and negatives; gold and predicted are 0 or 1."""
    pair = lambda g, p: F.count_if((gold == g) & (predicted == p))
    return {"tp": pair(1, 1), "fp": pair(0, 1), "fn": pair(1, 0), "tn": pair(0, 0)}


def binary_metrics(df: DataFrame, gold: str, predicted: str, by: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1, overall (by is null) and, if asked for, by a column.

    Rows whose by is null or empty count overall only.
    """
    counts = {k: v.alias(k) for k, v in confusion(F.col(gold), F.col(predicted)).items()}
    if by is None:
        out = df.agg(*counts.values())
    else:
        out = df.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.grouping(by).alias("_all"), *counts.values())
        out = out.where(f"_all = 1 or coalesce({by}, '') <> ''").drop("_all")
    return out.withColumns(precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def agreement(df: DataFrame, a: str, b: str, labels: tuple[str, ...] = LABELS, by: str | None = None) -> DataFrame:
    """Usable rows, exact and directional agreement, tie rates and Cohen's kappa of two label columns.

    One row, or with `by` one overall (by is null) and one for each of its values; rows without a value count as unknown.

    Rows in which either label is not one of labels are counted as excluded. Directional agreement leaves ties out.
    Kappa is 1 if chance alone would agree always, and null without rows.
    """
    ok = F.coalesce(F.col(a).isin(*labels) & F.col(b).isin(*labels), F.lit(False))
    same, x, y = F.col(a) == F.col(b), F.col(a), F.col(b)
    both = ok & (x != "tie") & (y != "tie")
    sums = [F.count("*").alias("rows"), F.count_if(ok).alias("usable"), F.count_if(ok & same).alias("agreed"), F.count_if(both).alias("directed"), F.count_if(both & same).alias("directed_agreed")]
    for k, one in enumerate(labels):
        sums += [F.count_if(ok & (x == one)).alias(f"a{k}"), F.count_if(ok & (y == one)).alias(f"b{k}")]
    if by is None:
        s, keys = df.agg(*sums), []
    else:
        s, keys = df.withColumn(by, F.coalesce(by, F.lit("unknown"))).groupingSets([[], [F.col(by)]], F.col(by)).agg(*sums), [by]
    n = F.col("usable")
    chance = sum((F.col(f"a{k}") * F.col(f"b{k}") for k in range(len(labels))), F.lit(0).cast("long"))
    n2 = n * n
    kappa = F.when(n == 0, F.lit(None).cast("double")).when(chance == n2, F.lit(1.0)).otherwise((n * F.col("agreed") - chance).cast("double") / (n2 - chance))
    tie = labels.index("tie") if "tie" in labels else None
    ties = [ratio(F.col(f"{c}{tie}"), n).alias(f"{c}_tie_rate") for c in "ab"] if tie is not None else []
    return s.select(
        *keys, "rows", "usable", (F.col("rows") - n).alias("excluded"), ratio(n, F.col("rows")).alias("coverage"),
        ratio(F.col("agreed"), n, None).alias("exact"), ratio(F.col("directed_agreed"), F.col("directed"), None).alias("directional"), *ties, kappa.alias("kappa"),
    )


def confusion_table(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """a, b, n for every pair of labels, zeros too."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(x, y) for x in labels for y in labels], f"{a} string, {b} string")
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return spine.join(counts, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rollup_means(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Number of rows and means of the values, overall, by each group and by all groups; nulls are left out of means."""
    sets = [[], *([F.col(g)] for g in groups), [F.col(g) for g in groups]]
    level = F.grouping_id(*groups).alias("level")
    return df.groupingSets(sets, *groups).agg(level, F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def audit(df: DataFrame, position: str, total: int, by: list[str], overall: bool = False) -> DataFrame:
    """How well sampled positions cover 0 to total - 1: rows, distinct positions, coverage, range and quarters."""
    quarter = F.least(F.lit(4), F.floor(F.col(position) * 4 / total) + 1)
    quarters = [F.count_if(quarter == k).alias(f"q{k}") for k in (1, 2, 3, 4)]
    grouped = df.groupingSets([[], [F.col(c) for c in by]], *by) if overall else df.groupBy(*by)
    return grouped.agg(
        F.count("*").alias("n"), F.count_distinct(position).alias("n_distinct"), (F.count_distinct(position) / F.lit(float(total))).alias("coverage"),
        F.min(position).alias("low"), F.max(position).alias("high"), *quarters,
    )


def examples(df: DataFrame, reason: str, order: str, key: str, most: int) -> DataFrame:
    """Rows a reason, and the first few keys in order: a top-k report."""
    ranked = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order, key))), 1, most), lambda x: x[key])
    # The list is built from rows that a window has cut to the first few already.
    from siltstone.operators.ranking import quota

    head = quota(df, [reason], [order, key], most).groupBy(reason).agg(ranked.alias("examples"))
    return df.groupBy(reason).agg(F.count("*").alias("n")).join(head, reason)


def compared_sides(pairs: DataFrame, methods: dict[str, list[str]], a: str, b: str) -> DataFrame:
    """pairs with method, a_score, b_score and label for each method: the mean of its dimensions (fields of the structs a and b) on either side, and which side has more."""
    mean = lambda side, dims: reduce(lambda x, y: x + y, [F.col(f"{side}.{d}").cast("double") for d in dims]) / len(dims)
    rows = F.array(*(F.struct(F.lit(m).alias("method"), mean(a, dims).alias("a_score"), mean(b, dims).alias("b_score")) for m, dims in methods.items()))
    each = pairs.select("*", F.inline(rows))
    return each.withColumn("label", F.when(F.col("a_score") > F.col("b_score"), "A").when(F.col("a_score") < F.col("b_score"), "B").otherwise("tie"))


def best_marked(table: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """table with best_<column>: whether a row has the column's best value, the highest (true) or the lowest (false); null is never best."""
    best = fixed(table, "scores").agg(*((F.max(c) if high else F.min(c)).alias(f"_best_{c}") for c, high in columns.items()))
    marked = table.join(F.broadcast(best))  # one row
    return marked.select(*table.columns, *(F.coalesce(F.col(c) == F.col(f"_best_{c}"), F.lit(False)).alias(f"best_{c}") for c in columns))


def means_by_type(rows: DataFrame, kind: str, value: str, every: str = "global") -> DataFrame:
    """kind, n, total, mean of each kind and, as `every`, of all rows; without rows the count of all is 0 and there is no mean."""
    sums = rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    whole = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total")).select(F.lit(every).alias("kind"), "n", "total")
    return sums.unionByName(whole).withColumn("mean", F.try_divide(F.col("total").cast("double"), F.col("n")))


def gates(metrics: DataFrame, thresholds: list[tuple[str, str, float]]) -> DataFrame:
    """name, value, operator, bound, passed for each threshold (name, one of >= <= == > <, bound); no value fails."""
    spark = metrics.sparkSession
    table = spark.createDataFrame(thresholds, "name string, operator string, bound double")
    v, b, op = F.col("value"), F.col("bound"), F.col("operator")
    passed = F.when(op == ">=", v >= b).when(op == "<=", v <= b).when(op == "==", v == b).when(op == ">", v > b).when(op == "<", v < b)
    return table.join(metrics.select("name", "value"), "name", "left").withColumn("passed", F.coalesce(passed, F.lit(False)))


def one_standard_error(candidates: DataFrame, utility: str, size: str, error: float | Column) -> DataFrame:
    """The candidate of smallest size whose utility is within one standard error of the best; ties go to the smaller size."""
    error = error if isinstance(error, Column) else F.lit(float(error))
    best = candidates.agg(F.max_by(F.struct(utility, size), F.struct(F.col(utility), -F.col(size))).alias("b")).select(F.col("b")[utility].alias("_best"))
    near = candidates.join(F.broadcast(best), F.col(utility) >= F.col("_best") - error)
    return near.orderBy(size).limit(1).drop("_best")


class RandrangeStream:
    """What randrange(size) of one random.Random(seed) gives, call after call, in numpy. skip: generator words used before."""

    def __init__(self, seed: int, skip: int = 0):
        *key, pos = random.Random(seed).getstate()[1]
        self.words = np.random.MT19937()
        self.words.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": pos}}
        self.words.random_raw(skip, output=False)
        self.used, self.left = skip, np.zeros(0, np.uint64)

    def take(self, n: int, size: int) -> np.ndarray:
        bits, out = size.bit_length(), []
        if bits > 32:
            raise ValueError("a stratum of 2**32 cases or more")
        while n:
            if not len(self.left):
                self.left = self.words.random_raw(2 * n + 64)
            # Python draws `bits` bits, the high ones of a word, until they are below size.
            values = self.left[: 2 * n + 64] >> np.uint64(32 - bits)
            ok = np.flatnonzero(values < size)[:n]
            out.append(values[ok].astype(np.int64))
            n -= len(ok)
            end = len(values) if n else int(ok[-1]) + 1
            self.used += end
            self.left = self.left[end:]
        return np.concatenate(out) if out else np.zeros(0, np.int64)


#: Scores (cases times candidates) up to which every task of a bootstrap over one stream holds them: 16 bytes each.
STREAM_SCORES = 4_000_000


def _stream_draws(scores: DataFrame, sizes: dict[str, int], draws: int, seed: int, blocks: int = 64) -> DataFrame:
    """candidate, draw, m: means of the strata's means, with the indices of one random.Random(seed) in draw order."""
    spark = scores.sparkSession
    cases = scores.groupBy("candidate", "stratum", "case_pos").agg(F.sum(F.col("score").cast("double")).alias("s"), F.count("score").alias("n"))
    strata = sorted(sizes)
    # The driver walks through the stream once and keeps where each block of draws begins in it.
    step, walk, begins = max(1, -(-draws // blocks)), RandrangeStream(seed), []
    for d in range(draws):
        if d % step == 0:
            begins.append((d, min(step, draws - d), walk.used))
        for s in strata:
            walk.take(sizes[s], sizes[s])
    table = spark.createDataFrame(begins, "first long, n long, skip long").repartition(len(begins))
    names = [r["candidate"] for r in scores.select("candidate").distinct().collect()]
    if sum(sizes.values()) * len(names) > STREAM_SCORES:
        def drawn(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    stream = RandrangeStream(seed, row["skip"])
                    for d in range(row["first"], row["first"] + row["n"]):
                        for s in strata:
                            at = stream.take(sizes[s], sizes[s])
                            yield pa.RecordBatch.from_pydict({"draw": np.full(len(at), d), "stratum": [s] * len(at), "case_pos": at})

        index = table.mapInArrow(drawn, "draw long, stratum string, case_pos long")
        means = index.join(cases, ["stratum", "case_pos"]).groupBy("candidate", "draw", "stratum").agg((F.sum("s") / F.sum("n")).alias("m"))
        return means.groupBy("candidate", "draw").agg(F.avg("m").alias("m"))
    order = {c: k for k, c in enumerate(names)}
    held = {s: np.zeros((2, len(names), n)) for s, n in sizes.items()}
    for r in cases.toLocalIterator():
        if 0 <= r["case_pos"] < sizes[r["stratum"]]:
            held[r["stratum"]][:, order[r["candidate"]], r["case_pos"]] = r["s"] or 0.0, r["n"]
    shared = spark.sparkContext.broadcast(held)

    def averaged(batches):
        for batch in batches:
            for row in batch.to_pylist():
                stream = RandrangeStream(seed, row["skip"])
                for d in range(row["first"], row["first"] + row["n"]):
                    times = {s: np.bincount(stream.take(sizes[s], sizes[s]), minlength=sizes[s]) for s in strata}
                    sums = np.stack([shared.value[s] @ times[s] for s in strata])
                    means = [[x / n for x, n in zip(a, b, strict=True) if n] for a, b in zip(sums[:, 0].T.tolist(), sums[:, 1].T.tolist(), strict=True)]
                    m = [sum(x) / len(x) if x else None for x in means]
                    yield pa.RecordBatch.from_pydict({"candidate": pa.array(names, pa.string()), "draw": np.full(len(names), d), "m": pa.array(m, pa.float64())})

    return table.mapInArrow(averaged, "candidate string, draw long, m double")


def four_way(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs, exact agreement over all labels, and precision, recall and F1 of calling a pair invalid (null where there is nothing to divide by)."""
    x, y = F.col(a), F.col(b)
    hit, said, true = F.count_if((x == "invalid") & (y == "invalid")), F.count_if(y == "invalid"), F.count_if(x == "invalid")
    s = df.agg(F.count("*").alias("num_pairs"), F.count_if(x == y).alias("_same"), hit.alias("_hit"), said.alias("_said"), true.alias("_true"))
    precision, recall = ratio(F.col("_hit"), F.col("_said"), None), ratio(F.col("_hit"), F.col("_true"), None)
    f1 = F.when((recall > 0) & precision.isNotNull(), 2 * precision * recall / (precision + recall))
    return s.select("num_pairs", ratio(F.col("_same"), F.col("num_pairs"), None).alias("four_way_agreement"), precision.alias("invalid_precision"), recall.alias("invalid_recall"), f1.alias("invalid_f1"))


def valid_score_means(df: DataFrame, score: str, kind: str, low: float = 1, high: float = 5) -> DataFrame:
    """n and mean of the scores between low and high, overall (kind null) and by kind."""
    return df.where(F.col(score).between(low, high)).groupingSets([[], [F.col(kind)]], F.col(kind)).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))


def unequal_groups(df: DataFrame, keys: list[str], want: int | Column) -> DataFrame:
    """Groups whose number of rows is not the wanted one: a balanced table has none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != want)


def paired_bootstrap(scores: DataFrame, draws: int, seed: int) -> DataFrame:
    """candidate, standard error of the mean of its strata's means over paired stratified draws.

    scores: candidate, stratum, case_pos, score. The indices are those of one random.Random(seed): draw by draw, strata in
    order, one randrange a case; every candidate gets the same ones.
    """
    sizes = {r["stratum"]: r["n"] for r in scores.groupBy("stratum").agg(F.count_distinct("case_pos").alias("n")).collect()}
    if not sizes:
        return scores.sparkSession.createDataFrame([], "candidate string, standard_error double")
    return _stream_draws(scores, sizes, draws, seed).groupBy("candidate").agg(F.stddev_samp("m").alias("standard_error"))
