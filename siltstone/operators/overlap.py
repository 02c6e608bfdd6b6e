"""Pairs of rows that share runs of words in each of several texts, without a row for the pairs that only common runs make.

Runs are compared by 128 bits of hashes. A run that stands in n rows of one side and m of the other is rare if n * m is at most `rare`;
only rare runs make pairs of rows, and such a pair is kept if the rows share a run in every text. Pairs that share a common run in every text are
told by classes instead: common runs that stand in the same rows are one bundle, rows with the same bundles are one class, and
classes are paired. Both kinds together are all pairs, each once; sums over them need no row for a pair of the second kind.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import bound, tokens
from siltstone.sources.shared import fixed

#: Rows that a rare run may pair.
RARE = 10_000
#: Distinct runs of the right side up to which their hashes are broadcast (16 bytes each) to thin out the left side's.
BROADCAST_RUNS = 500_000


def run_hashes(text: Column, n: int) -> Column:
    """128-bit hashes of the runs of n words, repeats included: words are hashed once, runs from the hashes of their words."""

    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - n)
        return F.transform(at, lambda i: F.struct(F.xxhash64(*(F.get(h, i + k) for k in range(n))).alias("a"), F.xxhash64(F.lit(1), *(F.get(h, i + k) for k in range(n))).alias("b")))

    hashed = F.transform(tokens(text), lambda w: F.xxhash64(w))
    return bound(hashed, lambda h: F.when(F.size(h) < n, F.array().cast("array<struct<a:bigint,b:bigint>>")).otherwise(runs(h)))


@dataclass(frozen=True)
class Overlap:
    """links (left, right): pairs that share a rare run. left_classes and right_classes (left or right, class): rows with common runs. class_pairs (left_class, right_class)."""

    links: DataFrame
    left_classes: DataFrame
    right_classes: DataFrame
    class_pairs: DataFrame

    def partners(self) -> DataFrame:
        """left, n: with how many rows of the right side each row is paired."""
        sizes = self.right_classes.groupBy(F.col("class").alias("right_class")).agg(F.count("*").alias("_m"))
        common = self.class_pairs.join(sizes, "right_class").groupBy(F.col("left_class").alias("class")).agg(F.sum("_m").alias("n"))
        rows = self.left_classes.join(common, "class").select("left", "n").unionByName(self.links.groupBy("left").agg(F.count("*").alias("n")))
        return rows.groupBy("left").agg(F.sum("n").alias("n"))

    def summary(self) -> DataFrame:
        """pair_count, n_left, n_right: of all pairs, and of the rows that have any."""
        size = lambda side, name: side.groupBy(F.col("class").alias(f"{name}_class")).agg(F.count("*").alias(f"_{name}"))
        sized = self.class_pairs.join(size(self.left_classes, "left"), "left_class").join(size(self.right_classes, "right"), "right_class")
        pairs = sized.agg(F.coalesce(F.sum(F.col("_left") * F.col("_right")), F.lit(0)).alias("p")).join(self.links.agg(F.count("*").alias("q")))
        some = lambda side, name: side.join(self.class_pairs.select(F.col(f"{name}_class").alias("class")).distinct(), "class", "left_semi").select(name).unionByName(self.links.select(name))
        left, right = (some(side, name).agg(F.count_distinct(name).alias(f"n_{name}")) for side, name in ((self.left_classes, "left"), (self.right_classes, "right")))
        return pairs.select((F.col("p") + F.col("q")).alias("pair_count")).join(left).join(right)


def _shared_runs(left: DataFrame, right: DataFrame, text: str, n: int, rare: int) -> tuple[DataFrame, DataFrame]:
    """left, run, bundle and right, run, bundle: of the runs that stand in both sides; bundle is null for rare ones."""
    own = lambda df, side: df.select(side, F.explode(run_hashes(F.col(text), n)).alias("run"))
    held, wanted = own(left, "left"), fixed(own(right, "right").distinct(), "right-runs")
    known = wanted.select("run").distinct()
    if known.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        held = held.join(F.broadcast(known), "run", "left_semi")
    held = fixed(held.distinct(), "left-runs")
    # Rows are counted and, as a set, signed: two runs with the same signs stand in the same rows.
    signed = lambda df, side: df.groupBy("run").agg(F.count("*").alias(f"n_{side}"), F.sum(F.xxhash64(side).cast("decimal(38,0)")).alias(f"s_{side}"), F.bit_xor(F.xxhash64(F.lit(1), side)).alias(f"x_{side}"))
    both = signed(held, "left").join(signed(wanted, "right"), "run")
    common = F.col("n_left").cast("decimal(20,0)") * F.col("n_right") > rare
    bundle = F.when(common, F.xxhash64("n_left", "s_left", "x_left", "n_right", "s_right", "x_right"))
    # Written first, so that the rows of a run that very many have can be split.
    runs = fixed(both.select("run", bundle.alias("bundle")), "shared-runs")
    return fixed(held.join(runs, "run"), "left-shared"), fixed(wanted.join(runs, "run"), "right-shared")


def paired_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, texts: dict[str, int], rare: int = RARE) -> Overlap:
    """Pairs of rows that share a run in every text; texts: the columns, and how many words a run of each has. Ids are unique and not null."""
    sides = {"left": left.select(F.col(left_id).alias("left"), *texts), "right": right.select(F.col(right_id).alias("right"), *texts)}
    shared = {t: dict(zip(("left", "right"), _shared_runs(sides["left"], sides["right"], t, n, rare), strict=True)) for t, n in texts.items()}
    rows = {}
    for side in sides:
        # A row without a shared run in any of the texts is in no pair.
        sets = [shared[t][side].groupBy(side).agg(F.collect_set("run").alias(f"runs_{i}"), F.array_sort(F.collect_set("bundle")).alias(f"bundles_{i}")) for i, t in enumerate(texts)]
        rows[side] = fixed(reduce(lambda a, b: a.join(b, side), sets), f"{side}-sets")
    rare_runs = [shared[t]["left"].where("bundle is null").select("left", "run").join(shared[t]["right"].where("bundle is null").select("right", "run"), "run").select("left", "right") for t in texts]
    candidates = reduce(DataFrame.unionByName, rare_runs).distinct()
    renamed = {side: rows[side].select(side, *(F.col(c).alias(f"{side}_{c}") for c in rows[side].columns if c != side)) for side in sides}
    every = lambda kind: reduce(lambda a, b: a & b, [F.arrays_overlap(f"left_{kind}_{i}", f"right_{kind}_{i}") for i in range(len(texts))])
    links = candidates.join(renamed["left"], "left").join(renamed["right"], "right").where(every("runs") & ~every("bundles")).select("left", "right")
    kinds = [f"bundles_{i}" for i in range(len(texts))]
    classed = {side: fixed(rows[side].where(" and ".join(f"size({k}) > 0" for k in kinds)).withColumn("class", F.xxhash64(*kinds)), f"{side}-classes") for side in sides}

    def exploded(side: str) -> DataFrame:
        out = classed[side].select(F.col("class").alias(f"{side}_class"), *kinds).distinct()
        for k in kinds:
            out = out.withColumn(k, F.explode(k))
        return out

    pairs = exploded("left").join(exploded("right"), kinds).select("left_class", "right_class").distinct()
    return Overlap(fixed(links, "links"), classed["left"].select("left", "class"), classed["right"].select("right", "class"), fixed(pairs, "class-pairs"))
