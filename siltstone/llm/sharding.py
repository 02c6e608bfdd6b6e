"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The blocks are the partitions in which the rows lie (neighbouring ones together, if there are more than `MAX_BLOCKS`). How
many rows of each block go to each shard is drawn from the law that a uniform permutation of all rows would give: row by
row of the matrix, a multivariate hypergeometric draw from what the shards still need. Within its block a row's place in
a random order decides its shard; after the exchange the rows of a shard are put into random order again. Shard sizes
are exact (at most one apart) and every assignment is equally likely.

All rows move by DataFrame functions. Only the sizes of blocks, MAX_BLOCKS at most, reach the driver, and the matrix goes
back as a table of that many rows. Random orders come from seeded hashes, so a task that is run again makes the same rows.
"""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.storage import written

SHARDS = 16
MAX_BLOCKS = 16_384
#: Rows of a part of a shard, on average; parts are put in order separately, so a shard is never in one task.
PART_ROWS = 50_000
#: Numbers of the matrix up to which it is broadcast (8 bytes each); a larger one is joined by a shuffle.
BROADCAST_NUMBERS = 1 << 20


def _stirling_rest(n: int) -> float:
    """ln n! without Stirling's formula: what (n + 1/2) ln n - n + ln(2 pi) / 2 leaves."""
    if n <= 15:
        return math.log(math.factorial(n)) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    s = 1 / (n * n)
    return (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s / 1680))) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without cancellation where the two are close."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        if total + term / k == total:
            return total
        total += term / k


def _binomial(x: int, n: int, p: float) -> float:
    """The probability of x hits in n tries, by the saddle point: no differences of large logarithms."""
    if x in (0, n):
        return math.exp(n * (math.log1p(-p) if x == 0 else math.log(p))) if n else 1.0
    log = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return math.exp(log) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def hypergeometric_probability(k: int, good: int, bad: int, n: int) -> float:
    """The probability that k of n draws without replacement are good, to about 14 digits at any size: three binomial ones."""
    p = n / (good + bad)
    if p == 1:
        return float(k == good)
    return _binomial(k, good, p) * _binomial(n - k, bad, p) / _binomial(n, good + bad, p)


def hypergeometric(rnd: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement from good + bad are good: inversion, outwards from the mode."""
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    p = hypergeometric_probability(mode, good, bad, n)
    u = rnd.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of each block that go to each shard; row sums are block sizes, column sums are shard sizes."""
    rnd, left, out = random.Random(seed), list(shard_sizes), []
    for n in block_sizes:
        row, rest = [], sum(left)
        for k, size in enumerate(left):
            rest -= size
            x = hypergeometric(rnd, size, rest, n)
            row.append(x)
            left[k] -= x
            n -= x
        out.append(row)
    return out


def _key(seed: int, salt: int, names: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *names)


def shuffle_into_shards(rows: DataFrame, identity: list[str], shards: int = SHARDS, seed: int = 0, max_blocks: int = MAX_BLOCKS, part_rows: int = PART_ROWS) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (its place in the shard, gapless from 0).

    identity: the columns whose hash orders the rows; rows that agree in all of them stand in an arbitrary order
    among themselves. Nulls are values like others. An empty table gives no rows; with fewer rows than shards some
    shards are empty.
    """
    own = ["shard", "slot", "_row", "_block", "_part", "_rank", "_upto", "_before"]
    rows = rows.drop(*own)
    names = rows.columns
    spark = rows.sparkSession
    # The number of a row tells copies apart; its high bits are the partition that wrote it.
    placed = written(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    partition = F.shiftright("_row", 33)
    total, last = placed.agg(F.count("*"), F.coalesce(F.max(partition), F.lit(0))).first()
    placed = placed.withColumn("_block", (partition / F.lit(-(-(last + 1) // max_blocks))).cast("int"))
    sizes = sorted((r["_block"], r["n"]) for r in placed.groupBy("_block").agg(F.count("*").alias("n")).collect())
    shard_sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in sizes], shard_sizes, seed)
    upto = [(b, list(itertools.accumulate(row))) for (b, _), row in zip(sizes, matrix, strict=True)]
    limits = spark.createDataFrame(upto, "_block int, _upto array<long>")
    if len(sizes) * shards <= BROADCAST_NUMBERS:
        limits = F.broadcast(limits)
    parts_per_shard = max(1, -(-total // (shards * part_rows)))

    in_block = Window.partitionBy("_block").orderBy(_key(seed, 2, [*identity, "_row"]), "_row")
    dealt = (
        placed.withColumn("_rank", F.row_number().over(in_block) - 1)
        .join(limits, "_block")
        # The shard is the number of limits that the rank has reached.
        .withColumn("shard", F.size(F.filter("_upto", lambda x: x <= F.col("_rank"))))
        .withColumn("_part", F.pmod(_key(seed, 3, [*identity, "_row"]), F.lit(parts_per_shard)).cast("int"))
        .drop("_block", "_upto", "_rank")
    )
    dealt = written(dealt, "shard-dealt")
    parts = dealt.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    in_part = Window.partitionBy("shard", "_part").orderBy(_key(seed, 4, [*identity, "_row"]), "_row")
    return (
        dealt.withColumn("_rank", F.row_number().over(in_part) - 1)
        .join(parts, ["shard", "_part"])
        .select(*names, "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"))
    )
