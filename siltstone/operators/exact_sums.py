"""Correctly rounded sums of doubles as an aggregate that is merged like any other.

A finite double is a whole number of the smallest positive one, 2 ** -1074. That number is cut into limbs of 26 bits, of which a
double touches four at most; limbs are summed as whole numbers by group and limb, before and after the shuffle, and only
the sums of a group's limbs (81 at most) are put together and rounded once. No group's values meet in one task, and the
result does not depend on how the rows are dealt.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources.shared import fixed

_BITS, _LOWEST = 26, -1074
_LIMBS = -(-(1024 - _LOWEST) // _BITS)
#: Numbers of the limbs that stand for the two infinities.
_PLUS, _MINUS = 1000, 1001


def limbs(value: Column) -> Column:
    """The limbs of a double: an array of (at, part); none for null and NaN. Scaling by powers of two is exact, and so is each rest."""
    scale = F.array(*(F.lit(2.0 ** (_BITS * k + _LOWEST)) for k in range(_LIMBS)))
    step = lambda k: F.element_at(scale, (k + 1).cast("int"))

    def cut(state: Column, _: Column) -> Column:
        size = step(F.greatest(state["k"], F.lit(0)))
        part = F.when(state["k"] >= 0, F.floor(state["rest"] / size)).otherwise(F.lit(0).cast("long"))
        signed = F.struct(state["k"].alias("at"), F.when(value < 0, -part).otherwise(part).alias("part"))
        return F.struct((state["rest"] - part * size).alias("rest"), (state["k"] - 1).alias("k"), F.concat(state["out"], F.array(signed)).alias("out"))

    # The logarithm can be off by one limb where it is near a whole number; the first limb has room for that, and four follow.
    top = F.greatest(F.lit(0), F.least(F.lit(_LIMBS - 1), F.floor((F.log2(F.abs(value)) - _LOWEST) / _BITS))).cast("int")
    start = F.struct(F.abs(value).alias("rest"), top.alias("k"), F.array().cast("array<struct<at:int,part:long>>").alias("out"))
    found = F.aggregate(F.array(*(F.lit(i) for i in range(5))), start, cut, lambda s: F.filter(s["out"], lambda x: x["part"] != 0))
    endless = F.array(F.struct(F.when(value > 0, _PLUS).otherwise(_MINUS).alias("at"), F.lit(1).cast("long").alias("part")))
    none = F.array().cast("array<struct<at:int,part:long>>")
    return F.when(value.isNull() | F.isnan(value) | (value == 0), none).when(F.abs(value) == float("inf"), endless).otherwise(found)


def _put_together(limbs_of_group) -> float | None:
    parts = {x["at"]: x["part"] for x in limbs_of_group}
    plus, minus = parts.pop(_PLUS, 0), parts.pop(_MINUS, 0)
    if plus or minus:
        return None if plus and minus else float("inf" if plus else "-inf")
    whole = sum(part << _BITS * at for at, part in parts.items())
    try:
        # A quotient of whole numbers is rounded once, to the nearest double.
        return whole / (1 << -_LOWEST)
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")


@F.pandas_udf(T.DoubleType())
def _rounded(sums: pd.Series) -> pd.Series:
    return sums.map(_put_together)


def exact_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, total: of each group how many values there are and their sum, as math.fsum gives it. Null and NaN are left out.

    A sum beyond the doubles is infinite; both infinities have no sum, and no values have none.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"))
    parts = rows.select(*keys, F.explode(limbs(F.col("_x"))).alias("_l"))
    counts = rows.groupBy(*keys).agg(F.count_if(F.col("_x").isNotNull() & ~F.isnan("_x")).alias("n"))
    sums = parts.groupBy(*keys, F.col("_l.at").alias("at")).agg(F.sum("_l.part").alias("part"))
    whole = sums.groupBy(*keys).agg(F.collect_list(F.struct("at", "part")).alias("_limbs"))
    same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys], F.lit(True))
    joined = counts.alias("c").join(whole.alias("w"), same, "left")
    none = F.array().cast("array<struct<at:int,part:long>>")
    return joined.select(*(F.col(f"c.{k}").alias(k) for k in keys), "n", F.when(F.col("n") > 0, _rounded(F.coalesce("_limbs", none))).alias("total"))


def exact_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, variance of the sample, of correctly rounded sums: of the values, then of their squared distances from the mean."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"))
    # Written first: a group with most rows can then be split where its mean is joined.
    means = fixed(exact_sums(rows, keys, "_x").withColumn("mean", F.col("total") / F.col("n")), "means")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], F.lit(True))
    far = rows.alias("r").join(means.alias("m"), same).select(*(F.col(f"m.{k}").alias(k) for k in keys), F.col("mean"), ((F.col("_x") - F.col("mean")) * (F.col("_x") - F.col("mean"))).alias("_d"))
    squares = exact_sums(far, [*keys, "mean"], "_d")
    return squares.select(*keys, "n", "mean", F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)).alias("variance"))
