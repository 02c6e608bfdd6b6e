"""Order-dependent operators. Rows have no order of their own: each operator takes the columns that give one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.numbers import stable_hash
from siltstone.sources.shared import fixed


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row a key, the last by position: an aggregate, so a hot key is combined before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_r"))
    return picked.select(*keys, *(F.col("_r")[c].alias(c) for c in rest)).select(df.columns)


def quota(df: DataFrame, keys: list[str], order: list[Column | str], most: int | Column) -> DataFrame:
    """At most so many rows a key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def dealt_by_range(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df range-partitioned in a total order and written once, with _part, the number of a row's partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fixed(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "positions")


def numbered(dealt: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Rows of dealt_by_range with gapless positions from 0: rows are numbered in their partitions, whose counts give the offsets."""
    local = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before.select("_part", "_before"), "_part").withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("long")).drop("_part", "_rn", "_before")


def with_positions(df: DataFrame, order: list[Column | str], name: str = "_pos") -> DataFrame:
    """df with gapless positions from 0 in a total order, without gathering the rows in one task."""
    return numbered(dealt_by_range(df, order), order, name)


def ranked(df: DataFrame, group: str, order: list[Column | str], name: str) -> DataFrame:
    """df with the place of each row in its group, from 1. A group that holds most rows is in many tasks: places are differences of positions."""
    placed = with_positions(df, [group, *order], "_position")
    first = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_position").alias("_first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_position") - F.col("_first") + 1).drop("_group", "_first", "_position")


def hash_ranked(df: DataFrame, salt: str, key: str, most: int) -> DataFrame:
    """A bottom-k sample: the rows with the lowest salted hashes of their key."""
    return df.withColumn("rank_hash", stable_hash(F.lit(salt), F.col(key).cast("string"))).orderBy("rank_hash", key).limit(most)


def distinct_first(df: DataFrame, concept: str, concept_order: Column, order: list[Column | str]) -> DataFrame:
    """df with occurrence (1 for the first row of a concept) and place: first all new concepts in their order, then the repeats."""
    counted = ranked(df.withColumn("_concept_order", concept_order), concept, order, "occurrence")
    keys = [F.least(F.col("occurrence"), F.lit(2)), "_concept_order", *order]
    return with_positions(counted, keys, "place").drop("_concept_order")


def cell_selection(df: DataFrame, cell: list[str], concept: str, concept_order: Column, order: list[str], prompt: str, most: int) -> DataFrame:
    """At most so many rows of every cell, with place: first one row of each concept, concepts in their order, then the others; of a prompt only the first row of its cell counts."""
    again = F.least(F.row_number().over(Window.partitionBy(*cell, concept).orderBy(*order)), F.lit(2))
    ranked_ = df.withColumn("_concept_order", concept_order).withColumn("_again", again)
    by = ["_again", "_concept_order", *order]
    once = first_wins(ranked_, [*cell, prompt], by)
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(*cell).orderBy(*by)) - 1)
    return placed.where(F.col("place") < most).drop("_again", "_concept_order")


def round_robin(df: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """df with turn (one row of each group a turn) and place: turn by turn, groups in order within it."""
    return with_positions(ranked(df, group, order, "turn"), ["turn", group], "place")


def evenly_spaced_rows(df: DataFrame, position: str, total: int, count: int) -> DataFrame:
    """slot and the row at the count positions spread evenly over total; positions repeat if count exceeds total."""
    slots = df.sparkSession.range(count).select(F.col("id").alias("slot"))
    wanted = slots.withColumn(position, F.expr(f"least({total} - 1, ((2 * slot + 1) * {total}) div (2 * {count}))"))
    return wanted.join(df, position)


def shard(position: Column, n: int, total: Column | None = None) -> Column:
    """The shard of a position by its remainder; of positions counted from the end, if total is given."""
    return F.pmod(position if total is None else total - 1 - position, F.lit(n))


def contiguous_rank(position: Column, total: Column, ranks: int) -> Column:
    """The rank whose contiguous range holds a position; the first total % ranks ranges are one longer."""
    chunk, rest = F.floor(total / ranks), F.pmod(total, F.lit(ranks))
    head = rest * (chunk + 1)
    return F.when(position < head, F.floor(position / (chunk + 1))).otherwise(rest + F.floor((position - head) / F.greatest(chunk, F.lit(1))))


def interleave(parts: dict[str, DataFrame], pattern: list[str], sizes: dict[str, int], position: str = "_pos") -> DataFrame:
    """slot, loader and row position of a cyclic mix: as many cycles as the scarcest part allows."""
    need = {name: pattern.count(name) for name in set(pattern)}
    cycles = min(sizes[name] // n for name, n in need.items())
    out = None
    for name, n in need.items():
        places = F.array(*(F.lit(i) for i, p in enumerate(pattern) if p == name))
        rows = parts[name].where(F.col(position) < cycles * n)
        slot = F.floor(F.col(position) / n) * len(pattern) + F.get(places, F.pmod(F.col(position), F.lit(n)).cast("int"))
        rows = rows.select(slot.cast("long").alias("slot"), F.lit(name).alias("loader"), position)
        out = rows if out is None else out.unionByName(rows)
    return out


def grouped_split(df: DataFrame, group: str, eval_ratio: float) -> DataFrame:
    """df with split: whole groups, ordered by hash, go to eval until the rounded share (at least one, not all)."""
    groups = df.select(group).distinct()
    n = groups.count()
    k = min(n - 1, max(1, round(n * eval_ratio))) if n else 0
    chosen = groups.orderBy(F.sha2(F.col(group).cast("string"), 256), group).limit(max(0, k)).withColumn("_eval", F.lit(1))
    return df.join(chosen, group, "left").withColumn("split", F.when(F.col("_eval") == 1, "eval").otherwise("train")).drop("_eval").select(*df.columns, "split")


def natural_key(name: Column) -> Column:
    """A text that sorts as its digit runs do as numbers: every run is padded to 20 digits."""
    runs = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x)), "")
