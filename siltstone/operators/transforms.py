"""Transforms that compose: a value is sent through steps, by its type or by the suffix of its name; and records are built from fields."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Step:
    """A function of a column that can be chained: a >> b is a, then b."""

    def __init__(self, f: Callable[[Column], Column]):
        self.f = f

    def __call__(self, value: Column) -> Column:
        return self.f(value)

    def __rshift__(self, after: Step) -> Step:
        return Step(lambda x: after(self(x)))


to_int, to_double, to_text = (Step(lambda c, k=k: c.try_cast(k)) for k in ("int", "double", "string"))
to_list = Step(lambda c: F.array(c))


def to_absolute(root: str) -> Step:
    return Step(lambda c: F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c)))


def by_suffix(routes: dict[tuple[str, ...], Step], default: Step | None = None) -> Step:
    """The step for the suffix of a name, in lower case; without one the default's, or null."""

    def route(name: Column) -> Column:
        suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
        cases = [F.when(suffix.isin(*k), step(name)) for k, step in routes.items()]
        return F.coalesce(*cases, default(name) if default else F.lit(None))

    return Step(route)


def by_type(routes: dict[str, Step], kinds: dict[str, str]) -> Callable[[str], Column]:
    """A function of a column's name that takes the step for the column's type, or for the longest prefix of it that has one."""

    def route(name: str) -> Column:
        found = [k for k in routes if kinds[name].startswith(k)]
        if not found:
            raise TypeError(f"no route for {kinds[name]}")
        return routes[max(found, key=len)](F.col(name))

    return route


def each(step: Step) -> Step:
    """The step for every element of an array."""
    return Step(lambda c: F.transform(c, lambda x: step(x)))


def zipped_with_fallback(first: Column, second: Column, base: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Two arrays side by side as far as the longer goes: where the second has a value, join(first or base, it), else the first."""
    pairs = F.arrays_zip(first.alias("a"), second.alias("b"))
    return F.transform(pairs, lambda p: F.when(p["b"].isNull(), p["a"]).otherwise(join(F.coalesce(p["a"], base), p["b"])))


def typed_values(constraints: Column) -> Column:
    """A map from a constraint's type to its value; the last of a type counts."""
    return F.aggregate(
        constraints, F.create_map().cast("map<string,string>"),
        lambda m, c: F.map_concat(F.map_filter(m, lambda k, _: k != c["type"]), F.map_from_arrays(F.array(c["type"]), F.array(c["value"]))),
    )


def with_config(rows: DataFrame, config: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """rows with their tag's configuration, and the tags that have none."""
    return rows.join(F.broadcast(config), tag), rows.select(tag).distinct().join(config, tag, "left_anti")


def resolved(paths: DataFrame, path: str, files: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """path, at: paths that lie below exactly one of the roots (files: path); and path, n of those that lie nowhere or in several places."""
    at = F.when(F.col(path).startswith("/"), F.array(F.col(path))).otherwise(F.array(*(F.concat(F.lit(r.rstrip("/") + "/"), F.col(path)) for r in roots)))
    tried = paths.select(path, F.explode(F.array_distinct(at)).alias("at"))
    there = tried.join(files.select(F.col("path").alias("at"), F.lit(1).alias("_there")), "at", "left")
    found = there.groupBy(path).agg(F.count("_there").alias("n"), F.max(F.when(F.col("_there") == 1, F.col("at"))).alias("at"))
    return found.where("n = 1").select(path, "at"), found.where("n <> 1").select(path, "n")


def lowest_with(rows: DataFrame, key: str, index: str, test: Column, default: int = 999) -> DataFrame:
    """Of each key the row with the lowest index (default if it has none) that passes the test."""
    ok = rows.where(test)
    rest = [c for c in rows.columns if c != key]
    return ok.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.coalesce(index, F.lit(default)), F.xxhash64(*rest))).alias("_r")).select(key, "_r.*")


def paired_factors(factors: DataFrame, root: str, side: str, sides: tuple[str, str], value: str) -> tuple[DataFrame, DataFrame]:
    """root and the value of either side; and roots that lack one."""
    wide = factors.groupBy(root).pivot(side, list(sides)).agg(F.first(value))
    whole = reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in sides])
    return wide.where(whole), wide.where(~whole).select(root)


def any_condition(*fields: Column) -> Column:
    """Is any of the conditioning fields there, as a text or list that is not empty?"""
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in fields]), F.lit(False))
