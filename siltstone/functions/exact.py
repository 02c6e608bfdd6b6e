"""Scalars that only Python itself computes as Python does, over Arrow batches: JSON by its parser, rounding of exact binary values."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unique(pairs: list) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("duplicate key")
    return dict(pairs)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def canonical(text: str | None, strict: bool) -> str | None:
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant) if strict else json.loads(text, parse_constant=lambda _: None)
    except (ValueError, TypeError, RecursionError):
        return None
    return json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, dict) else None


@F.pandas_udf(T.StringType())
def strict_object(text: pd.Series) -> pd.Series:
    """One JSON object in canonical form (keys sorted, ", " and ": "); null for anything else, for a key that stands twice and for NaN."""
    return text.map(lambda x: canonical(x, True)).astype(object)


@F.pandas_udf(T.StringType())
def lenient_object(text: pd.Series) -> pd.Series:
    """Like strict_object, but of a key that stands twice the last value counts, and NaN and Infinity pass, as null."""
    return text.map(lambda x: canonical(x, False)).astype(object)


def py_round(value: Column, digits: int) -> Column:
    """round() of the exact binary value, half to even: 2.675 is below its decimal form, and 0.125 is a tie."""

    @F.pandas_udf(T.DoubleType())
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, digits) if v is not None and math.isfinite(v) else v)

    return rounded(value)

