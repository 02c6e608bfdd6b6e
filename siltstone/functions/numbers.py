"""Arithmetic of metrics, sampling positions and hashes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or the default where b is 0."""
    return F.when(b == 0, F.lit(default).cast("double")).otherwise(a.cast("double") / b)


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """All three are 0.0 where there is nothing to divide by; F1 is 2 tp / (2 tp + fp + fn)."""
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def stable_hash(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by the unit separator, in hex."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def hash_choice(key: Column, n: int | Column) -> Column:
    """A number from 0 to n - 1 from the first 32 bits of a key's SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def hash_uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def evenly_spaced(i: Column, n: Column, count: Column) -> Column:
    """Position i of count positions spread evenly over 0 to n - 1."""
    return F.least(n - 1, F.floor((2 * i + 1) * n / (2 * count)))


def resample_positions(n: Column, k: int) -> Column:
    """k positions from 0 to n - 1 at equal distances, rounded half to even."""
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(k - 1), 0).cast("long"))


def strided_frames(n: Column, k: int) -> Column:
    """Every (n div k)-th position of 0 to n - 1: k of them or more."""
    return F.sequence(F.lit(0).cast("long"), n - 1, F.greatest(F.lit(1).cast("long"), F.floor(n / k)))


def spaced_frames(n: Column, k: int) -> Column:
    """Exactly k positions, n div k apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i * F.greatest(F.lit(1).cast("long"), F.floor(n / k)))


def align_frames(n: Column) -> Column:
    """The largest 4k + 1 up to n."""
    return n - F.pmod(n - 1, F.lit(4))


def quartile(i: Column, n: Column) -> Column:
    """1 to 4: the quarter of 0 to n - 1 that i lies in."""
    return F.least(F.lit(4), F.floor(i * 4 / n) + 1)


def warmup_steps(rows: Column) -> Column:
    """A sixth of the steps of batches of eight, between 10 and 250."""
    return F.greatest(F.lit(10), F.least(F.lit(250), F.floor(F.ceil(rows / 8) / 6)))


def fit_pixels(height: Column, width: Column, most: int, multiple: int = 16) -> Column:
    """height and width scaled down to at most so many pixels and floored to a multiple."""
    scale = F.greatest(F.lit(1.0), F.sqrt(height * width / F.lit(most)))
    side = lambda x: (F.floor(x / scale / multiple) * multiple).cast("long")
    return F.struct(side(height).alias("height"), side(width).alias("width"))


def frame_rate(text: Column) -> Column:
    """The value of num/den or of a plain number; null where den is 0 or nothing can be read."""
    num, den = F.try_to_number(F.split_part(text, F.lit("/"), F.lit(1)), F.lit("999999")), F.split_part(text, F.lit("/"), F.lit(2))
    bottom = F.when(den == "", F.lit(1.0)).otherwise(den.try_cast("double"))
    return F.try_divide(num.cast("double"), bottom)


def lambda_slug(value: Column) -> Column:
    return F.format_string("lambda_%04d", F.bround(value * 1000, 0).cast("int"))
