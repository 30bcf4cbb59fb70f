"""Column expressions shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for a real number; false for NULL, NaN and both infinities."""
    value = col(c).cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def safe_div(numerator: Column | str, denominator: Column | str) -> Column:
    """Division giving NULL where the denominator is zero or NULL."""
    below = col(denominator).cast("double")
    return F.when(below != 0, col(numerator).cast("double") / below)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: sum(w * v) / sum(w) over rows where both are present."""
    v, w = col(value).cast("double"), col(weight).cast("double")
    present = v.isNotNull() & w.isNotNull()
    return safe_div(F.sum(F.when(present, v * w)), F.sum(F.when(present, w)))


def true_or_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as one JSON document, stable across runs and partitions."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def hash_bits(*keys: Column | str) -> Column:
    """32 uniform bits of an md5 over the keys joined with '-'."""
    joined = F.concat_ws("-", *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*keys: Column | str) -> Column:
    """Deterministic draw in [0, 1) that depends on nothing but the keys."""
    return hash_bits(*keys) / F.lit(4294967296.0)


def micros_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(1000000.0)


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def rounded(c: Column | str, places: int = 6) -> Column:
    """Rounded double with negative zero removed, so results compare across engines."""
    return F.round(col(c).cast("double"), places) + F.lit(0.0)
