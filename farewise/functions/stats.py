"""Distribution functions as Arrow-batched column functions, plus the Holm adjustment.

They run on result tables (one row per estimate or test), never on fact rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewise.functions.scalars import col
from farewise.functions.skew import null_safe_join, with_running_max
from farewise.session import scratch_path

_STEPS = 200


def _log_gamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def beta_cdf(x, a, b):
    """Regularized incomplete beta function, by its continued fraction (Lentz)."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    flip = x > (a + 1) / (a + b + 2)
    z, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    inside = (z > 0) & (z < 1)
    z = np.where(inside, z, 0.5)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z))
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    # Every element stops at its own step, so its value does not depend on what else is in the batch. The fraction
    # needs steps in proportion to the root of its size.
    live = inside.copy()
    for m in range(1, _STEPS + int(10 * np.sqrt(np.max(a + b, initial=0, where=inside)))):
        before = h
        for top in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        h = np.where(live, h, before)
        live &= ~(np.abs(c * d - 1) < 1e-15)
        if not live.any():
            break
    value = np.where(inside, front * h / p, 0.0)
    low_end, high_end = x <= 0, x >= 1
    value = np.where(flip, 1 - value, value)
    return np.where(low_end, 0.0, np.where(high_end, 1.0, value))


def beta_quantile(prob, a, b):
    """Inverse of `beta_cdf` by bisection to machine resolution."""
    prob, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (prob, a, b)))
    low, high = np.zeros(prob.shape), np.ones(prob.shape)
    for _ in range(60):
        middle = (low + high) / 2
        under = beta_cdf(middle, a, b) < prob
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def normal_quantile(prob: float) -> float:
    return NormalDist().inv_cdf(prob)


def t_quantile(prob, df):
    """Student-t quantile through the beta distribution of df / (df + t^2)."""
    prob, df = np.broadcast_arrays(np.asarray(prob, float), np.asarray(df, float))
    tail = np.minimum(prob, 1 - prob)
    x = beta_quantile(2 * tail, df / 2, 0.5)
    size = np.sqrt(df * (1 - x) / np.maximum(x, 1e-300))
    return np.where(prob == 0.5, 0.0, np.where(prob < 0.5, -size, size))


def _log_pmf(k, n, p):
    """Log binomial probability; p strictly inside (0, 1)."""
    return (
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
        + k * np.log(p) + (n - k) * np.log1p(-p)
    )


def _at_most(k, n, p):
    k = np.floor(k)
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, beta_cdf(1 - p, np.maximum(n - k, 0.5), np.maximum(k + 1, 0.5))))


def binomial_p_value(k, n, p, alternative: str = "two-sided"):
    """Exact test. Two-sided sums every outcome no likelier than the one observed."""
    k, n, p = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, p)))
    if alternative == "less":
        return _at_most(k, n, p)
    if alternative == "greater":
        return 1 - _at_most(k - 1, n, p)
    level = _log_pmf(k, n, p) + np.log1p(1e-7)
    mean = n * p
    below = k <= mean
    # The far tail starts at the first outcome past the mean that is no likelier than k.
    near, far = np.where(below, np.ceil(mean), -1.0), np.where(below, n + 1, np.floor(mean) + 1)
    near, far = near - below, far.copy()
    for _ in range(64):
        middle = np.floor((near + far) / 2)
        unlikely = _log_pmf(np.clip(middle, 0, n), n, p) <= level
        start_later = np.where(below, ~unlikely, unlikely)
        move = (far - near) > 1
        near = np.where(move & start_later, middle, near)
        far = np.where(move & ~start_later, middle, far)
    other = np.where(below, 1 - _at_most(far - 1, n, p), _at_most(near, n, p))
    own = np.where(below, _at_most(k, n, p), 1 - _at_most(k - 1, n, p))
    return np.where(np.abs(k - mean) < 1e-12, 1.0, np.minimum(own + other, 1.0))


def _on_present(function, *series: pd.Series) -> pd.Series:
    """Apply a numpy function where every argument is present; NULL elsewhere."""
    values = [s.astype("float64") for s in series]
    ok = np.logical_and.reduce([v.notna() for v in values])
    out = pd.Series(np.nan, index=values[0].index, dtype="float64")
    if ok.any():
        out[ok] = function(*[v[ok].to_numpy() for v in values])
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(T.DoubleType())
def _t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _on_present(t_quantile, p, df.where(df > 0))


@F.pandas_udf(T.DoubleType())
def _norm_ppf(p: pd.Series) -> pd.Series:
    inv = np.vectorize(normal_quantile, otypes=[float])
    return _on_present(inv, p.where((p > 0) & (p < 1)))


@F.pandas_udf(T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]))
def _clopper_pearson(k: pd.Series, n: pd.Series, level: pd.Series) -> pd.DataFrame:
    n = n.where(n > 0)

    def low(k, n, level):
        return np.where(k > 0, beta_quantile((1 - level) / 2, np.maximum(k, 1), n - k + 1), 0.0)

    def high(k, n, level):
        return np.where(k < n, beta_quantile((1 + level) / 2, k + 1, np.maximum(n - k, 1)), 1.0)

    return pd.DataFrame({"lower": _on_present(low, k, n, level), "upper": _on_present(high, k, n, level)})


@F.pandas_udf(T.DoubleType())
def _binom(k: pd.Series, n: pd.Series, p: pd.Series, alternative: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(k), index=k.index, dtype=object)
    for kind in alternative.unique():
        rows = alternative == kind
        out[rows] = _on_present(lambda a, b, c, kind=kind: binomial_p_value(a, b, c, kind), k[rows], n[rows].where(n[rows] > 0), p[rows])
    return out


def _num(value) -> Column:
    return (F.lit(value) if isinstance(value, (int, float)) else col(value)).cast("double")


def t_ppf(prob, df) -> Column:
    """Student-t quantile; NULL where df is missing or not positive."""
    return _t_ppf(_num(prob), _num(df))


@F.pandas_udf(T.DoubleType())
def _norm_cdf(x: pd.Series) -> pd.Series:
    return _on_present(np.vectorize(NormalDist().cdf, otypes=[float]), x)


def norm_cdf(x) -> Column:
    """Standard normal distribution function."""
    return _norm_cdf(_num(x))


def norm_ppf(prob) -> Column:
    return _norm_ppf(_num(prob))


def clopper_pearson(k, n, level=0.95) -> Column:
    """Struct(lower, upper): exact binomial interval, NULL when n = 0."""
    return _clopper_pearson(_num(k), _num(n), _num(level))


def binom_test(k, n, p, alternative: str = "two-sided") -> Column:
    """Exact binomial p-value, two-sided, 'less' or 'greater'."""
    return _binom(_num(k), _num(n), _num(p), F.lit(alternative))


def holm_adjust(df: DataFrame, p: str, family: list[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within each family of tests; NULL tests are left out.

    Equal p-values share one adjusted value, so the work runs on distinct p-values with their
    counts, cut into pieces of p: ranks are piece offsets plus ranks inside a piece, and the
    step-down maximum carries over between pieces. No family is sorted in one task. The tests are
    stored first: adjusted values are joined by p, which computed twice may differ in its last bit.
    """
    keys = list(family)
    path = scratch_path(df.sparkSession, "tests")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    tests = df.filter(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    tests = tests.withColumn("_piece", F.floor(100 * F.ln(F.greatest(F.col("_p"), F.lit(1e-300)))))
    along = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = tests.groupBy(*keys, "_piece").agg(F.sum("_c").alias("_n")).select(
        *keys, "_piece", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_skip"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_m"),
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = null_safe_join(
        tests.withColumn("_before", F.coalesce(F.sum("_c").over(inside), F.lit(0))), pieces, [*keys, "_piece"], "inner"
    )
    raw = ranked.select(*keys, "_p", "_piece", (F.col("_p") * (F.col("_m") - F.col("_skip") - F.col("_before"))).alias("_raw"))
    stepped = with_running_max(raw, keys, ["_p"], F.col("_piece"), "_raw", "_top")
    adjusted = stepped.select(*keys, F.col("_p").alias(p), F.least(F.lit(1.0), F.greatest("_raw", "_top")).alias(out))
    return null_safe_join(df, adjusted, [*keys, p], "left")
