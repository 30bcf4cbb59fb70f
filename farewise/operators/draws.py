"""Refits under many weightings of days, as products of a multiplicity block and day vectors.

A draw is a vector of multiplicities over the days of a key; leaving a day out is another. Every estimator here is
algebra on sums over days, so a block of `DRAW_BLOCK` draws is one matrix product with the key's day vectors: the data
is read once, the day vectors travel once per block, and nothing has one row per draw and day.

Double machine learning with cell means needs sums by cell and fold besides. A day keeps its fold in every draw, so each
cell's day vectors, times the multiplicities, give the draw's fold sums, the means of the other folds follow by subtraction,
and cells leave one short vector per draw, key and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farewise.functions.skew import null_safe_join
from farewise.operators.estimate import Gram, Model, check_estimator, dml_model, fit_from_gram, identified_effects, moments, weighted_gram
from farewise.sources.tables import ContractError

THETAS = ("theta_xx", "theta_xy", "theta_yx", "theta_yy")
DRAW_BLOCK = 64
#: Keys of one task whose sums are held before they are passed on.
HELD_KEYS = 16
_SUMS = ("n", "w", *[f"s_{i}" for i in range(4)], *[f"m_{i}{j}" for i in range(4) for j in range(i, 4)])
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def kinds(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]


def ranked_days(days: DataFrame, day: str, by: Sequence[str] = (), seed: str | None = None) -> DataFrame:
    """(by..., day, _rank, _days, _prefix): a key's days in order, their number, and what its draws are hashed with."""
    own = Window.partitionBy(*by)
    prefix = F.concat_ws("-", *([F.lit(seed)] if seed else []), *[F.col(b).cast("string") for b in by], F.lit(""))
    return days.select(*by, day).distinct().select(
        *by, day, (F.row_number().over(own.orderBy(day)) - 1).alias("_rank"), F.count(F.lit(1)).over(own).alias("_days"), prefix.alias("_prefix")
    )


@lru_cache(maxsize=HELD_KEYS)
def multiplicities(prefix: str, first: int, last: int, days: int) -> np.ndarray:
    """How often each day enters draws `first` to `last` - 1: position i of draw b picks day hash(b, i) mod days."""
    out = np.zeros((last - first, days))
    for b in range(first, last):
        for i in range(days):
            out[b - first, int(hashlib.md5(f"{prefix}{b}-{i}".encode()).hexdigest()[:8], 16) % days] += 1
    return out


def weights_of(prefix: str, first: int, last: int, days: int, leave_out: bool) -> np.ndarray:
    if leave_out:
        return 1.0 - np.eye(days)[first:last]
    return multiplicities(prefix, first, last, days)


def refit(
    df: DataFrame, controls: Sequence[str], draws: int | None, estimator: str, day: str, by: Sequence[str], seed: str | None,
    expected_active: tuple[int, ...], cell: Sequence[str], fold: str,
) -> DataFrame:
    """(by..., draw_id, status, reason, effects, intercept, coefficients); without `draws`, draw k leaves out day k."""
    if estimator != "dml":
        check_estimator(estimator)
    by, controls, leave_out = list(by), tuple(controls), draws is None
    ranked = ranked_days(df, day, by, seed)
    vectors = null_safe_join(weighted_gram(df, controls, [*by, day]), ranked, [*by, day], "inner")
    many = F.col("_days") if leave_out else F.lit(draws)
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((many - 1) / DRAW_BLOCK))).alias("_block")
    vectors = vectors.select(*by, "_rank", "_days", "_prefix", "g", block)
    fields = [*kinds(df, by), "draw_id bigint", "status string", "reason string", *[f"{t} double" for t in THETAS]]
    schema = ", ".join([*fields, "intercept array<double>", "coefficients array<double>"])
    names, shape = [*by, "draw_id", "status", "reason", *THETAS, "intercept", "coefficients"], _arrow(df, by)

    def solve(key: tuple, table: pa.Table, sums: dict[int, np.ndarray] | None) -> pa.Table:
        *own, number = key
        days, prefix = table.column("_days")[0].as_py(), table.column("_prefix")[0].as_py()
        first = number * DRAW_BLOCK
        last = min(first + DRAW_BLOCK, days if leave_out else draws)
        grams = np.zeros((days, len(table.column("g")[0])))
        grams[table.column("_rank").to_numpy()] = np.array(table.column("g").to_pylist())
        out = []
        for b, vector in enumerate(weights_of(prefix, first, last, days, leave_out) @ grams, start=first):
            gram = Gram(vector, controls)
            if sums is None:
                model = fit_from_gram(gram, estimator)
            else:
                model = dml_model(gram, sums.get(b, np.zeros(12)))
            out.append((*own, b, *solved(model, expected_active)))
        return pa.Table.from_pandas(pd.DataFrame(out, columns=names), schema=shape, preserve_index=False)

    groups = vectors.groupBy(*by, "_block")
    if estimator != "dml":
        return groups.applyInArrow(lambda key, table: solve(tuple(k.as_py() for k in key), table, None), schema)
    sums = dml_sums(df, draws, day, by, ranked, cell, fold).withColumn("_block", F.floor(F.col("draw_id") / DRAW_BLOCK))

    def both(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return shape.empty_table()
        by_draw = dict(zip(found.column("draw_id").to_pylist(), map(np.array, found.column("m").to_pylist()), strict=True))
        return solve(tuple(k.as_py() for k in key), table, by_draw)

    return groups.cogroup(sums.groupBy(*by, "_block")).applyInArrow(both, schema)


def solved(model: Model, expected_active: tuple[int, ...]) -> tuple:
    """status, reason, effects (NULL where not identified), intercept and coefficients of a fit."""
    reason = model.warnings[0] if not model.ok else None
    if reason is None and model.active != tuple(expected_active):
        reason = "a price column no longer varies"
    if reason:
        return ("failed", reason, *[None] * 4, None, None)
    return ("succeeded", None, *identified_effects(model), model.intercept.tolist(), model.coefficients.ravel().tolist())


def _arrow(df: DataFrame, by: Sequence[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    own = [(b, to_arrow_type(df.schema[b].dataType)) for b in by]
    rest = [("draw_id", pa.int64()), ("status", pa.string()), ("reason", pa.string()), *[(t, pa.float64()) for t in THETAS]]
    return pa.schema([*own, *rest, ("intercept", pa.list_(pa.float64())), ("coefficients", pa.list_(pa.float64()))])


def cross_fitted(sums: np.ndarray, folds: np.ndarray, times: np.ndarray) -> np.ndarray:
    """n, w and the residual cross products that one cell adds to each draw.

    `sums` has one row of moments per (day, fold) and `times` how often each row enters each draw.
    """
    out = np.zeros((len(times), 12))
    parts = {f: times[:, folds == f] @ sums[folds == f] for f in set(folds.tolist())}
    total = sum(parts.values())
    for own in parts.values():
        rest = total - own
        seen = (rest[:, 1] > 0) & (own[:, 0] > 0)  # means of the other folds exist
        own, rest = own[seen], rest[seen]
        mean = rest[:, 2:6] / rest[:, 1:2]
        out[seen, :2] += own[:, :2]
        for k, (i, j) in enumerate(_PAIRS):
            out[seen, 2 + k] += (
                own[:, 6 + k] - mean[:, j] * own[:, 2 + i] - mean[:, i] * own[:, 2 + j] + mean[:, i] * mean[:, j] * own[:, 1]
            )
    return out


def dml_sums(
    df: DataFrame, draws: int | None, day: str, by: Sequence[str], ranked: DataFrame, cell: Sequence[str], fold: str
) -> DataFrame:
    """(by..., draw_id, m array<double>): n, w and cross products of out-of-fold residuals, per draw."""
    by, leave_out = list(by), draws is None
    per = null_safe_join(moments(df, list(dict.fromkeys([*by, *cell, fold, day]))), ranked, [*by, day], "inner")
    row = F.struct("_rank", F.col(fold).cast("string").alias("fold"), *[F.col(c).cast("double").alias(c) for c in _SUMS])
    # A cell has at most one row per day and fold.
    keys = list(dict.fromkeys([*by, *cell]))
    cells = per.groupBy(*keys).agg(F.first("_days").alias("_days"), F.first("_prefix").alias("_prefix"), F.collect_list(row).alias("rows"))
    schema = ", ".join([*kinds(df, by), "draw_id bigint", "m array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        template: list = []

        def rows() -> pa.RecordBatch:
            own = [[key[i] for key, sums in held.items() for _ in sums] for i in range(len(by))]
            numbers = [b for sums in held.values() for b in range(len(sums))]
            values = [v for sums in held.values() for v in sums.tolist()]
            arrays = [pa.array(c, t) for c, t in zip(own, template, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([*arrays, pa.array(numbers, pa.int64()), pa.array(values, pa.list_(pa.float64()))], names=[*by, "draw_id", "m"])

        for batch in batches:
            template = [batch.column(b).type for b in by]
            lists = batch.column("rows")
            at, inner = lists.offsets.to_numpy(), lists.values
            table = np.column_stack([inner.field(c).to_numpy(zero_copy_only=False) for c in _SUMS]) if len(inner) else np.zeros((0, 16))
            rank = inner.field("_rank").to_numpy(zero_copy_only=False)
            folds = np.array(inner.field("fold").to_pylist(), object)
            keys_of = list(zip(*[batch.column(b).to_pylist() for b in by], strict=True)) if by else [()] * batch.num_rows
            counts, prefixes = batch.column("_days").to_pylist(), batch.column("_prefix").to_pylist()
            for k, key in enumerate(keys_of):
                span = slice(at[k] - at[0], at[k + 1] - at[0])
                times = weights_of(prefixes[k], 0, counts[k] if leave_out else draws, counts[k], leave_out)
                added = cross_fitted(table[span], folds[span], times[:, rank[span]])
                held[key] = held[key] + added if key in held else added
                if len(held) > HELD_KEYS:
                    yield rows()
        if held:
            yield rows()

    partial = cells.select(*by, "_days", "_prefix", "rows").mapInArrow(run, schema)
    return partial.groupBy(*by, "draw_id").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(12)]).alias("m"))


def residual_sums(df: DataFrame, by: Sequence[str], cell: Sequence[str], fold: str) -> DataFrame:
    """(by..., m array<double>): n, w and cross products of out-of-fold residuals per key."""
    per = moments(df, list(dict.fromkeys([*by, *cell, fold])))
    rest = Window.partitionBy(*list(dict.fromkeys([*by, *cell])))
    w = F.sum("w").over(rest) - F.col("w")
    means = {f"p_{i}": F.when(w > 0, (F.sum(f"s_{i}").over(rest) - F.col(f"s_{i}")) / w) for i in range(4)}
    placed = per.withColumns(means).filter(F.col("p_0").isNotNull())
    p, s = (lambda i: F.col(f"p_{i}")), (lambda i: F.col(f"s_{i}"))
    products = [F.col(f"m_{i}{j}") - p(j) * s(i) - p(i) * s(j) + p(i) * p(j) * F.col("w") for i, j in _PAIRS]
    sums = [F.sum(c.cast("double")) for c in (F.col("n"), F.col("w"), *products)]
    return placed.groupBy(*by).agg(F.array(*sums).alias("m"))


def fit_by(df: DataFrame, controls: Sequence[str], by: Sequence[str], estimator: str, expected_active, cell: Sequence[str], fold: str) -> DataFrame:
    """One fit per key of `by`: status, reason, effects, base rate, rank and condition number."""
    by, controls = list(by), tuple(controls)
    grams = weighted_gram(df, controls, by)
    if estimator == "dml":
        grams = null_safe_join(grams, residual_sums(df, by, cell, fold), by, "left")
    elif estimator not in ("naive_ols", "adjusted_ols", "contrast_ols"):
        raise ContractError(f"unknown estimator {estimator!r}")
    schema = ", ".join([*kinds(df, by), "status string", "reason string", *[f"{t} double" for t in THETAS], "intercept array<double>, coefficients array<double>, rank int, condition double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                gram = Gram(row["g"], controls)
                m = row.get("m")
                model = fit_from_gram(gram, estimator) if estimator != "dml" else dml_model(gram, np.zeros(12) if m is None else np.array(m))
                out.append((*[row[b] for b in by], *solved(model, expected_active), model.rank, model.condition))
            yield pd.DataFrame(out, columns=[*by, "status", "reason", *THETAS, "intercept", "coefficients", "rank", "condition"])

    return grams.mapInPandas(run, schema)
