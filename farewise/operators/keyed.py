"""Sandwich covariances of many fits at once.

Every key of `by` (a dataset, a seed, a market) has its own fit. What a key's rows need of it is its gram vector, from which the
fit is solved again wherever it is needed. Gram vectors and rows meet in one sorted stream: a key is dealt into
`SALTS` parts, each part begins with its key's vector, and its rows follow and are summed up batch by batch, so a key
of any size is spread over tasks and none is held. Day-clustered covariances need no rows: a day's scores are linear in
its gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.functions.skew import null_safe_join
from farewise.operators.draws import kinds, residual_sums
from farewise.operators.estimate import Gram, Model, added, check_estimator, design_columns, dml_model, fit_from_gram, residualize, weighted_gram
from farewise.operators.inference import RESIDUALS, _design, _lift, _scores, dml_blocks, dml_sandwich
from farewise.sources.tables import ContractError

SALTS = 16
ERRORS = ("se_xx", "se_xy", "se_yx", "se_yy")
METHODS = {"hc3": "block_hc3_t", "score": "block_score_normal", "day_cr1": "day_cr1_t"}


def sums_beside_heads(
    heads: DataFrame, rows: DataFrame, by: Sequence[str], add: Callable[[np.ndarray, np.ndarray], np.ndarray | None], salts: int | None = None
) -> DataFrame:
    """(by..., g): sum over a key's rows of `add(head, values)`, which gives one vector for many rows, or None.

    `heads` has one array `v` per key, `rows` any number of arrays `v` of equal length.
    """
    by, salts = list(by), salts or SALTS
    salt = F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int").alias("_salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    stream = heads.select(*by, every, F.lit(0).alias("_kind"), "v").unionByName(rows.select(*by, salt, F.lit(1).alias("_kind"), "v"))
    stream = stream.repartition(*by, "_salt").sortWithinPartitions(*by, "_salt", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, head, total = None, None, None
        out: list[tuple[pa.RecordBatch, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            columns = [pa.concat_arrays([n.column(b) for n, _ in out]) for b in by]
            values = pa.array([v.tolist() for _, v in out], pa.list_(pa.float64()))
            out.clear()
            return pa.RecordBatch.from_arrays([*columns, values], names=[*by, "g"])

        for batch in batches:
            kind = batch.column("_kind").to_numpy()
            borders = np.unique(np.concatenate([[0], np.flatnonzero(kind == 0), np.flatnonzero(kind == 0) + 1, [len(kind)]]))
            for begin, end in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                values = batch.column("v").slice(begin, end - begin).flatten().to_numpy(zero_copy_only=False)
                if kind[begin] == 0:
                    if total is not None:
                        out.append((name, total))
                    name, head, total = batch.slice(begin, 1), values, None
                    continue
                found = add(head, values.reshape(end - begin, -1))
                if found is not None:
                    total = found if total is None else total + found
            if len(out) >= 64:
                yield done()
        if total is not None:
            out.append((name, total))
        if out:
            yield done()

    columns = ", ".join([*kinds(rows, by), "g array<double>"])
    return added(stream.select(*by, "_kind", "v").mapInArrow(run, columns), by)


def _row_scores(estimator: str, controls: tuple[str, ...]) -> Callable[[np.ndarray, np.ndarray], np.ndarray | None]:
    """Leverage-corrected score products of one key's rows; a row of unit leverage makes the key's sums NaN."""
    memo: list = [None, None]

    def add(head: np.ndarray, values: np.ndarray) -> np.ndarray | None:
        if memo[0] is not head:
            gram = Gram(head, controls)
            model = fit_from_gram(gram, estimator)
            memo[:] = [head, (model, _design(gram, model)[1] if model.ok else None)]
        model, inverse = memo[1]
        if not model.ok:
            return None
        try:
            scores, _ = _scores(values, model, inverse, hc3=True)
        except ContractError:
            return np.full((2 * len(inverse)) ** 2, np.nan)
        return (scores.T @ scores).ravel()

    return add


def _day_scores(estimator: str, controls: tuple[str, ...]) -> Callable[[np.ndarray, np.ndarray], np.ndarray | None]:
    """Number of days and products of day scores, from day grams: scores are linear in them."""

    def add(head: np.ndarray, values: np.ndarray) -> np.ndarray | None:
        gram = Gram(head, controls)
        model = fit_from_gram(gram, estimator)
        if not model.ok:
            return None
        _, inverse, _ = _design(gram, model)
        size, k = gram.matrix.shape[0], len(controls)
        days = values[:, 1:].reshape(len(values), size, size)
        residual = np.zeros((size, 2))  # what multiplies (1, prices, controls, shares) in a residual
        residual[0], residual[1:3], residual[3 : 3 + k] = -model.intercept, -model.theta.T, -model.coefficients.T
        residual[gram.index("y0", "y1"), [0, 1]] = 1.0
        order = [*gram.index(*[f"t{i}" for i in model.active]), *gram.index("1", *controls)]
        moments = (days @ residual)[:, order]
        if model.basis is not None:
            a = len(model.active)
            moments = np.concatenate([np.einsum("ij,njk->nik", model.basis.T, moments[:, :a]), moments[:, a:]], axis=1)
        scores = np.einsum("ij,njk->nki", inverse, moments).reshape(len(values), -1)
        return np.r_[float(len(values)), (scores.T @ scores).ravel()]

    return add


def keyed_covariance(
    df: DataFrame, controls: Sequence[str], by: Sequence[str], method: str = "hc3", estimator: str = "adjusted_ols",
    day: str = "day_id", cell: Sequence[str] = ("zone_id", "hr"), fold: str = "fold",
) -> DataFrame:
    """One row per key: status, reason, standard errors of the four effects, degrees, method and the whole covariance.

    `method` is "hc3" or "day_cr1" (regressions) or "score" (double machine learning with cell means). The covariance
    is that of (effects of varying prices, intercept, controls) for X, then Y, flattened. Standard errors are NULL for a
    price that does not vary.
    """
    if method not in METHODS:
        raise ContractError(f"unknown covariance {method!r}; one of {', '.join(METHODS)}")
    if method != "score":
        check_estimator(estimator)
    by, controls = list(by), tuple(controls)
    grams = weighted_gram(df, controls, by)
    if method == "score":
        grams = null_safe_join(grams, residual_sums(df, by, cell, fold), by, "left")
        none = F.array_repeat(F.lit(0.0), 12)  # no cell of the key is in two folds
        grams = grams.select(*by, F.concat(F.coalesce("m", none), "g").alias("g"))
        table = residualize(df, list(dict.fromkeys([*by, *cell])), fold)
        columns = [*design_columns(controls), *RESIDUALS]
        add = lambda head, values: _score_blocks(head, values, controls)
    elif method == "hc3":
        table, columns, add = df, design_columns(controls), _row_scores(estimator, controls)
    if method == "day_cr1":
        rows, add = weighted_gram(df, controls, [*by, day]).select(*by, F.col("g").alias("v")), _day_scores(estimator, controls)
    else:
        nan = F.lit(float("nan"))
        rows = table.select(*by, F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in columns]).alias("v"))
    sums = sums_beside_heads(grams.select(*by, F.col("g").alias("v")), rows, by, add).withColumnRenamed("g", "s")
    both = null_safe_join(grams, sums, by, "left")
    schema = ", ".join([*kinds(df, by), "status string", "reason string", *[f"{e} double" for e in ERRORS], "degrees int, method string, covariance array<double>"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                out.append((*[row[b] for b in by], *_finished(np.asarray(row["g"]), row["s"], controls, method, estimator)))
            found = pd.DataFrame(out, columns=[*by, "status", "reason", *ERRORS, "degrees", "method", "covariance"])
            yield found.astype({"degrees": "Int32"})

    return both.mapInPandas(finish, schema)


def _parts(head: np.ndarray, controls: tuple[str, ...]) -> tuple[Gram, Model]:
    """Gram and fit of a head that begins with the twelve residual sums."""
    gram = Gram(head[12:], controls)
    return gram, dml_model(gram, head[:12])


def _score_blocks(head: np.ndarray, values: np.ndarray, controls: tuple[str, ...]) -> np.ndarray | None:
    _, model = _parts(head, controls)
    return dml_blocks(values, model) if model.ok else None


def _finished(head: np.ndarray, sums: list | None, controls: tuple[str, ...], method: str, estimator: str) -> tuple:
    failed = lambda reason: ("failed", reason, *[None] * 4, None, METHODS[method], None)
    gram, model = _parts(head, controls) if method == "score" else (Gram(head, controls), fit_from_gram(Gram(head, controls), estimator))
    if not model.ok:
        return failed(model.warnings[0])
    if sums is None:
        return failed("no rows")
    flat, degrees = np.asarray(sums, float), None
    if method == "score":
        try:
            matrix = dml_sandwich(flat, gram, model)
        except ContractError as error:
            return failed(str(error))
    else:
        _, _, rank = _design(gram, model)
        if gram.n <= rank:
            return failed("as many coefficients as rows: no spread is left to estimate")
        degrees = gram.n - rank
        if method == "day_cr1":
            days, flat = int(round(flat[0])), flat[1:]
            if days < 3:
                return failed("day-clustered inference needs at least three days")
            flat = flat * (days / (days - 1) * (gram.n - 1) / (gram.n - rank))
            degrees = days - 1
        if np.isnan(flat).any():
            return failed("leverage-corrected inference needs non-unit leverage")
        size = int(round(np.sqrt(len(flat))))
        matrix = _lift(model, flat.reshape(size, size))
    half, on = len(matrix) // 2, list(model.active)
    errors = [float(np.sqrt(matrix[j * half + on.index(k), j * half + on.index(k)])) if k in on else None for j in range(2) for k in range(2)]
    return ("ok", None, *errors, degrees, METHODS[method], matrix.ravel().tolist())
