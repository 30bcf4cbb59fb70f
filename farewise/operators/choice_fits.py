"""Multinomial logits of many keys (datasets, markets, seeds) advanced together.

A step joins the rows with the trial parameters of the keys still open and leaves one row of sums per key; a key
that has converged or failed no longer meets its rows. Parameters are a table in the shared folder, so the number of
keys is not bound by the driver, and a lost executor repeats at most the step at work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.operators.mnl import ALTERNATIVES, PARAMETERS, newton_columns, newton_terms
from farewise.session import scratch_path

KEY = "_fit_key"
HALVINGS = 30
_STATE = (
    f"{KEY} string, status string, n bigint, steps int, halvings int, value double, beta array<double>, "
    "move array<double>, information array<double>"
)


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _advanced(row: dict, k: int, tolerance: float, max_steps: int) -> dict:
    """The state of a key after its trial point has been summed up."""
    sums = np.asarray(row["sums"], float)
    beta, move = np.asarray(row["beta"], float), np.asarray(row["move"], float)
    started = not pd.isna(row["value"])
    worse = started and sums[0] < row["value"] - 1e-9 * abs(row["value"])
    if worse or not np.isfinite(sums).all():
        halvings = row["halvings"] + 1
        return row | {"move": move / 2, "halvings": halvings, "status": "open" if halvings < HALVINGS else "no_improving_step"}
    upper = np.zeros((k, k))
    upper[np.triu_indices(k)] = sums[1 + k :]
    information = upper + np.triu(upper, 1).T
    gradient, n = sums[1 : 1 + k], row["n"]
    out = row | {
        "beta": beta + move, "value": float(sums[0]), "halvings": 0, "steps": row["steps"] + int(started), "information": information.ravel(),
    }
    if np.linalg.matrix_rank(information / n, tol=1e-10) < k:
        return out | {"status": "rank_deficient"}
    if np.abs(gradient).max() / n < tolerance:
        return out | {"status": "ok"}
    if out["steps"] + 1 >= max_steps:
        return out | {"status": "not_converged"}
    return out | {"move": np.linalg.solve(information, gradient)}


def fit_mnl_by(
    df: DataFrame, by: Sequence[str], attributes: bool = True, tolerance: float = 1e-7, max_steps: int = 50
) -> DataFrame:
    """One maximum-likelihood fit per key: by, status, n, steps, log_likelihood, beta, standard_errors.

    Status is ok, missing_alternative (not every alternative was chosen), rank_deficient, no_improving_step or
    not_converged; estimates are NULL unless it is ok. A NULL in a key column is a value of its own. An empty table has
    no keys. Every key takes the steps that a fit of its rows alone would take.
    """
    spark = df.sparkSession
    k = len(PARAMETERS) if attributes else 2
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias(KEY)
    chosen = [F.max((F.col("choice_index") == j).cast("int")) for j in range(ALTERNATIVES)]
    every = F.coalesce(F.least(*chosen), F.lit(0)) == 1
    names, names_at = _stored(
        df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), every.alias("_every")).select(key, *by, "n", "_every"), "choice-keys"
    )
    zeros = F.array(*[F.lit(0.0)] * k)
    state, at = _stored(
        names.select(
            KEY, F.when(F.col("_every"), "open").otherwise("missing_alternative").alias("status"), "n",
            F.lit(0).alias("steps"), F.lit(0).alias("halvings"), F.lit(None).cast("double").alias("value"),
            zeros.alias("beta"), zeros.alias("move"), F.array().cast("array<double>").alias("information"),
        ),
        "choice-fits",
    )
    data = df.select(key, "choice_index", *[f"{p}{j}" for j in range(ALTERNATIVES) for p in ("t", "c", "av")]).persist()

    def advance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r if r["sums"] is None else _advanced(r, k, tolerance, max_steps) for r in frame.to_dict("records")]
            yield pd.DataFrame(rows, columns=frame.columns).drop(columns="sums")

    try:
        while not state.filter("status = 'open'").isEmpty():
            trial = state.filter("status = 'open'").select(KEY, F.zip_with("beta", "move", lambda b, m: b + m).alias("_trial"))
            terms = newton_terms(data.join(trial, KEY), [F.col("_trial")[a] for a in range(k)], KEY)
            sums = terms.groupBy(KEY).agg(F.array(*newton_columns(k)).alias("sums"))
            moved, moved_at = _stored(state.join(sums, KEY, "left").mapInPandas(advance, _STATE), "choice-fits")
            _delete(spark, at)
            state, at = moved, moved_at
    finally:
        data.unpersist()

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            inverse = [np.linalg.inv(np.reshape(v, (k, k))) for v in frame["information"]]
            yield pd.DataFrame({KEY: frame[KEY], "standard_errors": [np.sqrt(np.diag(m)) for m in inverse]}, columns=[KEY, "standard_errors"])

    good = state.filter("status = 'ok'").select(KEY, "information").mapInPandas(errors, f"{KEY} string, standard_errors array<double>")
    fits = state.drop("n").join(good, KEY, "left")
    ok = F.col("status") == "ok"
    return names.join(fits, KEY).select(
        *by, "status", "n", "steps", F.when(ok, F.col("value")).alias("log_likelihood"),
        F.when(ok, F.col("beta")).alias("beta"), "standard_errors",
    )
