"""Analytic intervals of forecast metrics, from a model's joint covariance.

Every metric of a scenario is linear in the effects and in the base coefficients, with weights that follow from the
two prices and the mean controls of the scenario's contexts. The contexts leave one row of sums per context set;
after that a batch of requests is a few matrix products, whatever the number of contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.operators.estimate import SPAN_TOLERANCE, WEIGHT, Model
from farewise.operators.inference import Covariance

INTERVALS = "scenario_id string, metric_id string, standard_error double, lower double, upper double, interval_status string"


def control_means(contexts: DataFrame, model: Model) -> DataFrame:
    """(target_context_set, controls): weighted means for each zone's own set and for all contexts.

    Zones are summed first, so all contexts together are a sum of zones. Sets without a positive weight are left out.
    """
    w = F.col(WEIGHT).cast("double")
    names = [f"c{i}" for i in range(len(model.controls))]
    sums = [F.sum(w * F.col(c)).alias(n) for n, c in zip(names, model.controls, strict=True)]
    zones = contexts.groupBy("zone_id").agg(F.sum(w).alias("w"), *sums)
    own = zones.withColumn("target_context_set", F.concat(F.lit("zone_"), F.col("zone_id").cast("string"))).drop("zone_id")
    every = zones.agg(F.sum("w").alias("w"), *[F.sum(n).alias(n) for n in names]).withColumn("target_context_set", F.lit("all"))
    means = F.array(*[F.col(n) / F.col("w") for n in names]).cast("array<double>")
    return own.unionByName(every).filter("w > 0").select("target_context_set", means.alias("controls"))


def _metrics(low: dict[str, np.ndarray], high: dict[str, np.ndarray], n: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(metric_id, constant, weights) of each metric; weights have one row per request."""
    zero = np.zeros(len(n))
    periods = {"baseline": (low, 1.0), "target": (high, 1.0), "delta": ({s: high[s] - low[s] for s in high}, 0.0)}
    for period, (shares, whole) in periods.items():
        scale = 100.0 if period == "delta" else 1.0
        for service, weights in shares.items():
            start = zero + whole if service == "none" else zero
            yield f"probability_{period}_{service}", start * scale, weights * scale
            name = f"expected_non_booking_sessions_{period}" if service == "none" else f"expected_requests_{period}_{service}"
            yield name, start * n, weights * n[:, None]
        yield f"expected_requests_{period}_total", zero, (shares["x"] + shares["y"]) * n[:, None]


def scenario_intervals(
    model: Model, covariance: Covariance, contexts: DataFrame, requests: DataFrame, level: float = 0.95
) -> DataFrame:
    """Interval rows for `forecast`: scenario_id, metric_id, standard_error, lower, upper, interval_status.

    Status is ok or interval_unavailable: a variance that is not finite or clearly negative, or a price direction that
    the model does not identify; bounds are then NULL. Requests whose context set has no contexts have no rows.
    """
    active, matrix = list(model.active), np.asarray(covariance.matrix, float)
    estimates = np.concatenate([[*model.theta[j, active], model.intercept[j], *model.coefficients[j]] for j in range(2)])
    critical, a = covariance.critical(level), len(active)
    # Price directions outside the span of the data have no estimate.
    outside = np.zeros((a, a)) if model.basis is None else np.eye(a) - model.basis @ model.basis.T

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = frame["n_sessions"].to_numpy(float)
            controls = np.array([list(v) for v in frame["controls"]], float).reshape(len(frame), -1)
            shares = []
            for i in (0, 1):
                prices = np.log(frame[[f"multiplier_{s}{i}" for s in "xy"]].to_numpy(float))[:, active]
                own = np.column_stack([prices, np.ones(len(frame)), controls])
                none = np.zeros_like(own)
                shares.append({"x": np.hstack([own, none]), "y": np.hstack([none, own]), "none": np.hstack([-own, -own])})
            parts = []
            for metric, start, weights in _metrics(*shares, n):
                point = start + weights @ estimates
                size = np.einsum("ri,ri->r", weights @ matrix, weights)
                half = len(estimates) // 2
                off = np.abs(np.hstack([weights[:, :a] @ outside, weights[:, half : half + a] @ outside])).max(axis=1, initial=0.0)
                reach = np.maximum(1.0, np.abs(weights).max(axis=1))
                good = np.isfinite(point) & np.isfinite(size) & (size >= -1e-12 * reach**2) & (off <= SPAN_TOLERANCE * reach)
                error = np.where(good, np.sqrt(np.maximum(np.where(good, size, 0.0), 0.0)), np.nan)
                parts.append(
                    pd.DataFrame(
                        {
                            "scenario_id": frame["scenario_id"], "metric_id": metric, "standard_error": error,
                            "lower": point - critical * error, "upper": point + critical * error,
                            "interval_status": np.where(good, "ok", "interval_unavailable"),
                        }
                    )
                )
            out = pd.concat(parts)
            for c in ("standard_error", "lower", "upper"):
                out[c] = out[c].astype(object).where(out[c].notna(), None)
            yield out

    prices = [f"multiplier_{s}{i}" for i in (0, 1) for s in "xy"]
    asked = requests.join(control_means(contexts, model), "target_context_set")
    return asked.select("scenario_id", *prices, "n_sessions", "controls").mapInPandas(run, INTERVALS)
