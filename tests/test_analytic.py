import numpy as np
import pytest
from pyspark.sql import functions as F
from test_estimate import CONTROLS, ZONES, frame
from test_scenario import ask

from farewise.operators import analytic, choice, estimate, inference, scenario

PERIODS = {"before": "baseline", "after": "target", "delta": "delta"}


@pytest.fixture(scope="module")
def fitted(spark):
    pdf = frame(3, 0.05, days=28)
    df = choice.encode(spark.createDataFrame(pdf), ZONES).cache()
    gram, active, constants = estimate.collect_gram(df, CONTROLS)
    model = estimate.fit_from_gram(gram, "adjusted_ols", active, constants)
    return df, model, inference.hc3_covariance(df, model, gram)


def by_metric(rows):
    return {(r["scenario_id"], r["metric_id"]): r for r in rows.collect()}


def test_intervals_equal_the_delta_method_of_each_context_set(spark, fitted):
    df, model, covariance = fitted
    asked = ask(spark, ("a", "all", 1.0, 1.0, 1.1, 1.0, 100), ("z", "zone_2", 1.1, 0.9, 0.9, 1.0, 7), ("none", "zone_9", 1.0, 1.0, 1.1, 1.0, 3))
    got = by_metric(analytic.scenario_intervals(model, covariance, df, asked))
    assert len(got) == 42 and {k[0] for k in got} == {"a", "z"}
    for name, contexts in (("a", df), ("z", df.filter("zone_id = 2"))):
        controls, _ = inference.mean_controls(contexts, model)
        checked = 0
        for r in inference.delta_intervals(asked.filter(F.col("scenario_id") == name), model, covariance, controls).collect():
            kind, service = r["metric"], r["outcome"].lower()
            period = PERIODS.get(kind.split("_")[0])
            if "probability" in kind or "percentage" in kind:
                metric = f"probability_{period}_{service}"
            elif "choices" in kind:
                metric = f"expected_non_booking_sessions_{period}" if service == "none" else f"expected_requests_{period}_{service}"
            elif "bookings" in kind:
                metric = f"expected_requests_{period}_total"
            else:
                continue
            row, checked = got[name, metric], checked + 1
            np.testing.assert_allclose([row["standard_error"], row["lower"], row["upper"]], [r["standard_error"], r["lower"], r["upper"]], rtol=1e-7, atol=1e-10)
        assert checked == 21


def test_forecasts_carry_analytic_intervals(spark, fitted):
    df, model, covariance = fitted
    asked = ask(spark, ("up", "all", 1.0, 1.0, 1.1, 1.0, 50))
    gates = scenario.scenario_gates(model, df, asked, scenario.joint_support(df, df, asked, 0))
    metrics = scenario.scenario_metrics(model, df, asked)
    out = by_metric(scenario.forecast(metrics, gates, analytic.scenario_intervals(model, covariance, df, asked)))
    assert len(out) == 21
    for r in out.values():
        assert r["scenario_status"] == r["interval_status"] == "ok" and r["lower"] <= r["estimate"] <= r["upper"]
        assert (r["lower"] + r["upper"]) / 2 == pytest.approx(r["estimate"], abs=1e-7)
    broken = inference.Covariance(np.full_like(covariance.matrix, np.nan), "hc3", 10)
    lost = by_metric(scenario.forecast(metrics, gates, analytic.scenario_intervals(model, broken, df, asked)))
    assert all(r["interval_status"] == "interval_unavailable" and r["lower"] is None and r["estimate"] is not None for r in lost.values())


def test_directions_outside_the_span_have_no_interval(spark, fitted):
    df, _, _ = fitted
    line = df.withColumn("log_multiplier_y", F.col("log_multiplier_x") * 0.5)
    gram, active, constants = estimate.collect_gram(line, CONTROLS)
    model = estimate.fit_from_gram(gram, "contrast_ols", active, constants)
    covariance = inference.hc3_covariance(line, model, gram)
    asked = ask(spark, ("on", "all", 1.0, 1.0, 1.1, 1.1**0.5, 1), ("off", "all", 1.0, 1.0, 1.1, 1.1, 1))
    got = by_metric(analytic.scenario_intervals(model, covariance, line, asked))
    assert got["on", "probability_delta_x"]["interval_status"] == "ok"
    assert got["off", "probability_delta_x"]["interval_status"] == "interval_unavailable" and got["off", "probability_delta_x"]["lower"] is None
    assert got["off", "probability_baseline_x"]["interval_status"] == "ok"
