import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_estimate import CONTROLS, THETA, ZONES, frame

from farewise.functions.scalars import ntz
from farewise.operators import choice, demand, estimate, policy, resample, scenario

FIELDS = "scenario_id string, target_context_set string, multiplier_x0 double, multiplier_y0 double, multiplier_x1 double, multiplier_y1 double, n_sessions bigint"


@pytest.fixture(scope="module")
def world(spark):
    pdf = frame(11, days=112)
    pdf["slot_start_local"] = pd.to_datetime(pdf.day_id) + pd.to_timedelta(pdf.hr, "h")
    df = spark.createDataFrame(pdf).withColumn("slot_start_local", F.col("slot_start_local").cast("timestamp_ntz"))
    df = choice.encode(df, ZONES).cache()
    return pdf, df, estimate.fit_ols(df, CONTROLS)


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), FIELDS)


def test_metrics_follow_the_true_shares(spark, world):
    pdf, df, model = world
    out = scenario.scenario_metrics(model, df, ask(spark, ("up", "zone_1", 1.0, 1.0, 1.1, 1.0, 1000)))
    got = {r["metric_id"]: r["estimate"] for r in out.collect()}
    zone = pdf[pdf.zone_id == 1]
    base = np.average(zone.b_x, weights=zone.n_sessions)
    assert got["probability_baseline_x"] == pytest.approx(base, abs=1e-7)
    assert got["expected_requests_delta_x"] == pytest.approx(1000 * THETA[0, 0] * np.log(1.1), abs=1e-4)
    assert got["expected_requests_delta_total"] == pytest.approx(-got["expected_non_booking_sessions_delta"], abs=1e-6)
    assert len(got) == 21


def test_one_bad_context_withholds_every_estimate(spark, world):
    _, df, model = world
    out = scenario.scenario_metrics(model, df, ask(spark, ("huge", "all", 1.0, 1.0, 0.2, 0.2, 10)))
    assert out.filter("estimate is not null or probability_valid").count() == 0
    shares = estimate.predict_choice(df, model, F.lit(np.log(0.2)), F.lit(np.log(0.2)))
    assert {r["rule"]: r["violations"] for r in estimate.simplex_violations(shares).collect()}["outside_unit"] > 0


def test_support_statuses(spark, world):
    _, df, _ = world
    thin = df.filter("not (zone_id = 2 and is_peak = 1 and multiplier_x > 1.05)")
    asked = ask(
        spark, ("ok", "zone_1", 1.0, 1.0, 1.1, 1.0, 1), ("thin", "zone_2", 1.0, 1.0, 1.1, 1.0, 1),
        ("far", "all", 1.0, 1.0, 1.3, 1.0, 1), ("between", "zone_0", 0.95, 1.0, 1.05, 1.0, 1),
    )
    support = {(r["scenario_id"], r["point"]): r for r in scenario.joint_support(thin, df, asked, 1).collect()}
    assert support[("ok", "target")]["support_status"] == "ok" and support[("ok", "target")]["reasons"] == []
    assert support[("thin", "target")]["support_status"] == "insufficient_support"
    assert support[("thin", "target")]["n_reasons"] == len(support[("thin", "target")]["reasons"]) == 2
    assert support[("thin", "baseline")]["support_status"] == "ok"
    assert support[("far", "target")]["support_status"] == "out_of_support"
    assert support[("between", "baseline")]["support_status"] == "ok"


def test_status_precedence(spark):
    rows = [
        (False, False, "out_of_support", "ok", "ok", "not_identified"),
        (True, False, "out_of_support", "ok", "ok", "out_of_support"),
        (True, False, "insufficient_support", "insufficient_support", "ok", "insufficient_support"),
        (True, False, "ok", "insufficient_support", "ok", "invalid_probability"),
        (True, True, "insufficient_support", "ok", "ok", "insufficient_support"),
        (True, True, "ok", "ok", "interval_unstable", "interval_unstable"),
        (True, True, "ok", "ok", "ok", "ok"),
    ]
    df = spark.createDataFrame(rows, "i boolean, v boolean, b string, t string, w string, expected string")
    status = scenario.scenario_status(F.col("i"), F.col("v"), F.col("b"), F.col("t"), F.col("w"))
    assert df.filter(status != F.col("expected")).count() == 0


def test_points_are_withheld_one_by_one(spark, world):
    _, df, model = world
    thin = df.filter("not (zone_id = 2 and is_peak = 1 and multiplier_x > 1.05)")
    asked = ask(spark, ("thin", "zone_2", 1.0, 1.0, 1.1, 1.0, 50))
    gates = scenario.scenario_gates(model, df, asked, scenario.joint_support(thin, df, asked, 1))
    draws = resample.day_bootstrap(df, CONTROLS, 25)
    intervals = scenario.bootstrap_scenario(df, CONTROLS, draws, asked, 25, minimum=20)
    out = {r["metric_id"]: r for r in scenario.forecast(scenario.scenario_metrics(model, df, asked), gates, intervals).collect()}
    kept, gone = out["probability_baseline_x"], out["probability_target_x"]
    assert kept["status"] == "ok" and kept["lower"] <= kept["estimate"] + 1e-9 and kept["upper"] >= kept["estimate"] - 1e-9
    assert gone["estimate"] is None and gone["status"] == "insufficient_support" and gone["lower"] is None
    assert out["probability_delta_x"]["estimate"] is None and kept["scenario_status"] == "insufficient_support"


def test_failed_draws_make_intervals_unstable(spark, world):
    _, df, _ = world
    asked = ask(spark, ("up", "all", 1.0, 1.0, 1.1, 1.0, 10))
    draws = resample.day_bootstrap(df, CONTROLS, 20)
    broken = draws.withColumn("status", F.when(F.col("draw_id") < 5, "failed").otherwise(F.col("status")))
    row = scenario.bootstrap_scenario(df, CONTROLS, broken, asked, 20, minimum=10).first()
    assert row["interval_status"] == "interval_unstable" and row["lower"] is None and row["valid_draws"] == 15


def test_clock_changes_are_flagged(spark):
    times = ["2024-03-10 01:30:00", "2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-11-03 03:00:00", "2024-07-01 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("slot_start_local"))
    got = [r["clock_unclear"] for r in scenario.with_utc(df, "America/New_York", 60).orderBy("slot_start_local").collect()]
    assert got == [False, True, False, True, False]


def test_plan_tiles_reconciles_and_closes_its_gates(spark, world):
    _, df, model = world
    start = F.col("slot_start_local")
    blocks = df.withColumns({"block_start": start, "block_end": F.timestamp_add("HOUR", F.lit(3), start)})
    tiles = demand.tile_violations(blocks, ntz("2024-01-02 00:00:00"), ntz("2024-01-05 00:00:00")).collect()
    assert len(tiles) == 3 and all(r["tiles"] for r in tiles)
    request = dict(zip(["scenario_id", "target_context_set", "multiplier_x0", "multiplier_y0", "multiplier_x1", "multiplier_y1", "n_sessions"], ("up", "all", 1.0, 1.0, 1.1, 1.0, 1)))
    asked = ask(spark, tuple(request.values()))
    gates = scenario.scenario_gates(model, df, asked, scenario.joint_support(df, df, asked, 0))
    plan = demand.demand_plan(model, blocks, gates, request)
    assert plan.count() == 2 * blocks.count()
    assert all(r["violations"] == 0 for r in demand.plan_reconciliation(plan).collect())
    closed = demand.demand_plan(model, blocks, gates.withColumn("target_support", F.lit("insufficient_support")), request)
    assert closed.filter("expected_bookings is not null or request_rate is not null").count() == 0
    assert closed.first()["status"] == "insufficient_support"


def test_plans_of_a_request_table_equal_one_plan_at_a_time(spark, world):
    _, df, model = world
    start = F.col("slot_start_local")
    blocks = df.withColumns({"block_start": start, "block_end": F.timestamp_add("HOUR", F.lit(3), start)})
    asked = ask(spark, ("up", "all", 1.0, 1.0, 1.1, 1.0, 1), ("own", "zone_1", 1.1, 1.0, 0.9, 1.05, 1), ("far", "zone_2", 1.0, 1.0, 1.3, 1.0, 1), ("none", "zone_9", 1.0, 1.0, 1.1, 1.0, 1))
    gates = scenario.scenario_gates(model, df, asked, scenario.joint_support(df, df, asked, 0))
    plans = demand.demand_plans(model, blocks, gates, asked).cache()
    assert plans.filter("scenario_id = 'none'").count() == 0
    for r in asked.filter("scenario_id != 'none'").collect():
        own = blocks if r.target_context_set == "all" else blocks.filter(F.concat(F.lit("zone_"), "zone_id") == r.target_context_set)
        want = demand.demand_plan(model, own, gates, r.asDict()).toPandas()
        got = plans.filter(F.col("scenario_id") == r.scenario_id).drop("scenario_id").toPandas()[list(want.columns)]
        order = ["zone_id", "block_start", "service_id"]
        pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True), check_dtype=False)
    assert {r.status for r in plans.filter("scenario_id = 'far'").select("status").collect()} == {"out_of_support"}
    lost = demand.demand_plans(model, blocks, gates.filter("scenario_id != 'up'"), asked).filter("scenario_id = 'up'")
    assert lost.filter("status is null and expected_bookings is null").count() == 2 * blocks.count()


def test_action_values_equal_a_context_by_context_sum(spark, world):
    pdf, df, model = world
    values = {(r["multiplier_x"], r["multiplier_y"]): r for r in policy.model_action_values(df, model).collect()}
    for action in ((1.0, 1.0), (0.9, 1.1)):
        t = np.log(action)
        px, py = pdf.b_x + THETA[0] @ t, pdf.b_y + THETA[1] @ t
        expected = 1000 * np.average(px * action[0] + py * action[1], weights=pdf.n_sessions)
        assert values[action]["value"] == pytest.approx(expected, abs=1e-4)


def test_ties_take_the_declared_order(spark):
    rows = [(2, 1.1, 1.0, 5.0), (1, 0.9, 0.9, 5.0 + 1e-12), (0, 1.0, 1.0, 4.0), (3, 1.1, 1.1, None)]
    df = spark.createDataFrame(rows, "action int, multiplier_x double, multiplier_y double, value double")
    assert policy.best_action(df).first()["action"] == 1
