import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from farewise.functions.scalars import ntz
from farewise.operators import earnings, experiment, ops, supply

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


EVENTS = [
    ("r1", "X", 0, "created", 1, None), ("r1", "X", 2, "assigned", 3, "v1"), ("r1", "X", 10, "on_trip", 4, "v1"), ("r1", "X", 40, "completed", 5, "v1"),
    ("r2", "Y", 5, "created", 1, None), ("r2", "Y", 25, "canceled", 6, None),
    ("r3", "X", 30, "created", 1, None), ("r3", "X", 31, "assigned", 3, "v2"), ("r3", "X", 45, "on_trip", 4, "v2"), ("r3", "X", 75, "completed", 5, "v2"),
    ("r4", "Y", 50, "created", 1, None),
]


@pytest.fixture(scope="module")
def events(spark):
    rows = [(r, s, at(m), state, step, v) for r, s, m, state, step, v in EVENTS]
    df = spark.createDataFrame(rows, "request_id string, service_id string, event_ts timestamp_ntz, state string, step int, vehicle_id string")
    return df.cache()


def window(a, b):
    return ntz(str(at(a))), ntz(str(at(b)))


def test_waits_are_censored_or_stopped(events):
    got = {r["request_id"]: r for r in ops.wait_measures(ops.request_lifecycle(events), ntz(str(at(90)))).collect()}
    assert got["r1"]["wait_seconds"] == 600 and got["r1"]["wait_status"] == "picked_up"
    assert got["r2"]["wait_seconds"] is None and got["r2"]["observed_wait_seconds"] == 1200
    assert got["r2"]["wait_status"] == "terminated_before_pickup"
    assert got["r4"]["wait_censored"] and got["r4"]["observed_wait_seconds"] == 2400


def test_split_windows_add_up_to_the_whole(events):
    parts = [ops.window_summary(events, *window(a, b)).first() for a, b in ((0, 30), (30, 90))]
    whole = ops.window_summary(events, *window(0, 90)).first()
    for c in ("created_in_window", "completed_in_window", "canceled_in_window", "expired_in_window", "n_pickups"):
        assert parts[0][c] + parts[1][c] == whole[c]
    assert parts[0]["open_end"] == parts[1]["open_start"] == 1 and whole["open_end"] == parts[1]["open_end"] == 1
    assert whole["mean_wait_seconds"] == pytest.approx(750) and whole["p95_wait_seconds"] == pytest.approx(885)
    assert ops.conservation(events, *window(30, 90)).first()["conserved"]


def test_carry_in_is_marked_once(events):
    marked = {r["request_id"]: (r["created_in_window"], r["carry_in"]) for r in ops.window_membership(ops.request_lifecycle(events), *window(30, 90)).collect()}
    assert marked == {"r1": (False, True), "r2": (False, False), "r3": (True, False), "r4": (True, False)}


def test_intervals_tile_and_drop_zero_lengths(spark):
    rows = [(1, 1, at(0), "idle"), (1, 2, at(10), "dispatch"), (1, 3, at(10), "to_pickup"), (1, 4, at(60 * 30), "offline"), (2, 5, at(5), "idle")]
    changes = spark.createDataFrame(rows, "vehicle_id bigint, event_id bigint, ts timestamp_ntz, state string")
    end = ntz(str(at(60 * 48)))
    intervals = ops.state_intervals(changes, end)
    got = {(r["vehicle_id"], r["state"]): r["duration_hours"] for r in intervals.collect()}
    assert got == {(1, "idle"): pytest.approx(1 / 6), (1, "to_pickup"): pytest.approx(30 - 1 / 6), (1, "offline"): 18.0, (2, "idle"): pytest.approx(48 - 1 / 12)}
    gaps = {r["vehicle_id"]: r for r in ops.interval_gaps(intervals, ntz(str(DAY)), end).collect()}
    assert gaps[1]["gaps"] == gaps[1]["overlaps"] == 0 and gaps[1]["starts_on_window"] and not gaps[2]["starts_on_window"]
    hours = {r["vehicle_id"]: r for r in ops.state_hours(intervals).collect()}
    assert hours[1]["total_hours"] == pytest.approx(48) and hours[1]["serviceable_hours"] == pytest.approx(30)


def test_candidates_equal_brute_force_even_for_a_request_that_tried_many(spark):
    rng = np.random.default_rng(8)
    requests = pd.DataFrame({"request_id": range(60), "service_id": rng.choice(["X", "Y"], 60), "origin_zone_id": np.where(rng.random(60) < 0.5, 0, rng.integers(0, 5, 60))})
    vehicles = pd.DataFrame({"vehicle_id": range(90), "zone_id": rng.integers(0, 5, 90), "eligible_services": [["X"], ["Y"], ["X", "Y"]] * 30, "state": rng.choice(["idle", "on_trip"], 90, p=[0.8, 0.2])})
    od = pd.DataFrame([(a, b, 100.0 * abs(a - b) + 50) for a in range(5) for b in range(5)], columns=["origin_zone_id", "destination_zone_id", "pickup_seconds"])
    tried = pd.DataFrame({"request_id": np.r_[np.zeros(60, int), rng.integers(0, 60, 100)], "vehicle_id": np.r_[np.arange(60), rng.integers(0, 90, 100)]})
    got = ops.rank_candidates(*(spark.createDataFrame(f) for f in (requests, vehicles, od, tried)), 300, 4).toPandas()
    seen = set(map(tuple, tried.to_numpy()))
    expected = set()
    for r in requests.itertuples():
        options = sorted(
            (100.0 * abs(v.zone_id - r.origin_zone_id) + 50, v.vehicle_id)
            for v in vehicles.itertuples()
            if v.state == "idle" and r.service_id in v.eligible_services and (r.request_id, v.vehicle_id) not in seen and 100.0 * abs(v.zone_id - r.origin_zone_id) + 50 <= 300
        )
        expected |= {(r.request_id, v, eta, i + 1) for i, (eta, v) in enumerate(options[:4])}
    assert set(got[["request_id", "vehicle_id", "pickup_seconds", "candidate_rank"]].itertuples(index=False, name=None)) == expected
    capped = ops.rank_candidates(*(spark.createDataFrame(f) for f in (requests, vehicles, od, tried)), 300, 4, max_attempts=10)
    assert capped.filter("request_id = 0").count() == 0


def test_tried_vehicles_off_the_list_are_not_carried_along(spark):
    vehicles = spark.range(2000).select(F.col("id").alias("vehicle_id"), (F.col("id") % 2).alias("zone_id"), F.array(F.lit("X")).alias("eligible_services"), F.lit("idle").alias("state"))
    requests = spark.range(3000).select(F.col("id").alias("request_id"), F.lit("X").alias("service_id"), (F.col("id") % 2).alias("origin_zone_id"))
    od = spark.createDataFrame([(a, b, 50.0 if a == b else 1000.0) for a in (0, 1) for b in (0, 1)], "origin_zone_id bigint, destination_zone_id bigint, pickup_seconds double")
    far = spark.range(180_000).select((F.col("id") % 3000).alias("request_id"), (1000 + F.xxhash64("id") % 500 + 500).alias("vehicle_id"))
    tried = far.unionByName(spark.createDataFrame([(0, 0), (0, 4), (0, 4), (0, 10), (2, 2)], far.schema))
    written = lambda: sum(e.totalShuffleWrite() for e in _executors(spark))
    start = written()
    got = {(r["request_id"], r["candidate_rank"]): r["vehicle_id"] for r in ops.rank_candidates(requests, vehicles, od, tried, 300, 3).collect()}
    assert written() - start < 500_000
    first = {0: [2, 6, 8], 2: [0, 4, 6]}
    assert got == {(r, i + 1): v for r in range(3000) for i, v in enumerate(first.get(r, [r % 2, r % 2 + 2, r % 2 + 4]))}


def _executors(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return [found.apply(i) for i in range(found.size())]


def test_each_tried_rank_moves_the_candidates_on(spark):
    """All patterns of tried ranks around the first list's end, against the plain way."""
    n, k = ops.RANK_PREFIX + 12, 3
    vehicles = spark.range(n).select(F.col("id").alias("vehicle_id"), F.lit(0).cast("bigint").alias("zone_id"), F.array(F.lit("X")).alias("eligible_services"), F.lit("idle").alias("state"))
    od = spark.createDataFrame([(0, 0, 50.0)], "origin_zone_id bigint, destination_zone_id bigint, pickup_seconds double")
    skipped = {r: set(range(r % 4, n if r > n else r, 1 + r % 3)) for r in range(n + 8)}
    requests = spark.createDataFrame([(r, "X", 0) for r in skipped], "request_id bigint, service_id string, origin_zone_id bigint")
    for kept in (range(20), skipped):
        tried = spark.createDataFrame([(r, v) for r in kept for v in skipped[r]], "request_id bigint, vehicle_id bigint")
        got = {(r["request_id"], r["candidate_rank"]): r["vehicle_id"] for r in ops.rank_candidates(requests, vehicles, od, tried, 300, k).collect()}
        expected = {(r, i + 1): v for r in skipped for i, v in enumerate([v for v in range(n) if r not in kept or v not in skipped[r]][:k])}
        assert got == expected


def test_overlaps_and_repeats_among_offers(spark):
    rows = [("a", 1, 7, at(0), 600, "accepted"), ("b", 2, 7, at(5), 60, "accepted"), ("c", 3, 7, at(11), 60, "accepted"), ("d", 1, 8, at(1), 60, "rejected"), ("e", 1, 7, at(60 * 24), 1, "rejected")]
    offers = spark.createDataFrame(rows, "offer_key string, request_id int, vehicle_id int, offered_at timestamp_ntz, response_seconds int, state string")
    assert {r["check"]: r["violations"] for r in ops.double_bookings(offers).collect()} == {"overlap_vehicle_id": 1, "overlap_request_id": 0, "repeated_pair": 1}
    summary = ops.offer_summary(offers).first()
    assert summary["acceptance_rate"] == pytest.approx(3 / 5) and summary["pending"] == 0


@pytest.fixture(scope="module")
def books(spark):
    roster = spark.createDataFrame([(f"v{i}", f"d{i}", f"s{i}") for i in (1, 2, 3)], "vehicle_id string, driver_id string, shift_id string")
    tariff = spark.createDataFrame([("X", 10.0), ("Y", 8.0)], "service_id string, baseline_fare double")
    rule = spark.createDataFrame([("X", 1.0, 0.1), ("Y", 1.0, 0.0)], "service_id string, baseline_multiplier double, delta_price double")
    return roster, earnings.effective_fares(tariff, rule)


def test_each_window_pays_its_own_completions_once(events, books, rows):
    roster, fares = books
    settle = lambda a, b: earnings.settle_ledger(events, roster, fares, *window(a, b))
    first, second = settle(0, 41), settle(41, 90)
    assert [(r["request_id"], r["driver_pay"]) for r in first.collect()] == [("r1", pytest.approx(11.0))]
    assert rows(first.unionByName(second)) == rows(settle(0, 90))


def test_drivers_without_trips_or_hours_stay_in_the_income_table(spark, events, books):
    roster, fares = books
    ledger = earnings.settle_ledger(events, roster, fares, *window(0, 90))
    rows = [("v1", "on_trip", at(0), at(60), 1.0), ("v1", "offline", at(60), at(90), 0.5), ("v3", "idle", at(0), at(90), 1.5)]
    intervals = spark.createDataFrame(rows, "vehicle_id string, state string, start timestamp_ntz, end timestamp_ntz, duration_hours double")
    income = {r["vehicle_id"]: r for r in earnings.driver_income(roster, ledger, earnings.presence_hours(intervals)).collect()}
    assert income["v1"]["pay_per_presence_hour"] == pytest.approx(11.0)
    assert income["v2"]["income_rate_status"] == "unavailable_zero_presence" and income["v2"]["pay_per_presence_hour"] is None
    assert income["v3"]["completed_trips"] == 0 and income["v3"]["pay_per_presence_hour"] == 0


def test_settlement_problems_are_counted(events):
    life = ops.request_lifecycle(events)
    clean = {r["check"]: r["violations"] for r in earnings.settlement_violations(events, life).collect()}
    assert not any(clean.values())
    twice = events.unionByName(events.filter("state = 'completed' and request_id = 'r1'"))
    assert {r["check"]: r["violations"] for r in earnings.settlement_violations(twice, life).collect()}["duplicate_completion"] == 1


def cohort(spark, change=None):
    rows = [(d, DAY.date() + dt.timedelta(s), 0.0 if d % 2 else 20.0, 1, 4.0 + d % 3, 3.0) for d in range(8) for s in range(3)]
    df = spark.createDataFrame(rows, "driver_id bigint, day_id date, incentive double, participated int, worked_hours double, serviceable_hours double")
    return df if change is None else change(df)


@pytest.mark.parametrize(
    "change,rule",
    [
        (lambda df: df.filter("not (driver_id = 1 and day_id = date'2024-01-01')"), "incomplete_driver"),
        (lambda df: df.withColumn("incentive", F.when(F.col("day_id") == "2024-01-02", 20.0).otherwise(F.col("incentive"))), "arm_changes"),
        (lambda df: df.withColumn("participated", F.lit(0)), "absent_with_hours"),
        (lambda df: df.withColumn("worked_hours", F.lit(9.0)), "hours_out_of_range"),
        (lambda df: df.withColumn("worked_hours", F.lit(float("nan"))), "missing_or_nonfinite"),
        (lambda df: df.withColumn("incentive", F.lit(5.0)), "unknown_incentive"),
        (lambda df: df.unionByName(df.limit(1)), "repeated_shift"),
    ],
)
def test_broken_cohorts_are_reported(spark, change, rule):
    clean = supply.cohort_violations(cohort(spark), 3, 0.0, 20.0, 8.0)
    assert clean.filter("violations > 0").count() == 0
    got = {r["rule"]: r["violations"] for r in supply.cohort_violations(cohort(spark, change), 3, 0.0, 20.0, 8.0).collect()}
    assert got[rule] > 0


def test_repeating_shifts_adds_no_drivers_and_support_gates_effects(spark):
    means = supply.driver_means(cohort(spark))
    more = supply.driver_means(cohort(spark).unionByName(cohort(spark)))
    pick = lambda m, **k: {r["outcome"]: r for r in supply.welch_contrast(m, 0.0, 20.0, **k).collect()}
    a, b = pick(means), pick(more)
    assert a["worked_hours"]["standard_error"] == b["worked_hours"]["standard_error"]
    assert a["serviceable_hours"]["effect"] == 0 and a["serviceable_hours"]["interval_status"] == "interval_unavailable"
    thin = pick(means, min_drivers=5)
    assert thin["worked_hours"]["status"] == "not_identified" and thin["worked_hours"]["effect"] is None and thin["worked_hours"]["n_target"] == 4


def test_switchback_pairs_hold_both_arms_and_washouts(spark):
    clusters = spark.createDataFrame([("a",), ("b",)], "cluster_id string")
    plan = experiment.switchback_schedule(clusters, 20, ntz(str(DAY)), 60, 15, "cand", 3).toPandas()
    assert (plan.groupby("pair_id").arm.nunique() == 2).all() and plan.block_id.is_unique
    one = plan[plan.cluster_id == "a"].sort_values("start")
    assert ((one.start.shift(-1) - one.end).dropna() == pd.Timedelta("15min")).all()
    assert 5 < (plan[plan.block_id.str.endswith("-0")].arm == "control").sum() < 35


def test_missing_block_withholds_the_interval_but_not_the_counts(spark):
    plan = experiment.switchback_schedule(spark.createDataFrame([("a",)], "cluster_id string"), 6, ntz(str(DAY)), 60, 0, "cand", 3)
    seen = plan.select("block_id", F.col("policy_id").alias("applied_policy_id"), F.lit("trips").alias("metric"), F.lit("n").alias("unit"), (F.when(F.col("arm") == "treatment", 3.0).otherwise(1.0) + F.rand(1)).alias("value"))
    seen = spark.createDataFrame(seen.collect(), seen.schema)
    full = experiment.paired_effect(plan, seen, prediction=2.0, mode="AA").first()
    assert full["status"] == "completed" and full["lower"] < full["observed_effect"] < full["upper"] and full["aa_zero_in_interval"] is False
    partial = experiment.paired_effect(plan, seen.filter("block_id <> 'a-0-0'"), prediction=2.0).first()
    assert partial["status"] == "incomplete" and partial["lower"] is None and partial["complete_pairs"] == 5 and partial["forecast_error"] is None
