"""Headline timings: prints one JSON line.

BENCH_SF_DIR picks the data folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Each query runs once unmeasured on the smallest scale (JIT and code generation), then is timed
to a full no-op write, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from farewise.plans import registry  # noqa: E402
from farewise.session import build_session  # noqa: E402

HEADLINES = {
    "slot_mart": ("B07_suppress_low_n",),
    "context_templates": ("C04_minmax_scale",),
    "quality_report": ("A12_quality_report",),
    "duplicate_trips": ("A13_duplicate_trips",),
    "adjusted_ols": ("E03_fit_adjusted_ols",),
    "dml_cell_means": ("E05_fit_dml",),
    "hc3_covariance": ("E11_hc3_covariance",),
    "delta_intervals": ("E14_delta_intervals",),
    "bootstrap_adjusted": ("F01_day_bootstrap_adjusted",),
    "scenario_metrics": ("G04_scenario_metrics",),
    "scenario_bootstrap": ("G06_bootstrap_scenario",),
    "demand_plan": ("H01_demand_plan",),
    "request_lifecycle": ("I01_request_lifecycle",),
    "window_summary": ("I03_window_summary",),
    "state_hours": ("I06_state_hours",),
    "rank_candidates": ("I10_rank_candidates",),
    "double_bookings": ("I11_double_bookings",),
    "driver_income": ("J07_driver_income",),
    "welch_contrast": ("K03_welch_contrast",),
    "policy_summary": ("L03_policy_summary",),
    "decide": ("L04_decide",),
    "paired_effect": ("M04_paired_effect",),
    "method_evaluation": ("N03_aggregate_metrics",),
    "coverage_tests": ("N09_coverage_tests",),
    "choice_model": ("O05_fit_mnl",),
    "stream_slot_mart": ("Q01_stream_slot_mart",),
}


def run(spark, names, folder: str) -> float:
    began = time.perf_counter()
    for name in names:
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def trip_build(spark, folder: str) -> float:
    """Silver, slot mart and context templates from the raw trips, silver stored once."""
    from farewise.operators.build import build_trip_tables
    from farewise.plans import trips
    from farewise.sources import bindings

    began = time.perf_counter()
    built = build_trip_tables(
        bindings.trips(spark, folder), bindings.zones(spark, folder), start=trips.START, end=trips.END,
        train_end=trips.TRAIN_END, zone_ids=trips.ZONES, platforms=trips.PLATFORM_CODES, min_n=trips.MIN_N,
    )
    for table in (built.mart, built.contexts):
        table.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def bootstrap_scaling(spark, folder: str) -> dict[str, float]:
    """Day bootstrap time against the number of draws: one data pass serves all of them."""
    from farewise.operators import resample
    from farewise.plans.choices import CONTROLS, train

    out = {}
    for draws in (20, 199, 1000):
        began = time.perf_counter()
        resample.day_bootstrap(train(spark, folder), CONTROLS, draws).write.format("noop").mode("overwrite").save()
        out[f"bootstrap_adjusted_{draws}_draws"] = round(time.perf_counter() - began, 3)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm = str(pathlib.Path(folder).parent / "sf0.001")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    if pathlib.Path(warm).exists():
        trip_build(spark, warm)
    timings["silver_mart_context"] = round(trip_build(spark, folder), 3)
    for label, names in HEADLINES.items():
        if pathlib.Path(warm).exists():
            run(spark, names, warm)
        timings[label] = round(statistics.median(run(spark, names, folder) for _ in range(repeats)), 3)
    timings |= bootstrap_scaling(spark, folder)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": pathlib.Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
