"""Registered queries: streaming twins, each run to completion on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.operators import quality
from farewise.plans.catalogue import query, shown, sql_shown
from farewise.plans.operations import INTERVALS, LIFE, _FARES, fares, fleet
from farewise.plans.trips import END, MINUTES, PLATFORM_CODES, START, ZONES, _B_COUNTS, _CELL, _COUNT_KINDS, _KEY_KINDS, on_silver, on_trips
from farewise.sources import bindings
from farewise.sources.bindings import with_views
from farewise.streaming import streams


def stream(spark, sf: str, name: str) -> DataFrame:
    # A file stream takes a folder or a pattern; the pattern also matches a table kept as one file.
    pattern = f"{sf}/{name}.parque[t]"
    return streams.read_stream(spark, pattern, spark.read.parquet(f"{sf}/{name}.parquet").schema)


def trip_stream(spark, sf) -> DataFrame:
    return bindings.trips(spark, sf, stream(spark, sf, "lineitem"))


@query("Q01_stream_slot_mart", sql_shown(on_silver(f"SELECT {_CELL}, {_B_COUNTS} FROM silver WHERE slot_start_local + INTERVAL '30 minutes' <= (SELECT MAX(pickup_datetime) FROM silver) - INTERVAL '1 hour' GROUP BY 1, 2, 3"), {**_KEY_KINDS, **_COUNT_KINDS}))
def q01(spark, sf):
    silver = quality.build_silver(
        trip_stream(spark, sf), bindings.zones(spark, sf), start=START, end=END, zone_ids=ZONES,
        platforms=PLATFORM_CODES, slot_minutes=MINUTES,
    )
    return shown(streams.run_to_table(streams.stream_slot_mart(silver, MINUTES), "slots"))


DEADLINE = 5 * 86400


_MARK = "(SELECT MAX(event_ts) FROM request_events) - INTERVAL '1 hour'"


@query("Q02_stream_request_state", sql_shown(with_views(f"""SELECT request_id, service_id, CASE WHEN ended <= due THEN state ELSE 'deadline_passed' END AS state, created_at, pickup_at, CASE WHEN ended <= due THEN ended ELSE due END AS ended_at
FROM (SELECT *, COALESCE(completed_at, canceled_at, expired_at) AS ended, created_at + INTERVAL '5 days' AS due FROM life) WHERE CASE WHEN ended <= due THEN ended ELSE due END < {_MARK}""", "request_events", life=LIFE), {"request_id": "i", "service_id": "", "state": "", "created_at": "t", "pickup_at": "t", "ended_at": "t"}))
def q02(spark, sf):
    events = bindings.request_events(spark, sf, stream(spark, sf, "orders"))
    out = streams.run_to_table(streams.stream_request_state(events, DEADLINE), "requests")
    return shown(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "pickup_at", "ended_at")}))


@query("Q03_stream_ledger", sql_shown(with_views("SELECT request_id, vehicle_id, 'd' || s_suppkey AS driver_id, service_id, event_ts AS completed_at, CASE WHEN s_suppkey IS NOT NULL THEN amount END AS driver_pay, CASE WHEN s_suppkey IS NULL THEN 'unknown_vehicle' WHEN amount IS NULL THEN 'unknown_service' ELSE 'ok' END AS terms_status FROM request_events LEFT JOIN fares USING (service_id) LEFT JOIN supplier ON vehicle_id = s_suppkey WHERE state = 'completed'", "request_events", fares=_FARES), {"request_id": "i", "vehicle_id": "i", "driver_id": "", "service_id": "", "completed_at": "t", "driver_pay": "r", "terms_status": ""}))
def q03(spark, sf):
    events = bindings.request_events(spark, sf, stream(spark, sf, "orders"))
    replayed = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return shown(streams.run_to_table(streams.stream_ledger(replayed, fleet(spark, sf), fares(spark, sf)), "ledger"))


@query("Q04_stream_state_intervals", with_views('SELECT vehicle_id, state, EPOCH_US(start) AS start_us, EPOCH_US("end") AS end_us FROM intervals WHERE "end" < (SELECT MAX(ts) FROM state_changes) - INTERVAL \'1 hour\'', "state_changes", intervals=INTERVALS))
def q04(spark, sf):
    changes = bindings.state_changes(spark, sf, stream(spark, sf, "events"))
    return streams.run_to_table(streams.stream_state_intervals(changes), "intervals")


@query("Q05_stream_quarantine", on_trips("SELECT COUNT(*) FILTER (WHERE pickup_datetime IS NOT NULL) AS usable, COUNT(*) FILTER (WHERE pickup_datetime IS NULL) AS quarantined FROM trips"))
def q05(spark, sf):
    good, bad = streams.stream_quarantine(trip_stream(spark, sf), "trips", "pickup_datetime", 3600)
    tagged = good.select(F.lit(1).alias("ok")).unionAll(bad.select(F.lit(0).alias("ok")))
    return tagged.agg(F.count_if(F.col("ok") == 1).alias("usable"), F.count_if(F.col("ok") == 0).alias("quarantined"))
