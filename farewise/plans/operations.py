"""Registered queries: event accounting, earnings, supply contrasts and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.functions.scalars import ntz
from farewise.operators import earnings, experiment, ops, supply
from farewise.plans.catalogue import query, shown, sql_shown
from farewise.plans.sqlkit import binomial_two_sided, recursive, t_quantiles
from farewise.sources import bindings
from farewise.sources.bindings import with_views

START, END = "2024-01-05 00:00:00", "2024-01-12 00:00:00"
MONTH_START, MONTH_END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
_S, _E = f"TIMESTAMP '{START}'", f"TIMESTAMP '{END}'"
_TQ = recursive(tq=t_quantiles("tq_in"))


def bounds():
    return ntz(START), ntz(END)


def events(spark, sf) -> DataFrame:
    return bindings.request_events(spark, sf)


LIFE = """SELECT request_id, MIN(service_id) AS service_id, MIN(event_ts) FILTER (WHERE state = 'created') AS created_at, MIN(event_ts) FILTER (WHERE state = 'assigned') AS assigned_at,
MIN(event_ts) FILTER (WHERE state = 'on_trip') AS pickup_at, MIN(event_ts) FILTER (WHERE state = 'completed') AS completed_at, MIN(event_ts) FILTER (WHERE state = 'canceled') AS canceled_at,
MIN(event_ts) FILTER (WHERE state = 'expired') AS expired_at, ARG_MAX(state, event_ts) AS state, MAX(vehicle_id) AS vehicle_id FROM request_events GROUP BY 1"""
_LIFE_KINDS = {"request_id": "i", "service_id": "", "state": "", "vehicle_id": "r", **{f"{s}_at": "t" for s in ("created", "assigned", "pickup", "completed", "canceled", "expired")}}
WAITS = f"""SELECT *, DATE_DIFF('microsecond', created_at, pickup_at) / 1e6 AS wait_seconds, DATE_DIFF('microsecond', created_at, COALESCE(pickup_at, canceled_at, expired_at, {_E})) / 1e6 AS observed_wait_seconds,
CASE WHEN pickup_at IS NOT NULL THEN 'picked_up' WHEN state IN ('created', 'queued', 'assigned', 'on_trip') THEN 'open_censored' ELSE 'terminated_before_pickup' END AS wait_status FROM life"""


def on_requests(body: str, **extra: str) -> str:
    return with_views(body, "request_events", life=LIFE, waits=WAITS, **extra)


# --- requests -----------------------------------------------------------------------------

@query("I01_request_lifecycle", sql_shown(on_requests("SELECT * FROM life"), _LIFE_KINDS))
def i01(spark, sf):
    out = ops.request_lifecycle(events(spark, sf))
    return shown(out.withColumn("vehicle_id", F.col("vehicle_id").cast("double")))


@query("I02_wait_measures", sql_shown(on_requests("SELECT request_id, wait_seconds, observed_wait_seconds, wait_status, wait_status = 'open_censored' AS wait_censored FROM waits"), {"request_id": "i", "wait_seconds": "r", "observed_wait_seconds": "r", "wait_status": "", "wait_censored": ""}))
def i02(spark, sf):
    out = ops.wait_measures(ops.request_lifecycle(events(spark, sf)), ntz(END))
    return shown(out.select("request_id", "wait_seconds", "observed_wait_seconds", "wait_status", "wait_censored"))


def _flow(start: str, end: str) -> str:
    inside = f"event_ts >= {start} AND event_ts < {end}"
    counts = ", ".join(f"COUNT(*) FILTER (WHERE state = '{s}' AND {inside}) AS {s}_in_window" for s in ("created", *ops.TERMINAL_STATES))
    is_open = lambda t: f"COUNT(*) FILTER (WHERE state = 'created' AND event_ts < {t}) - COUNT(*) FILTER (WHERE state IN ('completed', 'canceled', 'expired') AND event_ts < {t})"
    return f"{counts}, {is_open(start)} AS open_start, {is_open(end)} AS open_end"


_FLOW_KINDS = {**{f"{s}_in_window": "i" for s in ("created", *ops.TERMINAL_STATES)}, "open_start": "i", "open_end": "i"}
_PICKED = f"SELECT COUNT(*) AS n_pickups, AVG(wait_seconds) AS mean_wait_seconds, QUANTILE_CONT(wait_seconds, 0.95) AS p95_wait_seconds FROM waits WHERE pickup_at >= {_S} AND pickup_at < {_E}"
_WINDOW_KINDS = {**_FLOW_KINDS, "n_pickups": "i", "mean_wait_seconds": "r", "p95_wait_seconds": "r"}


@query("I03_window_summary", sql_shown(on_requests(f"SELECT * FROM (SELECT {_flow(_S, _E)} FROM request_events), ({_PICKED})"), _WINDOW_KINDS))
def i03(spark, sf):
    return shown(ops.window_summary(events(spark, sf), *bounds()))


@query("I03_window_summary_split_groups", sql_shown(on_requests(f"SELECT * REPLACE (COALESCE(n_pickups, 0) AS n_pickups) FROM (SELECT service_id, {_flow(_S, _E)} FROM request_events GROUP BY 1) LEFT JOIN ({_PICKED.replace('SELECT COUNT(*)', 'SELECT service_id, COUNT(*)')} GROUP BY 1) USING (service_id)"), {"service_id": "", **_WINDOW_KINDS}))
def i03_split(spark, sf):
    return shown(ops.window_summary(events(spark, sf), *bounds(), ["service_id"]))


@query("I04_service_summary", sql_shown(on_requests(f"SELECT service_id, {_flow(_S, _E)} FROM request_events GROUP BY 1"), {"service_id": "", **_FLOW_KINDS}))
def i04(spark, sf):
    return shown(ops.service_summary(events(spark, sf), *bounds()))


_INTERVALS = f"SELECT vehicle_id, state, ts AS start, COALESCE(LEAD(ts) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id), TIMESTAMP '{MONTH_END}') AS \"end\" FROM state_changes"
INTERVALS = f'SELECT *, DATE_DIFF(\'microsecond\', start, "end") / 3.6e9 AS duration_hours FROM ({_INTERVALS}) WHERE "end" > start'


def on_intervals(body: str, **extra: str) -> str:
    return with_views(body, "state_changes", intervals=INTERVALS, **extra)


def intervals(spark, sf) -> DataFrame:
    return ops.state_intervals(bindings.state_changes(spark, sf), ntz(MONTH_END))


@query("I05_state_intervals", sql_shown(on_intervals("SELECT vehicle_id, state, EPOCH_US(start) AS start_us, EPOCH_US(\"end\") AS end_us, duration_hours FROM intervals"), {"vehicle_id": "i", "state": "", "start_us": "i", "end_us": "i", "duration_hours": "r10"}))
def i05(spark, sf):
    micros = lambda c: F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), F.col(c))
    out = intervals(spark, sf)
    return shown(out.select("vehicle_id", "state", micros("start").alias("start_us"), micros("end").alias("end_us"), "duration_hours"), 10)


_HOURS = ", ".join(f"COALESCE(SUM(duration_hours) FILTER (WHERE state = '{s}'), 0) AS {s}_hours" for s in ops.VEHICLE_STATES) + ", COALESCE(SUM(duration_hours) FILTER (WHERE state IN ('idle', 'dispatch', 'to_pickup', 'on_trip')), 0) AS serviceable_hours, SUM(duration_hours) AS total_hours"


@query("I06_state_hours", sql_shown(on_intervals(f"SELECT vehicle_id, {_HOURS} FROM intervals GROUP BY 1"), {"vehicle_id": "i", **{f"{s}_hours": "r5" for s in ops.VEHICLE_STATES}, "serviceable_hours": "r5", "total_hours": "r5"}))
def i06(spark, sf):
    return shown(ops.state_hours(intervals(spark, sf)), 5)


@query("I07_interval_gaps", sql_shown(on_intervals("""SELECT vehicle_id, COUNT(*) AS n_intervals, MIN(start) = TIMESTAMP '2024-01-01 00:00:00' AS starts_on_window, MAX("end") = TIMESTAMP '2024-01-31 00:00:00' AS ends_on_window, COUNT(*) FILTER (WHERE nx > "end") AS gaps, COUNT(*) FILTER (WHERE nx < "end") AS "overlaps"
FROM (SELECT *, LEAD(start) OVER (PARTITION BY vehicle_id ORDER BY start) AS nx FROM intervals WHERE state <> 'offline') GROUP BY 1"""), {"vehicle_id": "i", "n_intervals": "i", "starts_on_window": "", "ends_on_window": "", "gaps": "i", "overlaps": "i"}))
def i07(spark, sf):
    present = intervals(spark, sf).filter("state <> 'offline'")
    return shown(ops.interval_gaps(present, ntz(MONTH_START), ntz(MONTH_END)))


_OFFERS = "COUNT(*) AS offered, COUNT(*) FILTER (WHERE state = 'accepted') AS accepted, COUNT(*) FILTER (WHERE state = 'rejected') AS rejected, COUNT(*) FILTER (WHERE state = 'timed_out') AS timed_out, COUNT(*) FILTER (WHERE state = 'withdrawn') AS withdrawn, COUNT(*) FILTER (WHERE state = 'offered') AS pending"


@query("I08_offer_summary", sql_shown(with_views(f"SELECT *, accepted + rejected + timed_out AS acceptance_denominator, accepted / NULLIF(accepted + rejected + timed_out, 0)::DOUBLE AS acceptance_rate FROM (SELECT vehicle_id, {_OFFERS} FROM driver_offers GROUP BY 1)", "driver_offers"), {"vehicle_id": "i", **dict.fromkeys(("offered", "accepted", "rejected", "timed_out", "withdrawn", "pending", "acceptance_denominator"), "i"), "acceptance_rate": "r"}))
def i08(spark, sf):
    return shown(ops.offer_summary(bindings.driver_offers(spark, sf), ["vehicle_id"]))


@query("I09_conservation", on_requests(f"SELECT open_start + created_in_window AS opened, completed_in_window + canceled_in_window + expired_in_window AS terminated, oe AS open_end, open_start + created_in_window = completed_in_window + canceled_in_window + expired_in_window + oe AS conserved FROM (SELECT {_flow(_S, _E)} FROM request_events), (SELECT COUNT(*) AS oe FROM life WHERE created_at < {_E} AND COALESCE(COALESCE(completed_at, canceled_at, expired_at) >= {_E}, TRUE))"))
def i09(spark, sf):
    return ops.conservation(events(spark, sf), *bounds())


def resolved_offers(spark, sf) -> DataFrame:
    resolved = F.timestamp_add("SECOND", (F.col("response_seconds") * 3600).cast("int"), F.col("offered_at"))
    return bindings.driver_offers(spark, sf).withColumn("resolved_at", resolved)


@query("I09_offer_conservation", with_views(f"""SELECT COUNT(*) FILTER (WHERE o < {_S} AND r >= {_S}) AS pending_start, COUNT(*) FILTER (WHERE o >= {_S} AND o < {_E}) AS offered, COUNT(*) FILTER (WHERE r >= {_S} AND r < {_E}) AS resolved, COUNT(*) FILTER (WHERE o < {_E} AND r >= {_E}) AS pending_end, TRUE AS conserved
FROM (SELECT offered_at AS o, offered_at + response_seconds * INTERVAL '1' HOUR AS r FROM driver_offers)""", "driver_offers"))
def i09_offers(spark, sf):
    return ops.offer_conservation(resolved_offers(spark, sf), *bounds())


def fleet(spark, sf) -> DataFrame:
    key = F.col("s_suppkey")
    services = F.when(key % 3 == 0, F.array(F.lit("X"))).when(key % 3 == 1, F.array(F.lit("Y"))).otherwise(F.array(F.lit("X"), F.lit("Y")))
    return bindings.table(spark, sf, "supplier").select(
        key.alias("vehicle_id"), F.col("s_nationkey").alias("zone_id"), services.alias("eligible_services"),
        F.when(key % 4 == 0, "on_trip").otherwise("idle").alias("state"),
        F.concat(F.lit("d"), key.cast("string")).alias("driver_id"), F.concat(F.lit("s"), key.cast("string")).alias("shift_id"),
    )


def travel(spark, sf) -> DataFrame:
    """Travel matrix between nations; a few pairs are dropped by `broken`."""
    nations = bindings.table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone_id"))
    ids = nations.agg(F.collect_list("zone_id")).scalar()
    gap = F.abs(F.col("origin_zone_id") - F.col("destination_zone_id"))
    return nations.select(F.col("zone_id").alias("origin_zone_id")).withColumn("destination_zone_id", F.explode(ids)).withColumns(
        {"pickup_seconds": (gap * 90 + 60).cast("double"), "trip_seconds": (gap * 120 + 300).cast("double"), "destination_probability": F.lit(1 / 25)}
    )


_FLEET = "SELECT s_suppkey AS vehicle_id, s_nationkey AS zone_id, s_suppkey % 3 <> 1 AS serves_x, s_suppkey % 3 <> 0 AS serves_y, s_suppkey % 4 <> 0 AS idle FROM supplier"


@query("I10_rank_candidates", sql_shown(with_views("""SELECT request_id, vehicle_id, pickup_seconds, candidate_rank FROM (SELECT r.request_id, f.vehicle_id, ABS(f.zone_id - r.origin_zone_id) * 90 + 60 AS pickup_seconds,
ROW_NUMBER() OVER (PARTITION BY r.request_id ORDER BY ABS(f.zone_id - r.origin_zone_id), f.vehicle_id) AS candidate_rank FROM requests r JOIN fleet f ON idle AND ABS(f.zone_id - r.origin_zone_id) * 90 + 60 <= 500 AND CASE r.service_id WHEN 'X' THEN serves_x ELSE serves_y END
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.request_id AND l.l_suppkey = f.vehicle_id)) WHERE candidate_rank <= 3""", "requests", fleet=_FLEET), {"request_id": "i", "vehicle_id": "i", "pickup_seconds": "r", "candidate_rank": "i"}))
def i10(spark, sf):
    tried = bindings.driver_offers(spark, sf).select("request_id", "vehicle_id")
    return shown(ops.rank_candidates(bindings.requests(spark, sf), fleet(spark, sf), travel(spark, sf), tried, 500, 3))


_HELD = "SELECT *, offered_at + response_seconds * INTERVAL '1' SECOND AS e FROM driver_offers WHERE state IN ('accepted', 'offered')"


@query("I11_double_bookings", with_views("""SELECT 'overlap_vehicle_id' AS "check", COUNT(*) FILTER (WHERE m > offered_at) AS violations FROM (SELECT *, MAX(e) OVER (PARTITION BY vehicle_id ORDER BY offered_at, e, offer_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM held)
UNION ALL SELECT 'overlap_request_id', COUNT(*) FILTER (WHERE m > offered_at) FROM (SELECT *, MAX(e) OVER (PARTITION BY request_id ORDER BY offered_at, e, offer_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM held)
UNION ALL SELECT 'repeated_pair', COUNT(*) FROM (SELECT 1 FROM driver_offers GROUP BY request_id, vehicle_id HAVING COUNT(*) > 1)""", "driver_offers", held=_HELD))
def i11(spark, sf):
    return ops.double_bookings(bindings.driver_offers(spark, sf))


@query("I12_od_violations", "SELECT 'missing_pair' AS \"check\", COUNT(*) FILTER (WHERE o.n_nationkey = 3 AND d.n_nationkey > 20) AS violations FROM nation o CROSS JOIN nation d UNION ALL SELECT 'unknown_zone', 0 UNION ALL SELECT 'repeated_pair', COUNT(*) FILTER (WHERE n_nationkey = 5) FROM nation UNION ALL SELECT 'probability_sum', 2 UNION ALL SELECT 'bad_value', 0")
def i12(spark, sf):
    od = travel(spark, sf)
    o, d = F.col("origin_zone_id"), F.col("destination_zone_id")
    broken = od.filter(~((o == 3) & (d > 20))).unionByName(od.filter((o == 5) & (d == 5)))
    zones = bindings.table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone_id"))
    return ops.od_violations(broken, zones)


@query("I13_window_membership", on_requests(f"SELECT state, created_at >= {_S} AND created_at < {_E} AS created_in_window, created_at < {_S} AND COALESCE(COALESCE(completed_at, canceled_at, expired_at) >= {_S}, TRUE) AS carry_in, COUNT(*) AS n FROM life GROUP BY 1, 2, 3"))
def i13(spark, sf):
    marked = ops.window_membership(ops.request_lifecycle(events(spark, sf)), *bounds())
    return marked.groupBy("state", "created_in_window", "carry_in").agg(F.count(F.lit(1)).alias("n"))


# --- earnings -----------------------------------------------------------------------------

def fares(spark: SparkSession, sf: str) -> DataFrame:
    """Service tariff from the parts table, under a fixed price policy."""
    part = bindings.table(spark, sf, "part")
    service = F.when(F.col("p_partkey") % 2 == 0, "X").otherwise("Y")
    tariff = part.groupBy(service.alias("service_id")).agg((F.avg("p_retailprice") / 100).alias("baseline_fare"))
    policy = spark.createDataFrame([("X", 1.0, 0.1), ("Y", 0.9, 0.0)], "service_id string, baseline_multiplier double, delta_price double")
    return earnings.effective_fares(tariff, policy)


_FARES = "SELECT service_id, f * CASE service_id WHEN 'X' THEN 1.1 ELSE 0.9 END AS amount FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'X' ELSE 'Y' END AS service_id, AVG(p_retailprice) / 100 AS f FROM part GROUP BY 1)"
_LEDGER = f"""SELECT SHA256(request_id || '|' || CAST(event_ts AS VARCHAR) || '|v1') AS ledger_id, request_id, vehicle_id, 'd' || s_suppkey AS driver_id, 's' || s_suppkey AS shift_id, service_id, event_ts AS completed_at,
amount AS rider_payment, CASE WHEN s_suppkey IS NOT NULL THEN amount END AS driver_pay, CASE WHEN s_suppkey IS NULL THEN 'unknown_vehicle' WHEN amount IS NULL THEN 'unknown_service' ELSE 'ok' END AS terms_status
FROM request_events LEFT JOIN fares USING (service_id) LEFT JOIN supplier ON vehicle_id = s_suppkey WHERE state = 'completed' AND event_ts >= {_S} AND event_ts < {_E}"""


def on_pay(body: str, **extra: str) -> str:
    return with_views(body, "request_events", "state_changes", life=LIFE, fares=_FARES, ledger=_LEDGER, intervals=INTERVALS, **extra)


@query("J01_effective_fares", sql_shown(on_pay("SELECT * FROM fares"), {"service_id": "", "amount": "r"}))
def j01(spark, sf):
    return shown(fares(spark, sf))


@query("J02_quote_terms", sql_shown(on_pay("SELECT request_id, service_id, created_at AS quote_at, amount AS displayed_fare FROM life JOIN fares USING (service_id)"), {"request_id": "i", "service_id": "", "quote_at": "t", "displayed_fare": "r"}))
def j02(spark, sf):
    return shown(earnings.quote_terms(ops.request_lifecycle(events(spark, sf)), fares(spark, sf)))


@query("J03_pay_terms", sql_shown(on_pay("SELECT request_id, vehicle_id, 'd' || s_suppkey AS driver_id, service_id, assigned_at AS offer_at, CASE WHEN s_suppkey IS NOT NULL THEN amount END AS offered_driver_pay, CASE WHEN s_suppkey IS NULL THEN 'unknown_vehicle' WHEN amount IS NULL THEN 'unknown_service' ELSE 'ok' END AS terms_status FROM life LEFT JOIN fares USING (service_id) LEFT JOIN supplier ON vehicle_id = s_suppkey WHERE assigned_at IS NOT NULL"), {"request_id": "i", "vehicle_id": "i", "driver_id": "", "service_id": "", "offer_at": "t", "offered_driver_pay": "r", "terms_status": ""}))
def j03(spark, sf):
    return shown(earnings.pay_terms(ops.request_lifecycle(events(spark, sf)), fleet(spark, sf), fares(spark, sf)).drop("shift_id"))


def ledger(spark, sf) -> DataFrame:
    return earnings.settle_ledger(events(spark, sf), fleet(spark, sf), fares(spark, sf), *bounds())


@query("J04_settle_ledger", sql_shown(on_pay("SELECT * FROM ledger"), {"ledger_id": "", "request_id": "i", "vehicle_id": "i", "driver_id": "", "service_id": "", "completed_at": "t", "rider_payment": "r", "driver_pay": "r", "shift_id": "", "terms_status": ""}))
def j04(spark, sf):
    return shown(ledger(spark, sf))


@query("J05_settlement_violations", on_requests("""SELECT 'duplicate_completion' AS "check", COUNT(*) FILTER (WHERE state = 'completed' AND request_id % 50 = 1) AS violations FROM life UNION ALL SELECT 'unknown_request', 0 UNION ALL SELECT 'missing_completion', COUNT(*) FILTER (WHERE state = 'completed' AND request_id % 50 = 0) FROM life
UNION ALL SELECT 'unexpected_completion', COUNT(*) FILTER (WHERE state = 'completed' AND request_id % 50 = 4) FROM life UNION ALL SELECT 'time_mismatch', COUNT(*) FILTER (WHERE state = 'completed' AND request_id % 50 = 2) FROM life UNION ALL SELECT 'vehicle_mismatch', COUNT(*) FILTER (WHERE state = 'completed' AND request_id % 50 = 3) FROM life
UNION ALL SELECT 'unassigned_completion', 0 UNION ALL SELECT 'time_order', 0
UNION ALL SELECT 'unknown_vehicle', COUNT(*) FILTER (WHERE state = 'completed' AND request_id % 50 <> 0 AND (vehicle_id + CASE WHEN request_id % 50 = 3 THEN 1000 ELSE 0 END) NOT IN (SELECT s_suppkey FROM supplier)) FROM life
UNION ALL SELECT 'unknown_service', COUNT(*) FILTER (WHERE state = 'completed' AND request_id % 50 <> 0 AND service_id = 'Y') FROM life"""))
def j05(spark, sf):
    log = events(spark, sf)
    records = ops.request_lifecycle(log).withColumn("state", F.when((F.col("state") == "completed") & (F.col("request_id") % 50 == 4), "on_trip").otherwise(F.col("state")))
    slot, done = F.col("request_id") % 50, F.col("state") == "completed"
    shifted = log.filter(~(done & (slot == 0))).withColumns(
        {
            "event_ts": F.when(done & (slot == 2), F.timestamp_add("SECOND", F.lit(1), F.col("event_ts"))).otherwise(F.col("event_ts")),
            "vehicle_id": F.when(done & (slot == 3), F.col("vehicle_id") + 1000).otherwise(F.col("vehicle_id")),
        }
    )
    return earnings.settlement_violations(shifted.unionByName(shifted.filter(done & (slot == 1))), records, fleet(spark, sf), fares(spark, sf).filter("service_id = 'X'"))


_PRESENCE = "SELECT vehicle_id, COALESCE(SUM(duration_hours) FILTER (WHERE state <> 'offline'), 0) AS presence_hours, 0::BIGINT AS bad_durations FROM intervals GROUP BY 1"


@query("J06_presence_hours", sql_shown(on_pay("SELECT * FROM presence", presence=_PRESENCE), {"vehicle_id": "i", "presence_hours": "r5", "bad_durations": "i"}))
def j06(spark, sf):
    return shown(earnings.presence_hours(intervals(spark, sf)), 5)


_INCOME = "SELECT s_suppkey AS vehicle_id, 'd' || s_suppkey AS driver_id, COALESCE(t, 0) AS completed_trips, COALESCE(p, 0) AS total_driver_pay, COALESCE(presence_hours, 0) AS presence_hours, p0 / NULLIF(presence_hours, 0) AS pay_per_presence_hour, CASE WHEN presence_hours > 0 THEN 'ok' ELSE 'unavailable_zero_presence' END AS income_rate_status FROM (SELECT s_suppkey, t, p, COALESCE(p, 0) AS p0, presence_hours FROM supplier LEFT JOIN (SELECT vehicle_id, COUNT(driver_pay) AS t, SUM(driver_pay) AS p FROM ledger GROUP BY 1) l ON l.vehicle_id = s_suppkey LEFT JOIN presence q ON q.vehicle_id = s_suppkey)"


def income(spark, sf) -> DataFrame:
    return earnings.driver_income(fleet(spark, sf), ledger(spark, sf), earnings.presence_hours(intervals(spark, sf)))


@query("J07_driver_income", sql_shown(on_pay("SELECT * FROM income", presence=_PRESENCE, income=_INCOME), {"vehicle_id": "i", "driver_id": "", "completed_trips": "i", "total_driver_pay": "r4", "presence_hours": "r4", "pay_per_presence_hour": "r4", "income_rate_status": ""}))
def j07(spark, sf):
    return shown(income(spark, sf).drop("shift_id"), 4)


@query("J08_earnings_summary", sql_shown(on_pay("SELECT (SELECT COUNT(*) FROM life) AS quoted_requests, (SELECT COUNT(*) FROM life WHERE assigned_at IS NOT NULL AND vehicle_id IN (SELECT s_suppkey FROM supplier)) AS assigned_terms, (SELECT COUNT(*) FILTER (WHERE terms_status = 'ok') FROM ledger) AS settled_trips, (SELECT COUNT(*) FILTER (WHERE terms_status <> 'ok') FROM ledger) AS unsettled_trips, SUM(total_driver_pay) AS total_driver_pay, SUM(presence_hours) AS presence_hours, SUM(total_driver_pay) / SUM(presence_hours) AS pay_per_presence_hour FROM income", presence=_PRESENCE, income=_INCOME), {"quoted_requests": "i", "assigned_terms": "i", "settled_trips": "i", "unsettled_trips": "i", "total_driver_pay": "r3", "presence_hours": "r3", "pay_per_presence_hour": "r3"}))
def j08(spark, sf):
    life = ops.request_lifecycle(events(spark, sf))
    return shown(earnings.earnings_summary(life, fleet(spark, sf), fares(spark, sf), ledger(spark, sf), income(spark, sf)), 3)


# --- supply contrasts ---------------------------------------------------------------------

def shifts(spark, sf) -> DataFrame:
    return bindings.driver_shifts(spark, sf)


@query("K01_cohort_violations", with_views("""SELECT 'missing_or_nonfinite' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'participation_not_binary', 0 UNION ALL SELECT 'unknown_incentive', COUNT(*) FILTER (WHERE driver_id % 40 = 1) FROM driver_shifts UNION ALL SELECT 'hours_out_of_range', COUNT(*) FILTER (WHERE worked_hours > 1.5 AND NOT (driver_id % 30 = 2 AND day_id = DATE '2024-01-01')) FROM driver_shifts UNION ALL SELECT 'absent_with_hours', 0
UNION ALL SELECT 'incomplete_driver', COUNT(DISTINCT driver_id) FILTER (WHERE driver_id % 30 = 2) FROM driver_shifts UNION ALL SELECT 'arm_changes', COUNT(DISTINCT driver_id) FILTER (WHERE driver_id % 20 = 3) FROM driver_shifts UNION ALL SELECT 'repeated_shift', 0 UNION ALL SELECT 'calendar_mismatch', 1""", "driver_shifts"))
def k01(spark, sf):
    driver, first = F.col("driver_id"), F.col("day_id") == F.lit("2024-01-01").cast("date")
    flipped = F.when(F.col("incentive") == 0.0, 20.0).otherwise(0.0)
    broken = shifts(spark, sf).filter(~((driver % 30 == 2) & first)).withColumn(
        "incentive", F.when(driver % 40 == 1, 5.0).when((driver % 20 == 3) & first, flipped).otherwise(F.col("incentive"))
    )
    calendar = broken.select("day_id").distinct().unionByName(spark.range(1).select(F.lit("2024-02-15").cast("date").alias("day_id")))
    return supply.cohort_violations(broken, 30, 0.0, 20.0, 1.5, calendar)


_MEANS = "SELECT driver_id, MIN(incentive) AS incentive, COUNT(*) AS n_shifts, AVG(participated) AS participated, AVG(worked_hours) AS worked_hours, AVG(serviceable_hours) AS serviceable_hours FROM driver_shifts GROUP BY 1"


@query("K02_driver_means", sql_shown(with_views("SELECT * FROM means", "driver_shifts", means=_MEANS), {"driver_id": "i", "incentive": "r", "n_shifts": "i", "participated": "r", "worked_hours": "r", "serviceable_hours": "r"}))
def k02(spark, sf):
    return shown(supply.driver_means(shifts(spark, sf)))


_WELCH = " UNION ALL ".join(f"SELECT '{o}' AS outcome, incentive, {o} AS v FROM means" for o in supply.OUTCOMES)
_WELCH_STATS = "SELECT outcome, COUNT(*) FILTER (WHERE incentive = 0) AS n0, COUNT(*) FILTER (WHERE incentive = 20) AS n1, AVG(v) FILTER (WHERE incentive = 0) AS m0, AVG(v) FILTER (WHERE incentive = 20) AS m1, VAR_SAMP(v) FILTER (WHERE incentive = 0) / COUNT(*) FILTER (WHERE incentive = 0) AS s0, VAR_SAMP(v) FILTER (WHERE incentive = 20) / COUNT(*) FILTER (WHERE incentive = 20) AS s1 FROM wl GROUP BY 1"
_EFFECTS = "SELECT outcome, n0 AS n_baseline, n1 AS n_target, 'ok' AS status, m0 AS baseline_mean, m1 AS target_mean, m1 - m0 AS effect, SQRT(s0 + s1) AS standard_error, df AS degrees_of_freedom, m1 - m0 - hi * SQRT(s0 + s1) AS ci_low, m1 - m0 + hi * SQRT(s0 + s1) AS ci_high, 'ok' AS interval_status FROM ws JOIN tq ON tq.id = ws.outcome AND tq.step = 48"
_WELCH_CTES = {"means": _MEANS, "wl": _WELCH, "ws": _WELCH_STATS, "tq_in": "SELECT outcome AS id, 0.975::DOUBLE AS p, POW(s0 + s1, 2) / (s0 * s0 / (n0 - 1) + s1 * s1 / (n1 - 1)) AS df FROM ws", **_TQ, "effects": _EFFECTS}


@query("K03_welch_contrast", sql_shown(with_views("SELECT * FROM effects", "driver_shifts", **_WELCH_CTES), {"outcome": "", "n_baseline": "i", "n_target": "i", "status": "", **dict.fromkeys(("baseline_mean", "target_mean", "effect", "standard_error", "degrees_of_freedom", "ci_low", "ci_high"), "r"), "interval_status": ""}))
def k03(spark, sf):
    return shown(supply.welch_contrast(supply.driver_means(shifts(spark, sf)), 0.0, 20.0))


@query("K04_conditional_hours", sql_shown(with_views("SELECT incentive, COUNT(*) AS participating_shifts, AVG(worked_hours) AS conditional_worked_hours, 'descriptive' AS interpretation FROM driver_shifts WHERE participated = 1 GROUP BY 1", "driver_shifts"), {"incentive": "r", "participating_shifts": "i", "conditional_worked_hours": "r", "interpretation": ""}))
def k04(spark, sf):
    return shown(supply.conditional_hours(shifts(spark, sf)))


@query("K05_supply_scenario", sql_shown(with_views("""SELECT amount, e.outcome, CASE WHEN amount = 10 THEN 'unsupported_action' ELSE e.status END AS status, CASE WHEN amount <> 10 THEN baseline_mean * sc END AS baseline, CASE amount WHEN 0 THEN baseline_mean * sc WHEN 20 THEN target_mean * sc END AS target, CASE amount WHEN 0 THEN 0 WHEN 20 THEN effect * sc END AS change,
CASE amount WHEN 0 THEN 0 WHEN 20 THEN ci_low * sc END AS ci_low, CASE amount WHEN 0 THEN 0 WHEN 20 THEN ci_high * sc END AS ci_high, CASE amount WHEN 0 THEN 'deterministic_identity' WHEN 20 THEN interval_status ELSE 'interval_unavailable' END AS interval_status
FROM (SELECT *, CASE outcome WHEN 'participated' THEN 1 ELSE 150 * 30 END AS sc FROM effects) e CROSS JOIN (VALUES (0.0::DOUBLE), (10.0), (20.0)) a(amount)""", "driver_shifts", **_WELCH_CTES), {"amount": "r", "outcome": "", "status": "", **dict.fromkeys(("baseline", "target", "change", "ci_low", "ci_high"), "r4"), "interval_status": ""}))
def k05(spark, sf):
    effects = supply.welch_contrast(supply.driver_means(shifts(spark, sf)), 0.0, 20.0)
    amounts = spark.createDataFrame([(0.0,), (10.0,), (20.0,)], "amount double")
    return shown(supply.supply_scenario(effects, amounts, 0.0, 20.0, 150, 30), 4)


# --- experiments --------------------------------------------------------------------------

@query("M01_switchback_schedule", sql_shown("""SELECT cluster_id, cluster_id || '-' || pair AS pair_id, cluster_id || '-' || pair || '-' || position AS block_id, CASE WHEN (position + flip) % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm, CASE WHEN (position + flip) % 2 = 1 THEN 'candidate' ELSE 'baseline' END AS policy_id,
TIMESTAMP '2024-02-01 00:00:00' + (2 * pair + position) * 150 * INTERVAL '1' MINUTE AS start, TIMESTAMP '2024-02-01 00:00:00' + ((2 * pair + position) * 150 + 120) * INTERVAL '1' MINUTE AS "end", 0.5 AS assignment_probability
FROM (SELECT s_suppkey AS cluster_id, pair, position, ('0x' || SUBSTR(MD5('11-' || s_suppkey || '-' || pair), 1, 8))::BIGINT % 2 AS flip FROM supplier CROSS JOIN RANGE(14) p(pair) CROSS JOIN RANGE(2) q(position))""", {"cluster_id": "i", "pair_id": "", "block_id": "", "arm": "", "policy_id": "", "start": "t", "end": "t", "assignment_probability": "r"}))
def m01(spark, sf):
    clusters = bindings.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cluster_id"))
    return shown(experiment.switchback_schedule(clusters, 14, ntz("2024-02-01 00:00:00"), 120, 30, "candidate", 11))


def pairs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(schedule, observations) from the two-arm customer blocks; missing values unobserved."""
    rows = bindings.block_pairs(spark, sf).withColumns(
        {"block_id": F.concat_ws("-", F.col("pair_id").cast("string"), "arm"), "stratum": F.col("pair_id") % 5}
    )
    schedule = rows.select("block_id", "pair_id", "arm", "policy_id", "stratum")
    seen = rows.filter("value is not null").select(
        "block_id", F.col("policy_id").alias("applied_policy_id"), F.lit("completed_trips").alias("metric"),
        F.lit("trips").alias("unit"), "value",
    )
    return schedule, seen


_DIFF = "SELECT pair_id, pair_id % 5 AS stratum, MAX(value) FILTER (WHERE arm = 'treatment') AS t, MAX(value) FILTER (WHERE arm = 'control') AS c FROM block_pairs GROUP BY 1"
_Z = 1.959963984540054 + 0.8416212335729143


@query("M02_power_table", sql_shown(with_views(f"SELECT stratum, COUNT(t - c) AS scheduled_pairs, STDDEV_SAMP(t - c) AS paired_difference_sd, GREATEST(2, CEIL(POW({_Z!r}::DOUBLE * STDDEV_SAMP(t - c) / 2.0, 2))) AS required_pairs, COUNT(t - c) >= GREATEST(2, CEIL(POW({_Z!r}::DOUBLE * STDDEV_SAMP(t - c) / 2.0, 2))) AS sufficient, 'normal_approximation' AS status FROM d GROUP BY 1", "block_pairs", d=_DIFF), {"stratum": "i", "scheduled_pairs": "i", "paired_difference_sd": "r", "required_pairs": "i", "sufficient": "", "status": ""}))
def m02(spark, sf):
    schedule, seen = pairs(spark, sf)
    differences = experiment.pair_differences(schedule, seen, ["stratum"])
    return shown(experiment.power_table(differences, ["stratum"], "difference", 0.05, 0.8, 2.0))


@query("M03_exposure_violations", with_views("SELECT 'unknown_block' AS \"check\", COUNT(*) FILTER (WHERE c_custkey % 91 = 0) AS violations FROM customer UNION ALL SELECT 'duplicate_block', COUNT(*) FILTER (WHERE c_custkey % 97 = 0) FROM customer UNION ALL SELECT 'wrong_policy', COUNT(*) FILTER (WHERE value IS NOT NULL AND arm = 'treatment' AND pair_id % 61 = 0 ) FROM block_pairs UNION ALL SELECT 'metric_or_unit', 0 UNION ALL SELECT 'missing_value', 0 UNION ALL SELECT 'missing_block', COUNT(*) FILTER (WHERE value IS NULL) FROM block_pairs", "block_pairs"))
def m03(spark, sf):
    schedule, seen = pairs(spark, sf)
    key = F.split("block_id", "-")[0].cast("bigint")
    treated = F.col("block_id").endswith("treatment")
    wrong = seen.withColumn("applied_policy_id", F.when(treated & (key % 61 == 0), "baseline").otherwise(F.col("applied_policy_id")))
    foreign = seen.filter(treated & (key % 91 == 0)).withColumn("block_id", F.concat(F.lit("x-"), "block_id"))
    again = seen.filter(treated & (key % 97 == 0) & (key % 61 != 0))
    again = again.unionByName(seen.filter(treated & (key % 97 == 0) & (key % 61 == 0)))
    return experiment.exposure_violations(schedule, wrong.unionByName(foreign).unionByName(again), "completed_trips", "trips")


_PAIRED = "SELECT stratum, COUNT(*) AS expected_pairs, COUNT(t - c) AS complete_pairs, COUNT(*) FILTER (WHERE t IS NULL) + COUNT(*) FILTER (WHERE c IS NULL) AS missing_blocks, AVG(t - c) AS observed_effect, STDDEV_SAMP(t - c) / SQRT(COUNT(t - c)) AS se FROM d GROUP BY 1"


@query("M04_paired_effect", sql_shown(with_views("""SELECT stratum, expected_pairs, complete_pairs, missing_blocks, observed_effect, CASE WHEN missing_blocks = 0 THEN se END AS standard_error, CASE WHEN missing_blocks = 0 THEN observed_effect - hi * se END AS lower, CASE WHEN missing_blocks = 0 THEN observed_effect + hi * se END AS upper,
CASE WHEN missing_blocks = 0 THEN 'completed' ELSE 'incomplete' END AS status, CASE WHEN missing_blocks = 0 THEN observed_effect - 12.0 END AS forecast_error FROM pe JOIN tq ON tq.id = stratum AND tq.step = 48""", "block_pairs", d=_DIFF.replace("pair_id % 5 AS stratum", "pair_id % 53 AS stratum"), pe=_PAIRED, tq_in="SELECT stratum AS id, 0.975::DOUBLE AS p, (complete_pairs - 1)::DOUBLE AS df FROM pe", **_TQ), {"stratum": "i", "expected_pairs": "i", "complete_pairs": "i", "missing_blocks": "i", **dict.fromkeys(("observed_effect", "standard_error", "lower", "upper"), "r4"), "status": "", "forecast_error": "r4"}))
def m04(spark, sf):
    schedule, seen = pairs(spark, sf)
    strata = schedule.withColumn("stratum", F.col("pair_id") % 53)
    out = experiment.paired_effect(strata, seen, prediction=12.0, by=["stratum"])
    return shown(out.drop("aa_zero_in_interval"), 4)


_SRM = "SELECT stratum, COUNT(*) AS observed_blocks, COUNT(*) FILTER (WHERE arm = 'control') AS control_blocks FROM (SELECT pair_id % 53 AS stratum, arm FROM block_pairs WHERE value IS NOT NULL) GROUP BY 1"


@query("M05_sample_ratio", sql_shown(with_views(f"SELECT *, CASE WHEN p_value < 0.05 THEN 'warning' ELSE 'ok' END AS sample_ratio_status FROM (SELECT *, {binomial_two_sided('control_blocks', 'observed_blocks', '0.5')} AS p_value FROM srm)", "block_pairs", srm=_SRM), {"stratum": "i", "observed_blocks": "i", "control_blocks": "i", "p_value": "r", "sample_ratio_status": ""}))
def m05(spark, sf):
    schedule, seen = pairs(spark, sf)
    strata = schedule.withColumn("stratum", F.col("pair_id") % 53)
    return shown(experiment.sample_ratio(strata, seen, by=["stratum"]))
