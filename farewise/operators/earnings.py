"""Fares, frozen pay terms, the settlement ledger and driver income."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.functions.scalars import safe_div, seconds_between
from farewise.operators.ops import within


def effective_fares(tariff: DataFrame, policy: DataFrame) -> DataFrame:
    """fare x multiplier x (1 + delta) per service (and per policy when the table has several)."""
    fare = F.col("baseline_fare") * F.col("baseline_multiplier") * (1 + F.col("delta_price"))
    keys = [c for c in ("policy_id",) if c in policy.columns]
    return tariff.join(policy, "service_id").select(*keys, "service_id", fare.alias("amount"))


def quote_terms(requests: DataFrame, fares: DataFrame) -> DataFrame:
    """The one displayed fare of every request."""
    priced = requests.join(fares.select("service_id", "amount"), "service_id")
    return priced.select("request_id", "service_id", F.col("created_at").alias("quote_at"), F.col("amount").alias("displayed_fare"))


def _priced(rows: DataFrame, roster: DataFrame, fares: DataFrame) -> DataFrame:
    """Fare and driver of each row; a row whose service or vehicle is unknown stays and says so."""
    drivers = roster.select("vehicle_id", "driver_id", "shift_id", F.lit(True).alias("_rostered"))
    joined = rows.join(fares.select("service_id", "amount"), "service_id", "left").join(drivers, "vehicle_id", "left")
    status = F.when(F.col("_rostered").isNull(), "unknown_vehicle").when(F.col("amount").isNull(), "unknown_service").otherwise("ok")
    return joined.withColumn("terms_status", status)


def _payable(amount: str = "amount") -> Column:
    return F.when(F.col("terms_status") == "ok", F.col(amount))


def pay_terms(requests: DataFrame, roster: DataFrame, fares: DataFrame) -> DataFrame:
    """Driver pay frozen at assignment, for assigned requests only.

    Pay is NULL, with the reason in `terms_status`, where the vehicle or the service is unknown.
    """
    return _priced(requests.filter(F.col("assigned_at").isNotNull()), roster, fares).select(
        "request_id", "vehicle_id", "driver_id", "shift_id", "service_id",
        F.col("assigned_at").alias("offer_at"), _payable().alias("offered_driver_pay"), "terms_status",
    )


def settle_ledger(
    events: DataFrame, roster: DataFrame, fares: DataFrame, start: Column, end: Column, terms_version: str = "v1"
) -> DataFrame:
    """One ledger row per completion event inside the half-open window.

    Completions before the window were paid by their own window and are not read again, so
    consecutive windows settle every trip exactly once. A completion of an unknown vehicle or service
    keeps its row, unpaid and marked in `terms_status`.
    """
    done = events.filter((F.col("state") == "completed") & within("event_ts", start, end))
    ledger_id = F.sha2(F.concat_ws("|", F.col("request_id").cast("string"), F.col("event_ts").cast("string"), F.lit(terms_version)), 256)
    return _priced(done, roster, fares).select(
        ledger_id.alias("ledger_id"), "request_id", "vehicle_id", "driver_id", "shift_id", "service_id",
        F.col("event_ts").alias("completed_at"), F.col("amount").alias("rider_payment"), _payable().alias("driver_pay"), "terms_status",
    )


def settlement_violations(
    events: DataFrame, requests: DataFrame, roster: DataFrame | None = None, fares: DataFrame | None = None
) -> DataFrame:
    """(check, violations): completion events against request records, both directions.

    With a roster or fares, completions of vehicles or services they lack are counted too.
    """
    completions = events.filter("state = 'completed'").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("event_ts").alias("event_at"), F.max("vehicle_id").alias("event_vehicle"),
        F.max("service_id").alias("event_service"),
    )
    both = requests.select("request_id", "state", "assigned_at", "completed_at", "created_at", "vehicle_id", F.lit(True).alias("known")).join(
        completions, "request_id", "full_outer"
    )
    finished = F.col("state") == "completed"
    has_event = F.col("n_events").isNotNull()
    times = (F.col("created_at") > F.col("assigned_at")) | (F.col("assigned_at") > F.col("completed_at"))
    rules = {
        "duplicate_completion": F.col("n_events") > 1,
        "unknown_request": has_event & F.col("known").isNull(),
        "missing_completion": finished & ~has_event,
        "unexpected_completion": has_event & F.col("known").isNotNull() & ~finished,
        "time_mismatch": finished & has_event & (F.col("event_at") != F.col("completed_at")),
        "vehicle_mismatch": finished & has_event & ~F.col("event_vehicle").eqNullSafe(F.col("vehicle_id")),
        "unassigned_completion": finished & F.col("assigned_at").isNull(),
        "time_order": times,
    }
    for table, key, rule in ((roster, "vehicle", "unknown_vehicle"), (fares, "service", "unknown_service")):
        if table is not None:
            listed = table.select(F.col(f"{key}_id").alias(f"event_{key}"), F.lit(True).alias(f"_{key}")).distinct()
            both = both.join(listed, f"event_{key}", "left")
            rules[rule] = has_event & F.col(f"_{key}").isNull()
    row = both.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    return row.unpivot([], list(rules), "check", "violations")


def presence_hours(intervals: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Non-offline hours per vehicle and how many durations disagree with their times."""
    hours = F.col("duration_hours")
    implied = seconds_between("start", "end") / 3600
    return intervals.groupBy("vehicle_id").agg(
        F.sum(F.when(F.col("state") != "offline", hours).otherwise(0.0)).alias("presence_hours"),
        F.count_if(F.abs(hours - implied) > tolerance * F.greatest(F.lit(1.0), implied)).alias("bad_durations"),
    )


def driver_income(roster: DataFrame, ledger: DataFrame, presence: DataFrame) -> DataFrame:
    """Trips, pay, hours and hourly pay for every rostered vehicle, zero-trip ones included.

    The ledger is aggregated per vehicle before the joins, so one busy vehicle is one row.
    """
    paid = ledger.groupBy("vehicle_id").agg(F.count("driver_pay").alias("completed_trips"), F.sum("driver_pay").alias("total_driver_pay"))
    joined = roster.select("vehicle_id", "driver_id", "shift_id").join(paid, "vehicle_id", "left").join(presence.select("vehicle_id", "presence_hours"), "vehicle_id", "left")
    filled = joined.fillna(0, ["completed_trips"]).fillna(0.0, ["total_driver_pay", "presence_hours"])
    present = F.col("presence_hours") > 0
    return filled.withColumns(
        {
            "pay_per_presence_hour": safe_div("total_driver_pay", "presence_hours"),
            "income_rate_status": F.when(present, "ok").otherwise("unavailable_zero_presence"),
        }
    )


def earnings_summary(requests: DataFrame, roster: DataFrame, fares: DataFrame, ledger: DataFrame, income: DataFrame) -> DataFrame:
    """One row of totals for the window; quotes and terms are counted in one pass over the requests."""
    priced = _priced(requests, roster, fares)
    assigned = F.col("assigned_at").isNotNull()
    known = F.col("terms_status") == "ok"
    quotes = priced.agg(F.count("amount").alias("q"), F.count_if(assigned & known).alias("a")).select(F.struct("q", "a")).scalar()
    settled = ledger.agg(F.count_if(known).alias("s"), F.count_if(~known).alias("u")).select(F.struct("s", "u")).scalar()
    totals = income.agg(F.sum("total_driver_pay").alias("total_driver_pay"), F.sum("presence_hours").alias("presence_hours"))
    return totals.withColumns({"_q": quotes, "_s": settled}).select(
        F.col("_q.q").alias("quoted_requests"), F.col("_q.a").alias("assigned_terms"), F.col("_s.s").alias("settled_trips"),
        F.col("_s.u").alias("unsettled_trips"), "total_driver_pay", "presence_hours",
        safe_div("total_driver_pay", "presence_hours").alias("pay_per_presence_hour"),
    )
