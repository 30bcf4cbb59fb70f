"""Operational accounting over request, vehicle and offer logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewise.functions.scalars import ntz, safe_div, seconds_between
from farewise.functions.skew import Quantile, exact_quantiles, with_neighbour, with_running_max
from farewise.session import scratch_path

# Request, vehicle and offer states.
OPEN_STATES = ("created", "queued", "assigned", "pickup", "on_trip")
TERMINAL_STATES = ("completed", "canceled", "expired")
LIFE_CYCLE = OPEN_STATES + TERMINAL_STATES
VEHICLE_STATES = ("idle", "dispatch", "to_pickup", "on_trip", "offline", "unavailable")
SERVICEABLE_STATES = ("idle", "dispatch", "to_pickup", "on_trip")
RESPONSES = ("accepted", "rejected", "timed_out")

RANK_SALTS = 64
RANK_PLACE = ["origin_zone_id", "service_id"]
#: Tried vehicles of a request for which the first list of ranks has room.
RANK_PREFIX = 32


def within(ts: str | Column, start: Column, end: Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return (c >= start) & (c < end)


# --- requests -----------------------------------------------------------------------------

def request_lifecycle(events: DataFrame) -> DataFrame:
    """One row per request: first time in each state, latest state, service and vehicle.

    Every state of the aggregation is a number (the latest state travels as time and life-cycle
    position in one integer), so it hashes and merges map-side without sorting. States that
    share a time follow the life-cycle order.
    """
    order = F.array(*[F.lit(s) for s in LIFE_CYCLE])
    stamp = F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), F.col("event_ts"))
    packed = stamp * len(LIFE_CYCLE) + F.array_position(order, F.col("state")) - 1
    at = lambda s: F.min(F.when(F.col("state") == s, F.col("event_ts")))
    grouped = events.groupBy("request_id", "service_id").agg(
        at("created").alias("created_at"),
        at("assigned").alias("assigned_at"),
        at("on_trip").alias("pickup_at"),
        at("completed").alias("completed_at"),
        at("canceled").alias("canceled_at"),
        at("expired").alias("expired_at"),
        F.max(packed).alias("latest"),
        F.max("vehicle_id").alias("vehicle_id"),
    )
    state = F.element_at(order, F.pmod("latest", F.lit(len(LIFE_CYCLE))).cast("int") + 1)
    return grouped.withColumn("state", state).drop("latest")


def wait_measures(requests: DataFrame, end: Column) -> DataFrame:
    """Wait until pickup, observed (possibly censored) wait and the reason it stopped."""
    picked = F.col("pickup_at").isNotNull()
    is_open = F.col("state").isin(*OPEN_STATES)
    stop = F.coalesce("pickup_at", "canceled_at", "expired_at", end)
    status = F.when(picked, "picked_up").when(is_open, "open_censored").otherwise("terminated_before_pickup")
    return requests.withColumns(
        {
            "wait_seconds": seconds_between("created_at", "pickup_at"),
            "observed_wait_seconds": seconds_between("created_at", stop),
            "wait_censored": ~picked & is_open,
            "completion_censored": is_open,
            "wait_status": status,
        }
    )


def window_membership(requests: DataFrame, start: Column, end: Column) -> DataFrame:
    """Flags for a split window: created inside it, or carried in open from before."""
    terminal = F.coalesce("completed_at", "canceled_at", "expired_at")
    carried = (F.col("created_at") < start) & (terminal.isNull() | (terminal >= start))
    return requests.withColumns(
        {"created_in_window": within("created_at", start, end), "carry_in": carried}
    )


def _window_counts(start: Column, end: Column) -> list[Column]:
    """Event-level counts; a request opens once and ends at most once, so opens are differences."""
    state, ts = F.col("state"), F.col("event_ts")
    inside = within(ts, start, end)
    ended = state.isin(*TERMINAL_STATES)
    opened = lambda t: F.count_if((state == "created") & (ts < t)) - F.count_if(ended & (ts < t))
    counts = [F.count_if(inside & (state == s)).alias(f"{s}_in_window") for s in ("created", *TERMINAL_STATES)]
    return [*counts, opened(start).alias("open_start"), opened(end).alias("open_end")]


def window_summary(
    events: DataFrame, start: Column, end: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Request flow in a half-open window plus mean and p95 wait of the window's pickups."""
    by = list(by)
    counts = events.groupBy(*by).agg(*_window_counts(start, end))
    picked = wait_measures(request_lifecycle(events), end).filter(within("pickup_at", start, end))
    extra = [F.count(F.lit(1)).alias("n_pickups"), F.avg("wait_seconds").alias("mean_wait_seconds")]
    waits = exact_quantiles(
        picked, by, [Quantile("p95_wait_seconds", "wait_seconds", 0.95)], extra
    )
    if by:
        return counts.join(waits, by, "left").fillna(0, ["n_pickups"])
    row = waits.select(F.struct(*waits.columns).alias("w")).scalar()
    return counts.withColumn("w", row).select(*counts.columns, "w.*")


def service_summary(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Created, completed and still-open requests per service; one partial aggregate."""
    return events.groupBy("service_id").agg(*_window_counts(start, end))


def conservation(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """open_start + created = terminated + open_end, checked with independent counts.

    The right side counts open requests from the per-request table, the left from events.
    """
    flow = events.agg(*_window_counts(start, end))
    ended = F.coalesce("completed_at", "canceled_at", "expired_at")
    live = request_lifecycle(events).filter(
        (F.col("created_at") < end) & (ended.isNull() | (ended >= end))
    )
    open_end = live.agg(F.count(F.lit(1))).scalar()
    left = F.col("open_start") + F.col("created_in_window")
    terminated = F.col("completed_in_window") + F.col("canceled_in_window") + F.col("expired_in_window")
    return flow.select(
        left.alias("opened"), terminated.alias("terminated"), open_end.alias("open_end"),
        (left == terminated + open_end).alias("conserved"),
    )


# --- vehicle states -----------------------------------------------------------------------

def state_intervals(changes: DataFrame, end: Column, chunk: Column | None = None) -> DataFrame:
    """Half-open intervals between state changes; the last one closes at `end`.

    Changes are cut into daily pieces per vehicle, so a vehicle with very many changes is
    sorted by many tasks.
    """
    piece = F.to_date("ts") if chunk is None else chunk
    linked = with_neighbour(changes, ["vehicle_id"], ["ts", "event_id"], piece, ["ts"], "next")
    stop = F.coalesce("next.ts", end)
    hours = seconds_between("ts", stop) / 3600
    return linked.select(
        "vehicle_id", "state", F.col("ts").alias("start"), stop.alias("end"), hours.alias("duration_hours")
    ).filter(F.col("end") > F.col("start"))


def state_hours(intervals: DataFrame, by: Sequence[str] = ("vehicle_id",)) -> DataFrame:
    """Hours per state, serviceable and total hours; aborted pickups when they are marked."""
    hours = F.col("duration_hours")
    per = [F.sum(F.when(F.col("state") == s, hours).otherwise(0.0)).alias(f"{s}_hours") for s in VEHICLE_STATES]
    per.append(F.sum(F.when(F.col("state").isin(*SERVICEABLE_STATES), hours).otherwise(0.0)).alias("serviceable_hours"))
    per.append(F.sum(hours).alias("total_hours"))
    if "activity_kind" in intervals.columns:
        per.append(F.sum(F.when(F.col("activity_kind") == "aborted_pickup", hours).otherwise(0.0)).alias("aborted_pickup_hours"))
    return intervals.groupBy(*by).agg(*per)


def interval_gaps(intervals: DataFrame, start: Column, end: Column, key: str = "vehicle_id") -> DataFrame:
    """Per entity: does it cover the window, and how many joints gap or overlap."""
    linked = with_neighbour(intervals, [key], ["start"], F.to_date("start"), ["start"], "next")
    follow = F.col("next.start")
    return linked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_intervals"),
        (F.min("start") == start).alias("starts_on_window"),
        (F.max("end") == end).alias("ends_on_window"),
        F.count_if(follow > F.col("end")).alias("gaps"),
        F.count_if(follow < F.col("end")).alias("overlaps"),
    )


# --- offers -------------------------------------------------------------------------------

def offer_summary(offers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Offers by outcome; acceptance over resolved responses, withdrawals left out."""
    state = F.col("state")
    counts = [F.count_if(state == s).alias(s) for s in (*RESPONSES, "withdrawn")]
    out = offers.groupBy(*by).agg(F.count(F.lit(1)).alias("offered"), *counts, F.count_if(state == "offered").alias("pending"))
    answered = F.col("accepted") + F.col("rejected") + F.col("timed_out")
    return out.withColumns(
        {"acceptance_denominator": answered, "acceptance_rate": safe_div("accepted", answered)}
    )


def offer_conservation(offers: DataFrame, start: Column, end: Column) -> DataFrame:
    """pending_start + offered = resolved + pending_end for a half-open window."""
    made, done = F.col("offered_at"), F.col("resolved_at")
    live = lambda t: F.count_if((made < t) & (done.isNull() | (done >= t)))
    out = offers.agg(
        live(start).alias("pending_start"), F.count_if(within(made, start, end)).alias("offered"),
        F.count_if(within(done, start, end)).alias("resolved"), live(end).alias("pending_end"),
    )
    balanced = F.col("pending_start") + F.col("offered") == F.col("resolved") + F.col("pending_end")
    return out.withColumn("conserved", balanced)


def rank_candidates(
    requests: DataFrame, vehicles: DataFrame, od: DataFrame, tried: DataFrame, max_eta: float, k: int,
    max_attempts: int | None = None,
) -> DataFrame:
    """The k nearest eligible idle vehicles per request by (pickup seconds, vehicle id).

    `requests` has one row per request. Vehicles are ranked once per (zone, service) instead of once per
    request, and the list is stored. Of the tried vehicles only those on the list of their request's place matter:
    the j-th candidate stands at rank j plus the tried ones ranked before it. A request thus fetches exactly its k
    ranks by an equi-join; it meets neither the fleet nor its tried vehicles row by row. A list of k + RANK_PREFIX
    ranks serves all requests that tried up to RANK_PREFIX of its vehicles; if one tried more, a list as long as the
    most attempts of such requests ask for takes its place.
    """
    done = tried.select("request_id", "vehicle_id")
    asking = requests.select("request_id", "service_id", "origin_zone_id")
    if max_attempts is not None:
        attempts = done.distinct().groupBy("request_id").agg(F.count(F.lit(1)).alias("n_tried"))
        asking = asking.join(attempts, "request_id", "left").filter(F.coalesce("n_tried", F.lit(0)) < max_attempts).drop("n_tried")

    ranked = _ranked_vehicles(vehicles, od, max_eta, k + RANK_PREFIX)
    passed = _tried_ranks(asking, ranked, done)
    many = passed.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > RANK_PREFIX)
    if not many.isEmpty():
        most = done.join(many, "request_id", "left_semi").distinct().groupBy("request_id").count().agg(F.max("count")).first()[0]
        ranked = _ranked_vehicles(vehicles, od, max_eta, k + most)
        passed = _tried_ranks(asking, ranked, done)

    # A tried rank has `free` untried ones before it, so it shifts the candidates from the next one on.
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("position"))
    free = passed.withColumn("free", F.col("position") - nth).filter(F.col("free") < k)
    shifts = free.groupBy("request_id", "free").agg(F.count(F.lit(1)).alias("n")).groupBy("request_id").agg(
        F.collect_list(F.struct("free", "n")).alias("shifts")
    )
    rank = F.col("candidate_rank")
    shift = F.aggregate(F.filter("shifts", lambda x: x["free"] < rank), F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["n"])
    wanted = asking.join(shifts, "request_id", "left").withColumn("candidate_rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    wanted = wanted.withColumn("position", (rank + F.coalesce(shift, F.lit(0))).cast("int")).drop("shifts")
    return wanted.join(ranked, [*RANK_PLACE, "position"]).select("request_id", "vehicle_id", "pickup_seconds", "candidate_rank")


def _ranked_vehicles(vehicles: DataFrame, od: DataFrame, max_eta: float, reach: int) -> DataFrame:
    """The first `reach` idle vehicles of each (zone, service), stored."""
    idle = vehicles.filter("state = 'idle'").select("vehicle_id", "zone_id", F.explode(F.array_distinct("eligible_services")).alias("service_id"))
    near = od.filter(F.col("pickup_seconds") <= max_eta).select(
        F.col("origin_zone_id").alias("zone_id"), F.col("destination_zone_id").alias("origin_zone_id"), "pickup_seconds"
    )
    reachable = idle.join(near, "zone_id").withColumn("_salt", F.pmod(F.hash("vehicle_id"), F.lit(RANK_SALTS)))
    order = [F.col("pickup_seconds"), F.col("vehicle_id")]
    first = F.row_number().over(Window.partitionBy(*RANK_PLACE, "_salt").orderBy(*order))
    partial = reachable.withColumn("_r", first).filter(F.col("_r") <= reach)
    final = F.row_number().over(Window.partitionBy(*RANK_PLACE).orderBy(*order))
    ranked = partial.withColumn("position", final).filter(F.col("position") <= reach)
    return _stored(ranked.select(*RANK_PLACE, "position", "vehicle_id", "pickup_seconds"), "ranked-vehicles")


def _tried_ranks(asking: DataFrame, ranked: DataFrame, done: DataFrame) -> DataFrame:
    """(request_id, position), stored: ranks of a request's place that hold a vehicle it has tried."""
    listed = done.join(ranked.select("vehicle_id"), "vehicle_id", "left_semi").join(asking, "request_id")
    places = ranked.select(*RANK_PLACE, "vehicle_id", "position")
    return _stored(listed.join(places, [*RANK_PLACE, "vehicle_id"]).select("request_id", "position").distinct(), "tried-ranks")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def double_bookings(offers: DataFrame) -> DataFrame:
    """(check, violations): overlapping held periods per vehicle and per request, repeated pairs.

    A period overlaps an earlier one when the latest end so far passes its start; no pairs
    of offers are formed.
    """
    held = offers.filter(F.col("state").isin("accepted", "offered")).select(
        "offer_key", "request_id", "vehicle_id", F.col("offered_at").alias("start"),
        F.timestamp_add("SECOND", F.col("response_seconds").cast("int"), F.col("offered_at")).alias("end"),
    )
    out = None
    for key in ("vehicle_id", "request_id"):
        seen = with_running_max(held, [key], ["start", "end", "offer_key"], F.to_date("start"), "end", "latest")
        row = seen.agg(F.count_if(F.col("latest") > F.col("start")).alias("violations"))
        row = row.select(F.lit(f"overlap_{key}").alias("check"), "violations")
        out = row if out is None else out.unionByName(row)
    repeated = offers.groupBy("request_id", "vehicle_id").count().filter("count > 1")
    pairs = repeated.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("repeated_pair").alias("check"), "violations")
    return out.unionByName(pairs)


def od_violations(od: DataFrame, zones: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(check, violations) for a travel matrix over a zone table: coverage, repeats, row sums."""
    ids = zones.agg(F.collect_set("zone_id")).scalar()
    grid = zones.select(F.col("zone_id").alias("origin_zone_id")).distinct().withColumn("destination_zone_id", F.explode(ids))
    pair = ["origin_zone_id", "destination_zone_id"]
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    sums = od.groupBy("origin_zone_id").agg(F.sum("destination_probability").alias("p"))
    bad_values = (F.col("pickup_seconds") < 0) | (F.col("trip_seconds") <= 0) | ~F.col("destination_probability").between(0, 1)
    return (
        one(grid.join(od, pair, "left_anti"), "missing_pair")
        .unionByName(one(od.join(grid, pair, "left_anti"), "unknown_zone"))
        .unionByName(one(od.groupBy(*pair).count().filter("count > 1"), "repeated_pair"))
        .unionByName(one(sums.filter(F.abs(F.col("p") - 1) > tolerance), "probability_sum"))
        .unionByName(one(od.filter(bad_values), "bad_value"))
    )
