"""Demand plans: requests per hour by block and service, with their consistency checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.functions.scalars import any_of, seconds_between
from farewise.operators.estimate import WEIGHT, Model
from farewise.operators.quality import check_contract
from farewise.operators.scenario import tiling


def demand_plan(
    model: Model, blocks: DataFrame, gates: DataFrame, scenario: dict, key: Sequence[str] = ("zone_id", "block_start")
) -> DataFrame:
    """One row per block and service: expected bookings and hourly rates, baseline and target.

    `gates` is the one-row-per-scenario table of identification, validity and support; rates
    are NULL unless every gate passes. Blocks are expanded in place, without a shuffle.
    """
    row = gates.filter(F.col("scenario_id") == scenario["scenario_id"])
    status = row.select(
        F.when(~F.col("probability_valid"), "invalid_probability")
        .when(~F.col("identified"), "not_identified")
        .when(F.col("target_support") != "ok", F.col("target_support"))
        .when(F.col("baseline_support") != "ok", F.col("baseline_support"))
        .otherwise("ok")
    ).scalar()
    logs = [[F.ln(F.lit(float(scenario[f"multiplier_{s}{i}"]))) for s in "xy"] for i in (0, 1)]
    shares = [[model.baseline(j) + model.effect(j, *logs[i]) for j in range(2)] for i in (0, 1)]
    sessions = F.col(WEIGHT).cast("double")
    services = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("service_id"),
                    (shares[0][j] * sessions).alias("baseline_expected"),
                    (shares[1][j] * sessions).alias("expected"),
                )
                for j, name in enumerate("XY")
            ]
        )
    ).alias("s")
    hours = seconds_between("block_start", "block_end") / 3600
    usable = F.col("status") == "ok"
    return (
        blocks.select(*key, *[c for c in ("block_end",) if c not in key], F.col(WEIGHT).alias("quote_sessions"), hours.alias("block_hours"), services)
        .withColumn("status", status)
        .select(
            *key, "block_end", "block_hours", "quote_sessions", "s.service_id", "status",
            F.when(usable, F.col("s.expected")).alias("expected_bookings"),
            F.when(usable, F.col("s.baseline_expected")).alias("baseline_expected_bookings"),
            F.when(usable, F.col("s.expected") / F.col("block_hours")).alias("request_rate"),
            F.when(usable, F.col("s.baseline_expected") / F.col("block_hours")).alias("baseline_request_rate"),
        )
    )


def demand_plans(
    model: Model, blocks: DataFrame, gates: DataFrame, requests: DataFrame, key: Sequence[str] = ("zone_id", "block_start")
) -> DataFrame:
    """`demand_plan` of every request over the blocks of its context set, behind its scenario_id, in one job.

    Base shares are computed once per block; blocks then meet the requests of all contexts and of their own zone by
    the name of the set. A request without gates has a NULL status and NULL rates.
    """
    ends = [c for c in ("block_end",) if c not in key]
    own = F.concat(F.lit("zone_"), F.col("zone_id").cast("string"))
    based = blocks.select(
        *key, *ends, F.col(WEIGHT).alias("quote_sessions"), (seconds_between("block_start", "block_end") / 3600).alias("block_hours"),
        model.baseline(0).alias("_bx"), model.baseline(1).alias("_by"), F.explode(F.array(F.lit("all"), own)).alias("target_context_set"),
    )
    status = (
        F.when(~F.col("probability_valid"), "invalid_probability")
        .when(~F.col("identified"), "not_identified")
        .when(F.col("target_support") != "ok", F.col("target_support"))
        .when(F.col("baseline_support") != "ok", F.col("baseline_support"))
        .when(F.col("probability_valid"), "ok")
    )
    logs = [[F.ln(F.col(f"multiplier_{s}{i}")) for s in "xy"] for i in (0, 1)]
    effects = [model.effect(j, *logs[i]).alias(f"_e{s}{i}") for i in (0, 1) for j, s in enumerate("xy")]
    asked = requests.join(gates, "scenario_id", "left").select("scenario_id", "target_context_set", status.alias("status"), *effects)
    sessions = F.col("quote_sessions").cast("double")
    services = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s.upper()).alias("service_id"),
                    *[((F.col(f"_b{s}") + F.col(f"_e{s}{i}")) * sessions).alias(n) for i, n in ((0, "baseline_expected"), (1, "expected"))],
                )
                for s in "xy"
            ]
        )
    ).alias("s")
    usable = F.col("status") == "ok"
    rows = based.join(asked, "target_context_set").select("scenario_id", *key, *ends, "block_hours", "quote_sessions", "status", services)
    return rows.select(
        "scenario_id", *key, *ends, "block_hours", "quote_sessions", "s.service_id", "status",
        F.when(usable, F.col("s.expected")).alias("expected_bookings"),
        F.when(usable, F.col("s.baseline_expected")).alias("baseline_expected_bookings"),
        F.when(usable, F.col("s.expected") / F.col("block_hours")).alias("request_rate"),
        F.when(usable, F.col("s.baseline_expected") / F.col("block_hours")).alias("baseline_request_rate"),
    )


def plan_summary(plan: DataFrame) -> DataFrame:
    """Sessions, expected bookings and choices outside both services over the plan."""
    x = F.col("service_id") == "X"
    return plan.agg(
        F.sum(F.when(x, F.col("quote_sessions"))).alias("quote_sessions"),
        F.sum("baseline_expected_bookings").alias("baseline_expected_bookings"),
        F.sum("expected_bookings").alias("expected_bookings"),
        (F.sum(F.when(x, F.col("quote_sessions"))) - F.sum("expected_bookings")).alias("expected_outside_choices"),
    )


def overlapping(blocks: DataFrame, start: Column, end: Column) -> DataFrame:
    return blocks.filter((F.col("block_start") < end) & (F.col("block_end") > start))


def tile_violations(blocks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per zone: blocks touching the horizon and whether they tile it exactly."""
    t = tiling(overlapping(blocks, start, end), start, end)
    clean = F.col("starts_on_horizon") & F.col("ends_on_horizon") & (F.col("broken_joints") == 0)
    return t.withColumn("tiles", clean)


def roster_rules(zones: Sequence[int], start: Column) -> dict[str, Column]:
    """Bad-row conditions of a vehicle roster at the horizon start."""
    services = F.col("eligible_services")
    in_shift = (F.col("shift_start") <= start) & (start < F.col("shift_end"))
    return {
        "blank_id": any_of([F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in ("vehicle_id", "driver_id", "shift_id")]),
        "unknown_zone": ~F.coalesce(F.col("zone_id").isin(list(zones)), F.lit(False)),
        "bad_services": F.coalesce(
            (F.size(services) == 0) | (F.size(F.array_except(services, F.array(F.lit("X"), F.lit("Y")))) > 0)
            | (F.size(F.array_distinct(services)) != F.size(services)), F.lit(True),
        ),
        "bad_charge": ~F.coalesce(F.col("soc").between(0, 1) & ~F.isnan(F.col("soc").cast("double")), F.lit(False)),
        "empty_shift": ~F.coalesce(F.col("shift_end") > F.col("shift_start"), F.lit(False)),
        "bad_state": ~F.coalesce(F.col("state").isin("idle", "offline"), F.lit(False)),
        "idle_out_of_shift": (F.col("state") == "idle") & ~in_shift,
    }


def roster_violations(roster: DataFrame, zones: Sequence[int], start: Column) -> DataFrame:
    """Rule violations plus repeated vehicle, driver and shift ids."""
    out = check_contract(roster, roster_rules(zones, start))
    for key in ("vehicle_id", "driver_id", "shift_id"):
        extra = roster.groupBy(key).count().filter("count > 1")
        out = out.unionByName(
            extra.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"repeated_{key}").alias("rule"), "violations")
        )
    return out


def plan_reconciliation(plan: DataFrame, tolerance: float = 1e-9, key: Sequence[str] = ("zone_id", "block_start")) -> DataFrame:
    """Rates times hours against bookings, shares per block, and block completeness."""
    near = lambda a, b: F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(b))
    rows = check_contract(
        plan,
        {
            "rate_times_hours": ~near(F.col("request_rate") * F.col("block_hours"), F.col("expected_bookings")),
            "baseline_rate_times_hours": ~near(F.col("baseline_request_rate") * F.col("block_hours"), F.col("baseline_expected_bookings")),
            "negative_bookings": (F.col("expected_bookings") < 0) | (F.col("baseline_expected_bookings") < 0),
        },
    )
    per_block = plan.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("service_id").alias("s"), F.sum("expected_bookings").alias("e"),
        F.sum("baseline_expected_bookings").alias("b"), F.min("quote_sessions").alias("lo"), F.max("quote_sessions").alias("hi"),
    )
    blocks = check_contract(
        per_block,
        {
            "incomplete_block": (F.col("n") != 2) | (F.col("s") != 2),
            "sessions_differ": F.col("lo") != F.col("hi"),
            "bookings_exceed_sessions": (F.col("e") > F.col("hi") * (1 + tolerance)) | (F.col("b") > F.col("hi") * (1 + tolerance)),
        },
    )
    return rows.unionByName(blocks)


def truth_plan(plan: DataFrame, truth: DataFrame, theta: Sequence[Sequence[float]], scenario: dict, key: Sequence[str] = ("zone_id", "block_start")) -> DataFrame:
    """The plan with bookings implied by true base shares b_x, b_y and true effects."""
    joined = plan.join(truth.select(*key, "b_x", "b_y"), list(key), "left")
    logs = [[F.ln(F.lit(float(scenario[f"multiplier_{s}{i}"]))) for s in "xy"] for i in (0, 1)]

    def share(i: int) -> Column:
        of = [F.col(f"b_{s}") + float(theta[j][0]) * logs[i][0] + float(theta[j][1]) * logs[i][1] for j, s in enumerate("xy")]
        return F.when(F.col("service_id") == "X", of[0]).otherwise(of[1])

    bookings = {"expected_bookings": share(1) * F.col("quote_sessions"), "baseline_expected_bookings": share(0) * F.col("quote_sessions")}
    out = joined.withColumns(bookings)
    return out.withColumns(
        {
            "request_rate": F.col("expected_bookings") / F.col("block_hours"),
            "baseline_request_rate": F.col("baseline_expected_bookings") / F.col("block_hours"),
        }
    ).drop("b_x", "b_y")
