"""Randomized incentive contrasts on driver means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.functions.scalars import any_of, is_finite, safe_div
from farewise.functions.stats import t_ppf
from farewise.operators.quality import check_contract

OUTCOMES = ("participated", "worked_hours", "serviceable_hours")
TIME_ORDER = ("eligibility_at", "offered_at", "decision_at", "shift_start", "shift_end", "outcome_observed_at")


def cohort_rules(baseline: float, target: float, shift_hours: float, columns: Sequence[str]) -> dict[str, Column]:
    """Bad-row conditions of a driver-shift cohort."""
    worked, useful = F.col("worked_hours"), F.col("serviceable_hours")
    rules = {
        "missing_or_nonfinite": any_of([~is_finite(c) for c in ("incentive", *OUTCOMES)]),
        "participation_not_binary": ~F.col("participated").isin(0, 1),
        "unknown_incentive": ~F.col("incentive").isin(baseline, target),
        "hours_out_of_range": (worked < 0) | (worked > shift_hours) | (useful < 0) | (useful > worked),
        "absent_with_hours": (F.col("participated") == 0) & ((worked != 0) | (useful != 0)),
    }
    times = [c for c in TIME_ORDER if c in columns]
    for before, after in zip(times, times[1:]):
        rules[f"{before}_after_{after}"] = F.col(before) > F.col(after)
    return rules


def cohort_violations(
    df: DataFrame, n_shifts: int, baseline: float, target: float, shift_hours: float,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Row rules, driver rules (complete, one arm, no repeats) and calendar mismatches."""
    rows = check_contract(df, cohort_rules(baseline, target, shift_hours, df.columns))
    per_driver = df.groupBy("driver_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("incentive").alias("lo"), F.max("incentive").alias("hi")
    )
    drivers = check_contract(
        per_driver, {"incomplete_driver": F.col("n") != n_shifts, "arm_changes": F.col("lo") != F.col("hi")}
    )
    repeated = df.groupBy("driver_id", "day_id").count().filter("count > 1")
    out = rows.unionByName(drivers).unionByName(
        repeated.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("repeated_shift").alias("rule"), "violations")
    )
    if calendar is not None:
        seen = df.select("day_id").distinct()
        missing = calendar.join(seen, "day_id", "left_anti").unionByName(seen.join(calendar, "day_id", "left_anti"))
        out = out.unionByName(missing.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("calendar_mismatch").alias("rule"), "violations"))
    return out


def driver_means(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean outcome per driver over all eligible shifts, zero shifts included."""
    return df.groupBy(*by, "driver_id").agg(
        F.min("incentive").alias("incentive"),
        F.count(F.lit(1)).alias("n_shifts"),
        *[F.avg(F.col(o).cast("double")).alias(o) for o in OUTCOMES],
    )


def welch_contrast(
    means: DataFrame, baseline: float, target: float, level: float = 0.95, min_drivers: int = 2,
    by: Sequence[str] = (),
) -> DataFrame:
    """Target minus baseline per outcome with the unequal-variance t interval.

    Drivers are the unit. Below `min_drivers` in either arm nothing but counts is shown; with
    zero variance the effect is shown without an interval.
    """
    by = list(by)
    long = means.select(*by, "driver_id", "incentive", *[F.col(o).cast("double").alias(o) for o in OUTCOMES]).unpivot(
        [*by, "driver_id", "incentive"], list(OUTCOMES), "outcome", "value"
    )
    arm = {"baseline": F.col("incentive") == baseline, "target": F.col("incentive") == target}
    stats = long.groupBy(*by, "outcome").agg(
        *[F.count_if(c).alias(f"n_{a}") for a, c in arm.items()],
        *[F.avg(F.when(c, F.col("value"))).alias(f"m_{a}") for a, c in arm.items()],
        *[F.var_samp(F.when(c, F.col("value"))).alias(f"v_{a}") for a, c in arm.items()],
    )
    supported = (F.col("n_baseline") >= min_drivers) & (F.col("n_target") >= min_drivers)
    part = {a: F.col(f"v_{a}") / F.col(f"n_{a}") for a in arm}
    variance = part["baseline"] + part["target"]
    spread = F.pow(part["baseline"], 2) / F.nullif(F.col("n_baseline") - 1, F.lit(0)) + F.pow(part["target"], 2) / F.nullif(F.col("n_target") - 1, F.lit(0))
    measured = supported & (variance > 0)
    shaped = stats.select(
        *by, "outcome", "n_baseline", "n_target",
        F.when(supported, "ok").otherwise("not_identified").alias("status"),
        F.when(supported, F.col("m_baseline")).alias("baseline_mean"),
        F.when(supported, F.col("m_target")).alias("target_mean"),
        F.when(supported, F.col("m_target") - F.col("m_baseline")).alias("effect"),
        F.when(measured, F.sqrt(variance)).alias("standard_error"),
        F.when(measured, safe_div(variance * variance, spread)).alias("degrees_of_freedom"),
    )
    critical = t_ppf((1 + level) / 2, "degrees_of_freedom")
    half = F.col("critical") * F.col("standard_error")
    return shaped.withColumn("critical", critical).withColumns(
        {
            "ci_low": F.col("effect") - half,
            "ci_high": F.col("effect") + half,
            "interval_status": F.when(F.col("standard_error").isNotNull(), "ok").otherwise("interval_unavailable"),
        }
    ).drop("critical")


def conditional_hours(df: DataFrame) -> DataFrame:
    """Mean hours among participating shifts by arm; descriptive, not an effect."""
    return df.filter("participated = 1").groupBy("incentive").agg(
        F.count(F.lit(1)).alias("participating_shifts"),
        F.avg("worked_hours").alias("conditional_worked_hours"),
    ).withColumn("interpretation", F.lit("descriptive"))


def supply_scenario(effects: DataFrame, amounts: DataFrame, baseline: float, target: float, n_drivers: int, n_shifts: int) -> DataFrame:
    """Cohort forecast for each asked incentive amount; only the two randomized levels answer.

    `amounts` and `effects` are short lists; each amount meets the three outcome rows.
    """
    exposure = F.when(F.col("outcome") == "participated", 1.0).otherwise(float(n_drivers * n_shifts))
    asked = amounts.withColumn("outcome", F.explode(F.array(*[F.lit(o) for o in OUTCOMES])))
    joined = asked.join(effects, "outcome").withColumn("scale", exposure)
    at_base, at_target = F.col("amount") == baseline, F.col("amount") == target
    known = (at_base | at_target) & (F.col("status") == "ok")
    status = F.when(~(at_base | at_target), "unsupported_action").otherwise(F.col("status"))
    pick = lambda base, other: F.when(known, F.when(at_base, base).otherwise(other * F.col("scale")))
    return joined.select(
        "amount", "outcome", status.alias("status"),
        F.when(known, F.col("baseline_mean") * F.col("scale")).alias("baseline"),
        F.when(known, F.when(at_base, F.col("baseline_mean")).otherwise(F.col("target_mean")) * F.col("scale")).alias("target"),
        pick(F.lit(0.0), F.col("effect")).alias("change"),
        pick(F.lit(0.0), F.col("ci_low")).alias("ci_low"),
        pick(F.lit(0.0), F.col("ci_high")).alias("ci_high"),
        F.when(known, F.when(at_base, "deterministic_identity").otherwise(F.col("interval_status"))).otherwise("interval_unavailable").alias("interval_status"),
    )
