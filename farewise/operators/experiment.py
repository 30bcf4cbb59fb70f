"""Switchback schedules, power, exposure checks and paired analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.functions.scalars import hash_bits
from farewise.functions.stats import binom_test, normal_quantile, t_ppf


def switchback_schedule(
    clusters: DataFrame, pairs: int, start: Column, block_minutes: int, washout_minutes: int,
    candidate: str, seed: int, mode: str = "AB",
) -> DataFrame:
    """Two blocks per pair in an order drawn by a keyed coin; washout after each block.

    The coin depends on (seed, cluster, pair) only, so any task can redraw it.
    """
    pair = F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("pair")
    position = F.explode(F.array(F.lit(0), F.lit(1))).alias("position")
    cells = clusters.select(F.col("cluster_id"), pair).select("*", position)
    flip = hash_bits(F.lit(seed), "cluster_id", "pair") % 2
    treated = (F.col("position") + flip) % 2 == 1
    offset = (2 * F.col("pair") + F.col("position")) * (block_minutes + washout_minutes)
    begin = F.timestamp_add("MINUTE", offset.cast("int"), start)
    pair_id = F.concat_ws("-", F.col("cluster_id").cast("string"), F.col("pair").cast("string"))
    candidate_id = candidate if mode == "AB" else "baseline"
    return cells.select(
        "cluster_id", pair_id.alias("pair_id"),
        F.concat_ws("-", pair_id, F.col("position").cast("string")).alias("block_id"),
        F.when(treated, "treatment").otherwise("control").alias("arm"),
        F.when(treated, candidate_id).otherwise("baseline").alias("policy_id"),
        begin.alias("start"),
        F.timestamp_add("MINUTE", F.lit(block_minutes), begin).alias("end"),
        F.lit(0.5).alias("assignment_probability"),
    )


def power_table(differences: DataFrame, by: Sequence[str], value: str, alpha: float, power: float, effect: float) -> DataFrame:
    """Pairs needed per stratum by the normal approximation, and whether there are enough."""
    reach = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    sd = F.col("paired_difference_sd")
    needed = F.greatest(F.lit(2), F.ceil(F.pow(reach * sd / effect, 2)))
    stats = differences.groupBy(*by).agg(F.count(value).alias("scheduled_pairs"), F.stddev_samp(value).alias("paired_difference_sd"))
    usable = sd > 0
    return stats.withColumn("required_pairs", F.when(usable, needed)).withColumns(
        {
            "sufficient": F.col("scheduled_pairs") >= F.col("required_pairs"),
            "status": F.when(F.coalesce(usable, F.lit(False)), "normal_approximation").otherwise("unavailable_missing_variance"),
        }
    )


def exposure_violations(schedule: DataFrame, observations: DataFrame, metric: str, unit: str) -> DataFrame:
    """(check, violations) of outcomes against the frozen schedule."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    plan = schedule.select("block_id", "policy_id")
    joined = plan.join(observations.select("block_id", "applied_policy_id"), "block_id")
    return (
        count(observations.join(plan, "block_id", "left_anti"), "unknown_block")
        .unionByName(count(observations.groupBy("block_id").count().filter("count > 1"), "duplicate_block"))
        .unionByName(count(joined.filter("applied_policy_id <> policy_id"), "wrong_policy"))
        .unionByName(count(observations.filter((F.col("metric") != metric) | (F.col("unit") != unit)), "metric_or_unit"))
        .unionByName(count(observations.filter(F.col("value").isNull() | F.isnan("value")), "missing_value"))
        .unionByName(count(plan.join(observations, "block_id", "left_anti"), "missing_block"))
    )


def pair_differences(schedule: DataFrame, observations: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Treatment minus control per pair; NULL when either block lacks an outcome."""
    joined = schedule.select("block_id", "pair_id", "arm", *keep).join(observations.select("block_id", "value"), "block_id", "left")
    at = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("value")))
    return joined.groupBy(*keep, "pair_id").agg(at("treatment").alias("treatment"), at("control").alias("control")).withColumn(
        "difference", F.col("treatment") - F.col("control")
    )


def paired_effect(
    schedule: DataFrame, observations: DataFrame, alpha: float = 0.05, prediction: float | None = None,
    mode: str = "AB", by: Sequence[str] = (),
) -> DataFrame:
    """Mean paired difference with its t interval; any missing block withholds the interval."""
    by = list(by)
    pairs = pair_differences(schedule, observations, by)
    d = F.col("difference")
    stats = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("expected_pairs"),
        F.count(d).alias("complete_pairs"),
        (F.count_if(F.col("treatment").isNull()) + F.count_if(F.col("control").isNull())).alias("missing_blocks"),
        F.avg(d).alias("observed_effect"),
        F.stddev_samp(d).alias("_sd"),
    )
    valid = (F.col("missing_blocks") == 0) & (F.col("complete_pairs") >= 2)
    se = F.when(valid, F.col("_sd") / F.sqrt("complete_pairs"))
    shaped = stats.withColumns(
        {"standard_error": se, "critical": t_ppf(1 - alpha / 2, F.when(valid, F.col("complete_pairs") - 1))}
    )
    half = F.col("critical") * F.col("standard_error")
    out = shaped.withColumns({"lower": F.col("observed_effect") - half, "upper": F.col("observed_effect") + half})
    zero = F.when(valid & F.lit(mode == "AA"), (F.col("lower") <= 0) & (F.col("upper") >= 0))
    error = F.when(valid, F.col("observed_effect") - F.lit(prediction)) if prediction is not None else F.lit(None).cast("double")
    return out.withColumns(
        {
            "status": F.when(valid, "completed").otherwise("incomplete"),
            "aa_zero_in_interval": zero,
            "forecast_error": error,
        }
    ).drop("_sd", "critical")


def sample_ratio(schedule: DataFrame, observations: DataFrame, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Exact binomial test that observed blocks split evenly between the arms."""
    observed = schedule.join(observations.select("block_id"), "block_id", "left_semi")
    counts = observed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observed_blocks"), F.count_if(F.col("arm") == "control").alias("control_blocks")
    )
    tested = counts.withColumn("p_value", binom_test("control_blocks", "observed_blocks", 0.5))
    return tested.withColumn("sample_ratio_status", F.when(F.col("p_value") < alpha, "warning").otherwise("ok"))
