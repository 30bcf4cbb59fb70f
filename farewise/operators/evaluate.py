"""Monte Carlo method evaluation: bias, error, coverage, tests and pairwise comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.functions.scalars import safe_div
from farewise.functions.stats import binom_test, clopper_pearson, holm_adjust
from farewise.operators.quality import check_contract
from farewise.operators.resample import percentile_interval

CELL = ["dgp_id", "estimator"]


def effect_rows(points: DataFrame, draws: DataFrame, base: DataFrame, level: float = 0.95, floor: float = 0.05, minimum: int = 2) -> DataFrame:
    """theta and elasticity rows with percentile intervals and their status.

    points: effect, outcome, theta; draws: effect, draw_id, theta; base: outcome, baseline.
    """
    interval = percentile_interval(draws, ["effect"], "theta", level)
    joined = points.join(base, "outcome", "left").join(interval, "effect", "left")
    enough = F.coalesce(F.col("n_draws") >= minimum, F.lit(False))
    usable = F.col("baseline") >= floor
    per = lambda c: F.when(usable, F.col(c) / F.col("baseline"))
    return joined.select(
        "effect", "outcome", "theta", F.when(enough, F.col("lower")).alias("theta_lower"), F.when(enough, F.col("upper")).alias("theta_upper"),
        per("theta").alias("elasticity"), F.when(F.col("theta").isNull(), "not_identified").otherwise("ok").alias("status"),
        F.when(enough, "ok").otherwise("interval_unstable").alias("interval_status"),
    )


def method_metrics(effects: DataFrame, truth: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Error, squared error, covered, false positive (only where the truth is zero), width."""
    df = effects if truth is None else effects.join(truth, list(keys), "left")
    lower, upper, true = F.col("theta_lower"), F.col("theta_upper"), F.col("true_theta")
    error = F.col("theta") - true
    return df.withColumns(
        {
            "error": error,
            "squared_error": error * error,
            "covered": (lower <= true) & (true <= upper),
            "false_positive": F.when((true == 0) & lower.isNotNull(), ~((lower <= 0) & (upper >= 0))),
            "interval_width": upper - lower,
            "interval_available": lower.isNotNull() & upper.isNotNull(),
        }
    )


def _rms(c: str) -> Column:
    return F.sqrt(F.avg(F.col(c) * F.col(c)))


def _bounds(df: DataFrame, count: str, denominator: str, prefix: str) -> DataFrame:
    exact = clopper_pearson(count, denominator)
    return df.withColumn("_cp", exact).withColumns(
        {f"{prefix}_lower": F.col("_cp.lower"), f"{prefix}_upper": F.col("_cp.upper")}
    ).drop("_cp")


def aggregate_metrics(metrics: DataFrame, expected_seeds: int, by: Sequence[str] = CELL) -> DataFrame:
    """Bias, RMSE, coverage and false-positive rate per cell, each with its own denominator."""
    stats = metrics.groupBy(*by).agg(
        F.lit(expected_seeds).alias("expected_seeds"),
        F.countDistinct("seed").alias("attempted_seeds"),
        F.count("error").alias("valid_estimates"),
        F.count_if(F.col("error").isNull()).alias("failed_estimates"),
        F.avg("error").alias("bias"),
        _rms("error").alias("rmse"),
        F.count_if("covered").alias("covered_seeds"),
        F.count("covered").alias("coverage_denominator"),
        F.count_if("false_positive").alias("false_positives"),
        F.count("false_positive").alias("false_positive_denominator"),
    )
    rated = stats.withColumns(
        {
            "coverage": safe_div("covered_seeds", "coverage_denominator"),
            "false_positive_rate": safe_div("false_positives", "false_positive_denominator"),
        }
    )
    bounded = _bounds(rated, "covered_seeds", "coverage_denominator", "coverage")
    bounded = _bounds(bounded, "false_positives", "false_positive_denominator", "false_positive")
    complete = (F.col("failed_estimates") == 0) & (F.col("attempted_seeds") == expected_seeds)
    return bounded.withColumn("interval_quality", F.when(complete, "reporting").otherwise("development_or_unstable"))


def supply_benchmark_summary(metrics: DataFrame, limits: Mapping[str, float], by: Sequence[str] = CELL) -> DataFrame:
    """Cell summary with pass/fail checks against declared limits."""
    stats = metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count("theta").alias("valid_points"),
        F.count_if("interval_available").alias("available_intervals"),
        F.avg("error").alias("bias"),
        _rms("error").alias("rmse"),
        _rms("true_theta").alias("no_response_rmse"),
        F.count_if("covered").alias("covered"),
        F.avg("interval_width").alias("mean_interval_width"),
        F.count_if("false_positive").alias("false_positives"),
        F.count("false_positive").alias("null_intervals"),
    )
    rated = stats.withColumns(
        {
            "coverage": safe_div("covered", "available_intervals"),
            "null_false_positive_rate": safe_div("false_positives", "null_intervals"),
        }
    )
    rated = _bounds(rated, "covered", "available_intervals", "coverage")
    good = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "check_available": (F.col("valid_points") == F.col("attempted")) & (F.col("available_intervals") == F.col("attempted")),
        "check_bias": good(F.abs("bias") <= limits["max_bias"]),
        "check_rmse": good(F.col("rmse") <= limits["max_rmse"]),
        "check_coverage": good(F.col("coverage") >= limits["coverage_floor"]),
        "check_false_positives": (F.col("null_intervals") == 0) | good(F.col("null_false_positive_rate") <= limits["max_false_positive_rate"]),
    }
    out = rated.withColumns(checks)
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    return out.withColumn("status", F.when(passed, "controlled_checks_passed").otherwise("controlled_checks_failed"))


def sd_ratio(metrics: DataFrame, se: str = "standard_error", by: Sequence[str] = CELL) -> DataFrame:
    """RMS estimated SE over the empirical SD, only when both use the same seeds."""
    point, error = F.col("theta").isNotNull(), F.col(se).isNotNull()
    stats = metrics.groupBy(*by).agg(
        F.stddev_samp("theta").alias("empirical_sd"),
        F.avg(se).alias("mean_se"),
        _rms(se).alias("rms_se"),
        F.count(se).alias("se_denominator"),
        F.count_if(point != error).alias("unmatched_seeds"),
    )
    status = (
        F.when(F.col("unmatched_seeds") > 0, "unmatched_seed_cohorts")
        .when(F.col("empirical_sd").isNull(), "insufficient_replicates")
        .when(F.col("empirical_sd") == 0, "zero_variance")
        .otherwise("comparable")
    )
    out = stats.withColumn("comparison_status", status)
    return out.withColumn("sd_ratio", F.when(F.col("comparison_status") == "comparable", safe_div("rms_se", "empirical_sd")))


def _compared(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Coverage changes and width ratio of `a` against `b` on seeds where both are available."""
    ok = F.col(f"interval_available_{a}") & F.col(f"interval_available_{b}")
    both = pairs.filter(ok)
    ca, cb = F.col(f"covered_{a}"), F.col(f"covered_{b}")
    ratio = safe_div(f"interval_width_{a}", f"interval_width_{b}")
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("paired_intervals"),
        F.avg(ca.cast("int") - cb.cast("int")).alias("coverage_change"),
        F.count_if(ca & ~cb).alias("coverage_gains"),
        F.count_if(~ca & cb).alias("coverage_losses"),
        F.count(ratio).alias("width_ratio_denominator"),
        F.avg(ratio).alias("mean_width_ratio"),
    )


def _suffixed(df: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    kept = [c for c in ("theta", "error", "covered", "interval_width", "interval_available", "interval_status") if c in df.columns]
    return df.select(*keys, *[F.col(c).alias(f"{c}_{suffix}") for c in kept])


def interval_comparison(metrics: DataFrame, baseline: str = "percentile", by: Sequence[str] = CELL) -> DataFrame:
    """Each interval method against the baseline method on common seeds."""
    keys = [*by, "seed"]
    base = _suffixed(metrics.filter(F.col("interval_method") == baseline), keys, "base")
    own = _suffixed(metrics, [*keys, "interval_method"], "new")
    pairs = own.join(base, keys)
    counts = metrics.groupBy(*by, "interval_method").agg(
        F.count_if("interval_available").alias("available_intervals"),
        F.count_if(~F.col("interval_available")).alias("unavailable_intervals"),
        F.avg("interval_width").alias("mean_width"),
    )
    return counts.join(_compared(pairs, [*by, "interval_method"], "new", "base"), [*by, "interval_method"], "left")


def paired_estimators(metrics: DataFrame, a: str, b: str, by: Sequence[str] = ("dgp_id",)) -> DataFrame:
    """Estimator `a` minus `b` on common seeds: error, coverage and width."""
    keys = [*by, "seed"]
    pairs = _suffixed(metrics.filter(F.col("estimator") == a), keys, "a").join(
        _suffixed(metrics.filter(F.col("estimator") == b), keys, "b"), keys
    )
    points = pairs.groupBy(*by).agg(
        F.count(F.col("theta_a") - F.col("theta_b")).alias("paired_points"),
        F.avg(F.col("error_a") - F.col("error_b")).alias("mean_error_difference"),
    )
    return points.join(_compared(pairs, by, "a", "b"), list(by), "left")


def score_summary(metrics: DataFrame, expected: int, se: str = "standard_error", by: Sequence[str] = CELL) -> DataFrame:
    """Bias, RMSE, SE ratio and coverage with its exact interval, per output."""
    ratio = sd_ratio(metrics, se, by).select(*by, "empirical_sd", "rms_se", F.col("sd_ratio").alias("se_ratio"))
    cells = aggregate_metrics(metrics, expected, by)
    widths = metrics.groupBy(*by).agg(F.avg("interval_width").alias("mean_width"), F.count_if("interval_available").alias("available_intervals"))
    kept = cells.select(
        *by, "expected_seeds", "attempted_seeds", "bias", "rmse", "covered_seeds", "coverage_denominator", "coverage",
        "coverage_lower", "coverage_upper", "false_positives", "false_positive_denominator",
    )
    return kept.join(ratio, list(by)).join(widths, list(by))


def coverage_tests(summary: DataFrame, nominal: float = 0.95, family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """One-sided exact tests of undercoverage (and excess false positives), Holm-adjusted.

    A cell contributes one row per check whose denominator is positive.
    """
    keys = [c for c in (*CELL, *family) if c in summary.columns]
    keys = list(dict.fromkeys(keys))
    checks = F.explode(
        F.array(
            F.struct(F.lit("covered").alias("check"), F.col("covered_seeds").alias("n_success"), F.col("coverage_denominator").alias("n_trials")),
            F.struct(F.lit("false_positive").alias("check"), F.col("false_positives").alias("n_success"), F.col("false_positive_denominator").alias("n_trials")),
        )
    ).alias("c")
    rows = summary.select(*keys, checks).select(*keys, "c.*").filter("n_trials > 0")
    low = binom_test("n_success", "n_trials", nominal, "less")
    high = binom_test("n_success", "n_trials", 1 - nominal, "greater")
    tested = rows.withColumn("p_value", F.when(F.col("check") == "covered", low).otherwise(high))
    return holm_adjust(tested, "p_value", list(family)).withColumn("rejected", F.col("p_holm") < alpha)


def method_overview(cells: DataFrame, by: Sequence[str] = ("dgp_id", "estimator")) -> DataFrame:
    """Worst bias and RMSE and the coverage range over the cells of a method."""
    return cells.groupBy(*by).agg(
        F.max(F.abs("bias")).alias("max_abs_bias"), F.max("rmse").alias("max_rmse"),
        F.min("coverage").alias("coverage_min"), F.max("coverage").alias("coverage_max"),
    )


def audit_rows(rows: DataFrame, fit_keys: Sequence[str], fit_columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """(rule, violations): stored flags against recomputed ones, and fit-level constancy."""
    fresh = method_metrics(rows.select("*", *[F.col(c).alias(f"old_{c}") for c in ("error", "covered")]))
    flags = check_contract(
        fresh,
        {
            "error_mismatch": ~F.coalesce(F.abs(F.col("error") - F.col("old_error")) <= tolerance, F.col("error").isNull() & F.col("old_error").isNull()),
            "coverage_mismatch": ~F.col("covered").eqNullSafe(F.col("old_covered")),
            "reversed_interval": F.col("theta_lower") > F.col("theta_upper"),
            "interval_without_point": F.col("theta").isNull() & F.col("theta_lower").isNotNull(),
        },
    )
    # max and min with NULL counted as a value: cheaper than a distinct count per column.
    spread = rows.groupBy(*fit_keys).agg(
        *[((F.max(c) != F.min(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))).alias(c) for c in fit_columns]
    )
    constancy = check_contract(spread, {f"{c}_varies": F.col(c) for c in fit_columns})
    return flags.unionByName(constancy)


def contrast_family_summary(records: DataFrame, by: Sequence[str], tests_in: Column, nominal: float = 0.95) -> DataFrame:
    """Per family cell: bias, RMSE, sign errors, coverage with exact bounds and Holm p-value.

    `tests_in` says which cells belong to the tested family.
    """
    stats = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count("theta").alias("valid"),
        F.count_if("interval_available").alias("intervals"),
        F.avg("error").alias("bias"),
        _rms("error").alias("rmse"),
        F.count_if((F.signum("theta") != F.signum("true_theta")) & (F.col("true_theta") != 0)).alias("sign_errors"),
        F.count_if("covered").alias("covered"),
        F.avg("interval_width").alias("mean_width"),
        F.count_if((F.col("theta_lower") > 0) | (F.col("theta_upper") < 0)).alias("zero_exclusions"),
    )
    rated = _bounds(stats.withColumn("coverage", safe_div("covered", "intervals")), "covered", "intervals", "coverage")
    p = binom_test("covered", "intervals", nominal, "less")
    tested = rated.withColumn("undercoverage_p", p).withColumn("_family_p", F.when(tests_in, F.col("undercoverage_p")))
    return holm_adjust(tested, "_family_p", [], "undercoverage_holm").drop("_family_p")


def paired_rmse(records: DataFrame, candidate: str, references: Sequence[str], by: Sequence[str] = ("dgp_id",)) -> DataFrame:
    """RMSE of the candidate and each reference on the cases both estimate."""
    keys = [*by, "seed"]
    new = records.filter(F.col("estimator") == candidate).select(*keys, F.col("error").alias("new"))
    old = records.filter(F.col("estimator").isin(list(references))).select(*keys, F.col("estimator").alias("reference"), F.col("error").alias("old"))
    joined = new.join(old, keys)
    common = F.col("new").isNotNull() & F.col("old").isNotNull()
    mean_square = lambda c: F.sqrt(F.avg(F.when(common, F.col(c) * F.col(c))))
    return joined.groupBy("reference", *by).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(common).alias("common_valid"),
        mean_square("new").alias("new_rmse"), mean_square("old").alias("reference_rmse"),
    )


def gates(summary: DataFrame, max_rmse: float, max_bias: float, alpha: float) -> DataFrame:
    """Family-wide acceptance: availability and recovery, and no rejected coverage."""
    complete = (F.col("valid") == F.col("attempted")) & (F.col("intervals") == F.col("attempted"))
    recovered = complete & (F.col("rmse") <= max_rmse) & (F.abs("bias") <= max_bias)
    return summary.agg(
        F.bool_and(F.coalesce(recovered, F.lit(False))).alias("recovery_and_availability"),
        F.bool_and(F.coalesce(F.col("undercoverage_holm") >= alpha, F.lit(True))).alias("no_undercoverage_rejection"),
    )
