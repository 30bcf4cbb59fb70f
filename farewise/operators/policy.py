"""Policy comparison: paired summaries, decisions, regret and action values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewise.functions.scalars import is_finite, safe_div
from farewise.functions.stats import t_ppf
from farewise.operators.choice import PRICE_LEVELS, price_key
from farewise.operators.estimate import WEIGHT, Model
from farewise.operators.resample import interval_stability, percentile_interval
from farewise.operators.scenario import STRATUM, _keyed

# The nine joint price actions, unchanged prices first, and the tie tolerance.
UNCHANGED = (1.0, 1.0)
ACTIONS = (UNCHANGED, *[(x, y) for x in PRICE_LEVELS for y in PRICE_LEVELS if (x, y) != UNCHANGED])
TIE_TOLERANCE = 1e-10


# --- trajectory summaries -----------------------------------------------------------------

def policy_metrics(records: DataFrame, costs: Mapping[str, float | None]) -> DataFrame:
    """Unserved share, gross value and surplus; surplus only when every cost is declared."""
    known = all(costs.get(c) is not None for c in ("per_completed_trip", "per_online_hour", "per_horizon"))
    ok = F.col("status") == "succeeded"
    gross = F.col("total_driver_pay")
    if known:
        spent = F.col("completed_trips") * costs["per_completed_trip"] + F.col("online_hours") * costs["per_online_hour"] + costs["per_horizon"]
        surplus = gross - F.col("total_driver_pay") - spent
    else:
        surplus = F.lit(None).cast("double")
    unserved = safe_div(F.col("expired_requests") + F.col("canceled_requests"), "created_requests")
    return records.withColumns(
        {
            "unserved_fraction": F.when(ok, unserved),
            "gross_booking_value": F.when(ok, gross),
            "conditional_surplus": F.when(ok, surplus),
        }
    )


def _long(records: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    cast = [F.col(m).cast("double").alias(m) for m in metrics]
    return records.select(*keys, "status", *cast).unpivot([*keys, "status"], list(metrics), "metric", "value")


def paired_differences(
    records: DataFrame, baseline: str, metrics: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(by, policy, seed, metric): baseline value, target value, difference where both count.

    A full outer join on the seed keeps attempts that miss either side; a pair counts only
    when both runs succeeded with finite values.
    """
    by = list(by)
    long = _long(records, [*by, "policy_id", "seed"], metrics)
    base = long.filter(F.col("policy_id") == baseline).select(*by, "seed", "metric", F.col("status").alias("s0"), F.col("value").alias("v0"))
    others = long.filter(F.col("policy_id") != baseline).select(*by, "policy_id", "seed", "metric", F.col("status").alias("s1"), F.col("value").alias("v1"))
    grid = others.select(*by, "policy_id").distinct().join(base, by) if by else _each(others.select("policy_id").distinct(), base)
    joined = grid.join(others, [*by, "policy_id", "seed", "metric"], "full_outer")
    good = F.coalesce((F.col("s0") == "succeeded") & (F.col("s1") == "succeeded"), F.lit(False)) & is_finite("v0") & is_finite("v1")
    return joined.select(
        *by, "policy_id", "seed", "metric",
        F.when(good, F.col("v0")).alias("baseline_value"), F.when(good, F.col("v1")).alias("target_value"),
        F.when(good, F.col("v1") - F.col("v0")).alias("difference"),
    )


def _each(policies: DataFrame, base: DataFrame) -> DataFrame:
    """Repeat the baseline rows for every candidate in the (declared, short) policy list."""
    names = policies.agg(F.collect_set("policy_id")).scalar()
    return base.withColumn("policy_id", F.explode(names))


def paired_summary(pairs: DataFrame, n_seeds: int, level: float = 0.95, by: Sequence[str] = (), complete_only: bool = False) -> DataFrame:
    """Means, mean difference and Student-t interval per policy and metric.

    `complete_only` withholds the interval unless every attempted seed forms a valid pair.
    """
    keys = [*by, "policy_id", "metric"]
    stats = pairs.groupBy(*keys).agg(
        F.count("difference").alias("available_pairs"),
        F.avg("baseline_value").alias("baseline_mean"),
        F.avg("target_value").alias("target_mean"),
        F.avg("difference").alias("delta_mean"),
        F.stddev_samp("difference").alias("_sd"),
    )
    n = F.col("available_pairs")
    enough = (n == n_seeds) & (n > 1) if complete_only else n > 1
    se = F.when(enough, F.col("_sd") / F.sqrt(n))
    shaped = stats.withColumns({"_se": se, "_t": t_ppf((1 + level) / 2, F.when(enough, n - 1))})
    return shaped.select(
        *keys, F.lit(n_seeds).alias("attempted_pairs"), "available_pairs", (F.lit(n_seeds) - n).alias("unavailable_pairs"),
        "baseline_mean", "target_mean", "delta_mean",
        (F.col("delta_mean") - F.col("_t") * F.col("_se")).alias("delta_lower"),
        (F.col("delta_mean") + F.col("_t") * F.col("_se")).alias("delta_upper"),
        F.when(n == n_seeds, "ok").when(n > 0, "partial").otherwise("unavailable").alias("status"),
    )


def model_draw_intervals(
    draws: DataFrame, baseline: str, metrics: Sequence[str], n_draws: int, replicates: int, level: float = 0.95
) -> DataFrame:
    """Percentile interval of per-draw mean differences; every draw must be complete.

    draws: draw_id, policy_id, seed, status and metric columns. Two aggregation levels: mean
    difference per draw, then percentiles over draws.
    """
    pairs = paired_differences(draws, baseline, metrics, ["draw_id"])
    per_draw = pairs.groupBy("policy_id", "metric", "draw_id").agg(
        F.count("difference").alias("n"), F.count(F.lit(1)).alias("rows"), F.avg("difference").alias("mean")
    )
    usable = per_draw.withColumn("mean", F.when((F.col("n") == replicates) & (F.col("rows") == replicates), F.col("mean")))
    keys = ["policy_id", "metric"]
    interval = percentile_interval(usable, keys, "mean", level)
    stable = interval_stability(usable, keys, "mean", level=level).select(*keys, "relative_width_change", "unstable")
    joined = interval.join(stable, keys, "left")
    complete = (F.col("n_draws") >= 20) & (F.col("n_draws") == n_draws)
    return joined.select(
        *keys, F.col("n_draws").alias("valid_model_draws"),
        F.when(complete, F.col("lower")).alias("model_delta_lower"), F.when(complete, F.col("upper")).alias("model_delta_upper"),
        F.when(~complete, "unavailable").when(F.col("unstable"), "unstable").otherwise("available").alias("interval_status"),
    )


def policy_summary(
    points: DataFrame, draws: DataFrame, baseline: str, metrics: Sequence[str], n_seeds: int, n_draws: int,
    replicates: int, level: float = 0.95, declared: str = "declared_rules",
) -> DataFrame:
    """Every candidate x sensitivity x metric, with model-draw intervals for declared rules."""
    pairs = paired_differences(points, baseline, metrics, ["sensitivity_id"])
    summary = paired_summary(pairs, n_seeds, level, ["sensitivity_id"], complete_only=True)
    model = model_draw_intervals(draws, baseline, metrics, n_draws, replicates, level).withColumn("sensitivity_id", F.lit(declared))
    joined = summary.join(model, ["sensitivity_id", "policy_id", "metric"], "left")
    whole = F.col("available_pairs") == n_seeds
    return joined.withColumns(
        {
            "model_delta_lower": F.when(whole, F.col("model_delta_lower")),
            "model_delta_upper": F.when(whole, F.col("model_delta_upper")),
            "interval_status": F.when(whole, F.coalesce("interval_status", F.lit("unavailable"))).otherwise("unavailable"),
        }
    )


# --- decisions ----------------------------------------------------------------------------

def _passes() -> Column:
    within = F.when(F.col("direction") == "maximum", F.col("target_mean") <= F.col("limit")).otherwise(F.col("target_mean") >= F.col("limit"))
    return F.coalesce(within & (F.col("unavailable_pairs") == 0), F.lit(False))


def decide(
    summary: DataFrame, guardrails: DataFrame, metric: str, minimum_gain: float, maximize: bool = True,
    declared: str = "declared_rules", order: str | None = None,
) -> DataFrame:
    """Per candidate: conservative gain, reasons, status and whether it is selected.

    Every guardrail must hold under every sensitivity, the objective must stay robust under
    each of them, and the best qualifying score wins. Ties go to the policy declared first: the least
    value of column `order` of the summary, the policy name where no order is declared.
    """
    sign = 1.0 if maximize else -1.0
    bound = F.col("model_delta_lower" if maximize else "model_delta_upper") * sign
    robust = F.col("delta_lower" if maximize else "delta_upper") * sign
    objective = summary.filter(F.col("metric") == metric)
    head = objective.filter(F.col("sensitivity_id") == declared).select(
        "policy_id", F.col(order or "policy_id").alias("_order"), F.col("target_mean").alias("score"), bound.alias("conservative_gain"),
        F.array_compact(
            F.array(
                F.when(F.coalesce("interval_status", F.lit("")) != "available", F.lit("interval unavailable or unstable")),
                F.when(~F.coalesce(bound >= minimum_gain, F.lit(False)), F.lit("minimum gain not established")),
            )
        ).alias("own"),
    )
    fragile = objective.filter((F.col("sensitivity_id") != declared) & ~F.coalesce(robust >= minimum_gain, F.lit(False)))
    fragile = fragile.select("policy_id", F.concat(F.lit("objective not robust under "), "sensitivity_id").alias("reason"))
    checked = summary.join(guardrails, "metric").withColumn("passed", _passes())
    failed = checked.filter(~F.col("passed")).select("policy_id", F.concat(F.lit("guardrail "), "metric", F.lit(" failed under "), "sensitivity_id").alias("reason"))
    problems = fragile.unionByName(failed).groupBy("policy_id").agg(F.array_sort(F.collect_list("reason")).alias("other"))
    out = head.join(problems, "policy_id", "left").select(
        "policy_id", "_order", "score", "conservative_gain",
        F.concat("own", F.coalesce("other", F.array().cast("array<string>"))).alias("reasons"),
    )
    qualifies = F.size("reasons") == 0
    best = Window.partitionBy(qualifies).orderBy((F.col("score") * sign).desc(), "_order", "policy_id")
    return out.withColumns(
        {
            "status": F.when(qualifies, "development_candidate").otherwise("not_recommended"),
            "selected": qualifies & (F.row_number().over(best) == 1),
        }
    ).drop("_order")


def frozen_regret(
    summary: DataFrame, guardrails: DataFrame, metric: str, chosen: str, maximize: bool = True,
    declared: str = "declared_rules", order: str | None = None,
) -> DataFrame:
    """Regret of an already chosen policy against the best feasible one; nothing is reselected.

    A policy is feasible when every guardrail holds under every sensitivity of the summary; values
    are those of the declared one. Ties go to the policy declared first.
    """
    sign = 1.0 if maximize else -1.0
    complete = summary.filter((F.col("unavailable_pairs") == 0) & F.col("target_mean").isNotNull())
    objective = complete.filter((F.col("metric") == metric) & (F.col("sensitivity_id") == declared))
    scores = objective.select("policy_id", F.col(order or "policy_id").alias("_order"), F.col("target_mean").alias("value"))
    held = summary.join(guardrails, "metric").groupBy("policy_id", "metric").agg((F.count_if(~_passes()) == 0).alias("held"))
    kept = held.groupBy("policy_id").agg(F.count_if("held").alias("n"))
    checks = guardrails.select("metric").distinct().agg(F.count(F.lit(1))).scalar()
    marked = scores.join(kept, "policy_id", "left").withColumn("feasible", F.coalesce("n", F.lit(0)) == checks)
    best = marked.agg(
        F.min_by("policy_id", F.when(F.col("feasible"), F.struct(-F.col("value") * sign, "_order", "policy_id"))).alias("best_policy_id"),
        F.max(F.when(F.col("feasible"), F.col("value") * sign)).alias("best"),
        F.max(F.when(F.col("policy_id") == chosen, F.col("value"))).alias("chosen_value"),
        F.coalesce(F.max(F.when(F.col("policy_id") == chosen, F.col("feasible"))), F.lit(False)).alias("chosen_feasible"),
    )
    return best.select(
        F.lit(chosen).alias("chosen_policy_id"), "chosen_value", "chosen_feasible", "best_policy_id",
        (F.col("best") * sign).alias("best_value"),
        F.when(F.col("chosen_feasible"), F.col("best") - F.col("chosen_value") * sign).alias("regret"),
    )


# --- checks against plans and truth -------------------------------------------------------

def poisson_check(records: DataFrame, plan: DataFrame, keys: Sequence[str], attempted: int, limit: float = 4.0) -> DataFrame:
    """Mean observed counts against planned means, in Poisson standard errors.

    records: keys, seed, status, observed; plan: keys, expected_bookings. The plan is summed
    per key before the join.
    """
    keys = list(keys)
    expected = plan.groupBy(*keys).agg(F.sum("expected_bookings").alias("expected"))
    ok = (F.col("status") == "succeeded") & is_finite("observed")
    seen = records.groupBy(*keys).agg(F.count_if(ok).alias("available"), F.avg(F.when(ok, F.col("observed"))).alias("observed_mean"))
    joined = expected.join(seen, keys, "left").fillna(0, ["available"])
    error = F.col("observed_mean") - F.col("expected")
    z = F.when((F.col("expected") > 0) & (F.col("available") > 0), error / F.sqrt(F.col("expected") / F.nullif(F.col("available"), F.lit(0))))
    exact = F.coalesce((F.col("observed_mean") == 0) & (F.col("expected") == 0), F.lit(False))
    return joined.withColumns({"mean_error": error, "standardized_error": z}).withColumn(
        "passed", (F.col("available") == attempted) & F.coalesce(F.abs("standardized_error") <= limit, exact)
    )


def truth_check(records: DataFrame, truths: DataFrame, attempted: int) -> DataFrame:
    """Mean of each metric against its known value and tolerance; every attempt must count."""
    metrics = [c for c in records.columns if c not in ("seed", "status", "policy_id")]
    long = _long(records, ["seed"], metrics)
    ok = (F.col("status") == "succeeded") & is_finite("value")
    stats = long.groupBy("metric").agg(F.count_if(ok).alias("available"), F.avg(F.when(ok, F.col("value"))).alias("observed_mean"))
    joined = truths.join(stats, "metric", "left").withColumn("mean_error", F.col("observed_mean") - F.col("truth"))
    good = F.coalesce(F.abs("mean_error") <= F.col("tolerance"), F.lit(False))
    return joined.withColumn("passed", (F.col("available") == attempted) & good)


def identity_check(records: DataFrame, a: str, b: str, metrics: Sequence[str]) -> DataFrame:
    """Per metric: seeds compared and seeds that differ between two runs of the same policy."""
    long = _long(records, ["policy_id", "seed"], metrics)
    left = long.filter(F.col("policy_id") == a).select("seed", "metric", F.col("value").alias("va"))
    right = long.filter(F.col("policy_id") == b).select("seed", "metric", F.col("value").alias("vb"))
    same = F.col("va").eqNullSafe(F.col("vb"))
    return left.join(right, ["seed", "metric"], "full_outer").groupBy("metric").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(~same).alias("different"), F.bool_and(same).alias("identical")
    )


# --- price actions ------------------------------------------------------------------------

def _actions(actions: Sequence[tuple[float, float]]) -> Column:
    rows = [F.struct(F.lit(i).alias("action"), F.lit(float(x)).alias("mx"), F.lit(float(y)).alias("my")) for i, (x, y) in enumerate(actions)]
    return F.explode(F.array(*rows)).alias("a")


def supported_actions(train: DataFrame, contexts: DataFrame, min_n: int, actions=ACTIONS) -> DataFrame:
    """Each action with its thinnest stratum; supported when every stratum has enough blocks."""
    counts = _keyed(train).groupBy(*STRATUM, price_key("multiplier_x", "multiplier_y").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    wanted = _keyed(contexts).select(*STRATUM).distinct().select(*STRATUM, _actions(actions)).select(*STRATUM, "a.*").withColumn("k", price_key("mx", "my"))
    joined = wanted.join(counts, [*STRATUM, "k"], "left")
    return joined.groupBy("action", F.col("mx").alias("multiplier_x"), F.col("my").alias("multiplier_y")).agg(
        F.min(F.coalesce("n", F.lit(0))).alias("min_blocks"),
        (F.min(F.coalesce("n", F.lit(0))) >= min_n).alias("supported"),
    )


def action_values(contexts: DataFrame, share_x: Column, share_y: Column, theta: Sequence[Sequence[float]], actions=ACTIONS, by: Sequence[str] = ()) -> DataFrame:
    """Weighted gross value per 1000 sessions and conversion of every action.

    Shares are base plus a price effect that is constant per action, so one reduction of the
    contexts (weighted means and extremes) serves all actions; the fixed action list is then
    expanded from the reduced rows. Actions that push any context off the simplex get NULL.
    """
    by = list(by)
    w = F.col(WEIGHT).cast("double")
    based = contexts.select(*by, w.alias("w"), share_x.alias("bx"), share_y.alias("by_"))
    both = F.col("bx") + F.col("by_")
    summary = based.groupBy(*by).agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("bx")).alias("sx"), F.sum(F.col("w") * F.col("by_")).alias("sy"),
        F.min("bx").alias("lox"), F.max("bx").alias("hix"), F.min("by_").alias("loy"), F.max("by_").alias("hiy"),
        F.min(both).alias("los"), F.max(both).alias("his"),
    )
    rows = summary.select("*", _actions(actions)).select(*by, "w", "sx", "sy", "lox", "hix", "loy", "hiy", "los", "his", "a.*")
    ex = float(theta[0][0]) * F.ln("mx") + float(theta[0][1]) * F.ln("my")
    ey = float(theta[1][0]) * F.ln("mx") + float(theta[1][1]) * F.ln("my")
    valid = (
        (F.col("lox") + ex >= 0) & (F.col("hix") + ex <= 1) & (F.col("loy") + ey >= 0) & (F.col("hiy") + ey <= 1)
        & (F.col("los") + ex + ey >= 0) & (F.col("his") + ex + ey <= 1)
    )
    px, py = F.col("sx") / F.col("w") + ex, F.col("sy") / F.col("w") + ey
    return rows.select(
        *by, "action", F.col("mx").alias("multiplier_x"), F.col("my").alias("multiplier_y"), valid.alias("valid"),
        F.when(valid, 1000 * (px * F.col("mx") + py * F.col("my"))).alias("value"),
        F.when(valid, px + py).alias("conversion"),
    )


def model_action_values(contexts: DataFrame, model: Model, actions=ACTIONS, by: Sequence[str] = ()) -> DataFrame:
    return action_values(contexts, model.baseline(0), model.baseline(1), model.theta, actions, by)


def best_action(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The first action, in declared order, within the tie tolerance of the best value."""
    by = list(by)
    top = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    near = values.filter(F.col("value").isNotNull()).withColumn("_top", F.max("value").over(top))
    near = near.filter(F.col("value") >= F.col("_top") - TIE_TOLERANCE)
    pick = F.min_by(F.struct("action", "multiplier_x", "multiplier_y", "value"), F.col("action")).alias("b")
    return near.groupBy(*by).agg(pick).select(*by, "b.*")


def score_policies(selections: DataFrame, truth_values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True value, uplift, regret and conversion of each policy's frozen action.

    selections: by, policy, action; truth_values: by, action, value, conversion.
    """
    by = list(by)
    truth = truth_values.select(*by, "action", "value", "conversion")
    base = truth.filter("action = 0").select(*by, F.col("value").alias("base_value"), F.col("conversion").alias("base_conversion"))
    best = truth.groupBy(*by).agg(F.max("value").alias("best_value"))
    reference = base.join(best, by) if by else base.withColumn("best_value", best.scalar())
    joined = selections.join(truth, [*by, "action"], "left")
    if by:
        joined = joined.join(reference, by, "left")
    else:
        packed = reference.select(F.struct(*reference.columns)).scalar()
        joined = joined.withColumn("_r", packed).select(*joined.columns, "_r.*")
    gain = F.col("value") - F.col("base_value")
    return joined.select(
        *by, "policy", "action", F.when(F.col("value").isNull(), "test_unsupported").otherwise("ok").alias("status"),
        F.col("value").alias("gross_value_per_1000"), gain.alias("uplift_per_1000"), safe_div(gain, "base_value").alias("relative_uplift"),
        (F.col("best_value") - F.col("value")).alias("regret_per_1000"), "conversion",
        (1000 * (F.col("conversion") - F.col("base_conversion"))).alias("choice_change_per_1000"),
    )


def _mean_interval(prefix: str = "") -> list[Column]:
    se = F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n"))
    return [
        F.col("mean").alias(f"{prefix}mean"), se.alias(f"{prefix}standard_error"),
        (F.col("mean") - F.col("t") * se).alias(f"{prefix}lower"), (F.col("mean") + F.col("t") * se).alias(f"{prefix}upper"),
    ]


def _mean_stats(df: DataFrame, keys: Sequence[str], value: str, extra: Sequence[Column] = (), level: float = 0.95) -> DataFrame:
    stats = df.groupBy(*keys).agg(*extra, F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return stats.withColumn("t", t_ppf((1 + level) / 2, F.when(F.col("n") > 1, F.col("n") - 1)))


def policy_seed_summary(results: DataFrame, value: str = "gross_value_per_1000", by: Sequence[str] = ("dgp_id",)) -> DataFrame:
    """Mean over seeds with its t interval per policy, and how many seeds failed or fell back."""
    extra = [F.count(F.lit(1)).alias("attempted_seeds"), F.count_if(F.col(value).isNull()).alias("failed_value_seeds")]
    stats = _mean_stats(results, [*by, "policy"], value, extra)
    return stats.select(*by, "policy", "attempted_seeds", "failed_value_seeds", F.col("n").alias("valid_seeds"), *_mean_interval())


def policy_pairs(results: DataFrame, comparators: Sequence[str], value: str = "gross_value_per_1000", by: Sequence[str] = ("dgp_id",)) -> DataFrame:
    """Paired seed differences of every policy against each comparator."""
    by = list(by)
    other = results.filter(F.col("policy").isin(list(comparators))).select(*by, "seed", F.col("policy").alias("comparator"), F.col(value).alias("_other"))
    joined = results.join(other, [*by, "seed"]).filter("policy <> comparator").withColumn("d", F.col(value) - F.col("_other"))
    stats = _mean_stats(joined, [*by, "policy", "comparator"], "d")
    return stats.select(*by, "policy", "comparator", F.col("n").alias("n_pairs"), *_mean_interval())


def forecast_error(forecast: DataFrame, observed: DataFrame, keys: Sequence[str] = ("policy_id", "metric")) -> DataFrame:
    """Forecast minus observed difference; NULL when either is missing."""
    f = forecast.select(*keys, F.col("delta_mean").alias("forecast_delta"))
    o = observed.select(*keys, F.col("delta_mean").alias("observed_delta"))
    return o.join(f, list(keys), "left").withColumn("forecast_error", F.col("forecast_delta") - F.col("observed_delta"))
