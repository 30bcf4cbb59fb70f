"""Registered queries: policy comparison, method evaluation and the choice model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.functions.scalars import fingerprint, hash_uniform, is_finite, safe_div, weighted_mean
from farewise.functions.stats import binom_test, clopper_pearson, holm_adjust, norm_ppf, t_ppf
from farewise.operators import choice_fits, estimate, evaluate, mnl, policy, resample
from farewise.plans.catalogue import query, shown, sql_shown
from farewise.plans.choices import (
    _ADJUSTED,
    _BOOT,
    _LONG,
    _WIDTH,
    _dot,
    encoded,
    feature_blocks,
    fitted,
    long_draws,
    on_blocks,
    price_only,
    closed_form,
    train,
)
from farewise.plans.scenarios import _TH
from farewise.plans.sqlkit import binomial_terms, clopper_bounds, normal_quantiles, recursive, t_quantiles
from farewise.sources import bindings
from farewise.sources.bindings import with_views

METRICS = ("created_requests", "completed_trips", "total_driver_pay")
N_SEEDS, N_DRAWS, REPLICATES = 40, 20, 3
_TQ = recursive(tq=t_quantiles("tq_in"))


def runs(spark, sf) -> DataFrame:
    return bindings.trajectories(spark, sf)


# --- policy comparison --------------------------------------------------------------------

@query("L01_policy_metrics", sql_shown(with_views("SELECT policy_id, seed, CASE WHEN status = 'succeeded' THEN (created_requests - completed_trips) / created_requests::DOUBLE END AS unserved_fraction, CASE WHEN status = 'succeeded' THEN total_driver_pay END AS gross_booking_value, CASE WHEN status = 'succeeded' THEN 0 - (completed_trips * 1.5 + 2.0 * 0.5 + 3) END AS conditional_surplus FROM trajectories", "trajectories"), {"policy_id": "", "seed": "i", "unserved_fraction": "r", "gross_booking_value": "r4", "conditional_surplus": "r"}))
def l01(spark, sf):
    records = runs(spark, sf).withColumns({"expired_requests": F.col("created_requests") - F.col("completed_trips"), "canceled_requests": F.lit(0), "online_hours": F.lit(2.0)})
    out = policy.policy_metrics(records, {"per_completed_trip": 1.5, "per_online_hour": 0.5, "per_horizon": 3.0})
    rounded = out.select("policy_id", "seed", "unserved_fraction", F.round("gross_booking_value", 4).alias("gross_booking_value"), "conditional_surplus")
    return shown(rounded)


_LONG_RUNS = " UNION ALL ".join(f"SELECT policy_id, seed, status, '{m}' AS metric, {m}::DOUBLE AS v FROM {{source}}" for m in METRICS)
_PAIRS = "SELECT t.policy_id, t.metric, t.seed, b.v AS v0, t.v AS v1, t.v - b.v AS d FROM lr t JOIN lr b USING (seed, metric) WHERE t.policy_id <> '1' AND b.policy_id = '1' AND t.status = 'succeeded' AND b.status = 'succeeded'"
_PSTATS = "SELECT policy_id, metric, COUNT(*) AS n, AVG(v0) AS m0, AVG(v1) AS m1, AVG(d) AS md, STDDEV_SAMP(d) / SQRT(COUNT(*)) AS se FROM pairs GROUP BY 1, 2"
_PSUM = f"SELECT policy_id, metric, {N_SEEDS} AS attempted_pairs, n AS available_pairs, {N_SEEDS} - n AS unavailable_pairs, m0 AS baseline_mean, m1 AS target_mean, md AS delta_mean, md - hi * se AS delta_lower, md + hi * se AS delta_upper, CASE WHEN n = {N_SEEDS} THEN 'ok' ELSE 'partial' END AS status FROM ps JOIN tq ON tq.id = policy_id || metric AND tq.step = 48"
_PSUM_CTES = {"lr": _LONG_RUNS.format(source="trajectories"), "pairs": _PAIRS, "ps": _PSTATS, "tq_in": "SELECT policy_id || metric AS id, 0.975::DOUBLE AS p, (n - 1)::DOUBLE AS df FROM ps", **_TQ, "summ": _PSUM}
_SUM_KINDS = {"policy_id": "", "metric": "", "attempted_pairs": "i", "available_pairs": "i", "unavailable_pairs": "i", **dict.fromkeys(("baseline_mean", "target_mean", "delta_mean", "delta_lower", "delta_upper"), "r3"), "status": ""}


def summary(spark, sf) -> DataFrame:
    return policy.paired_summary(policy.paired_differences(runs(spark, sf), "1", METRICS), N_SEEDS)


@query("L02_paired_arm_summary", sql_shown(with_views("SELECT * FROM summ", "trajectories", **_PSUM_CTES), _SUM_KINDS))
def l02(spark, sf):
    return shown(summary(spark, sf), 3)


def points(spark, sf) -> DataFrame:
    """Trajectories under the declared rules and under a slower variant."""
    base = runs(spark, sf).withColumn("status", F.lit("succeeded"))
    slow = base.withColumns({m: F.col(m) * 0.9 for m in METRICS}).withColumn("sensitivity_id", F.lit("slow"))
    return base.withColumns({m: F.col(m) * 1.0 for m in METRICS}).withColumn("sensitivity_id", F.lit("declared_rules")).unionByName(slow)


def draw_runs(spark, sf) -> DataFrame:
    return (
        bindings.table(spark, sf, "orders")
        .groupBy((F.col("o_custkey") % N_DRAWS).alias("draw_id"), F.substring("o_orderpriority", 1, 1).alias("policy_id"), (F.col("o_orderkey") % REPLICATES).alias("seed"))
        .agg(F.count(F.lit(1)).alias("created_requests"), F.count_if(F.col("o_orderstatus") == "F").alias("completed_trips"), F.avg("o_totalprice").alias("total_driver_pay"))
        .withColumn("status", F.lit("succeeded"))
    )


def full_summary(spark, sf) -> DataFrame:
    return policy.policy_summary(points(spark, sf), draw_runs(spark, sf), "1", METRICS, N_SEEDS, N_DRAWS, REPLICATES)


_SENS = " UNION ALL ".join(f"SELECT '{s}' AS sensitivity_id, policy_id, seed, '{m}' AS metric, {m} * {f}::DOUBLE AS v FROM trajectories" for s, f in (("declared_rules", "1.0"), ("slow", "0.9")) for m in METRICS)
_DRAWS = f"SELECT o_custkey % {N_DRAWS} AS draw_id, SUBSTR(o_orderpriority, 1, 1) AS policy_id, o_orderkey % {REPLICATES} AS seed, COUNT(*) AS created_requests, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS completed_trips, AVG(o_totalprice) AS total_driver_pay FROM orders GROUP BY 1, 2, 3"
_FULL = {
    "sr": _SENS,
    "sp": "SELECT t.sensitivity_id, t.policy_id, t.metric, COUNT(*) AS n, AVG(b.v) AS m0, AVG(t.v) AS m1, AVG(t.v - b.v) AS md, STDDEV_SAMP(t.v - b.v) / SQRT(COUNT(*)) AS se FROM sr t JOIN sr b USING (sensitivity_id, seed, metric) WHERE t.policy_id <> '1' AND b.policy_id = '1' GROUP BY 1, 2, 3",
    "tq_in": f"SELECT 1 AS id, 0.975::DOUBLE AS p, {N_SEEDS - 1}::DOUBLE AS df", **_TQ,
    "dr": _DRAWS,
    "dl": " UNION ALL ".join(f"SELECT draw_id, policy_id, seed, '{m}' AS metric, {m}::DOUBLE AS v FROM dr" for m in METRICS),
    "dm": f"SELECT t.policy_id, t.metric, draw_id, CASE WHEN COUNT(*) = {REPLICATES} THEN AVG(t.v - b.v) END AS mean FROM dl t JOIN dl b USING (draw_id, seed, metric) WHERE t.policy_id <> '1' AND b.policy_id = '1' GROUP BY 1, 2, 3",
    "di": "SELECT policy_id, metric, COUNT(mean) AS nv, QUANTILE_CONT(mean, 0.025) AS lo, QUANTILE_CONT(mean, 0.975) AS hi_, QUANTILE_CONT(mean, 0.975) FILTER (WHERE draw_id < 10) - QUANTILE_CONT(mean, 0.025) FILTER (WHERE draw_id < 10) AS hw FROM dm GROUP BY 1, 2",
    "full_summary": f"SELECT sensitivity_id, policy_id, metric, n AS available_pairs, {N_SEEDS} - n AS unavailable_pairs, m1 AS target_mean, md AS delta_mean, CASE WHEN n = {N_SEEDS} THEN md - hi * se END AS delta_lower, CASE WHEN n = {N_SEEDS} THEN md + hi * se END AS delta_upper, CASE WHEN n = {N_SEEDS} AND nv = {N_DRAWS} AND sensitivity_id = 'declared_rules' THEN lo END AS model_delta_lower, CASE WHEN n = {N_SEEDS} AND nv = {N_DRAWS} AND sensitivity_id = 'declared_rules' THEN hi_ END AS model_delta_upper, CASE WHEN n < {N_SEEDS} OR nv < {N_DRAWS} OR sensitivity_id = 'slow' THEN 'unavailable' WHEN ABS((hi_ - lo) - hw) / GREATEST(hi_ - lo, 1e-8) > 0.5 THEN 'unstable' ELSE 'available' END AS interval_status FROM sp JOIN di USING (policy_id, metric), (SELECT hi FROM tq WHERE step = 48)",
}
_FULL_KINDS = {"sensitivity_id": "", "policy_id": "", "metric": "", "available_pairs": "i", "unavailable_pairs": "i", "target_mean": "r4", "delta_mean": "r4", **dict.fromkeys(("delta_lower", "delta_upper", "model_delta_lower", "model_delta_upper"), "r3"), "interval_status": ""}


@query("L03_policy_summary", sql_shown(with_views("SELECT * FROM full_summary", "trajectories", **_FULL), _FULL_KINDS))
def l03(spark, sf):
    coarse = {c: F.round(c, 3) for c in ("delta_lower", "delta_upper", "model_delta_lower", "model_delta_upper")}
    return shown(full_summary(spark, sf).select(*_FULL_KINDS).withColumns(coarse), 4)


GUARDRAILS = [("created_requests", "minimum", 60.0), ("completed_trips", "minimum", 20.0), ("completed_trips", "maximum", 60.0)]


def guardrails(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GUARDRAILS, "metric string, direction string, limit double")


_GUARD = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{d}', {v}::DOUBLE)" for m, d, v in GUARDRAILS) + ") g(metric, direction, lim)"
_PASS = "COALESCE(CASE direction WHEN 'maximum' THEN target_mean <= lim ELSE target_mean >= lim END AND unavailable_pairs = 0, FALSE)"
_DECIDE = {
    **_FULL, "gr": _GUARD,
    "own": "SELECT policy_id, target_mean AS score, model_delta_lower AS conservative_gain, (interval_status <> 'available')::INT + (COALESCE(model_delta_lower < -100000, TRUE))::INT AS r0 FROM full_summary WHERE metric = 'total_driver_pay' AND sensitivity_id = 'declared_rules'",
    "oth": f"SELECT policy_id, COUNT(*) AS r1 FROM (SELECT policy_id FROM full_summary WHERE metric = 'total_driver_pay' AND sensitivity_id <> 'declared_rules' AND COALESCE(delta_lower < -100000, TRUE) UNION ALL SELECT policy_id FROM full_summary JOIN gr USING (metric) WHERE NOT {_PASS}) GROUP BY 1",
    "dec": "SELECT policy_id, score, conservative_gain, r0 + COALESCE(r1, 0) AS n_reasons FROM own LEFT JOIN oth USING (policy_id)",
}


@query("L04_decide", sql_shown(with_views("SELECT *, CASE WHEN n_reasons = 0 THEN 'development_candidate' ELSE 'not_recommended' END AS status, n_reasons = 0 AND ROW_NUMBER() OVER (PARTITION BY n_reasons = 0 ORDER BY score DESC, policy_id) = 1 AS selected FROM dec", "trajectories", **_DECIDE), {"policy_id": "", "score": "r3", "conservative_gain": "r3", "n_reasons": "i", "status": "", "selected": ""}))
def l04(spark, sf):
    out = policy.decide(full_summary(spark, sf), guardrails(spark), "total_driver_pay", -100000.0)
    return shown(out.withColumn("n_reasons", F.size("reasons")).drop("reasons"), 3)


_FEAS = f"SELECT policy_id, target_mean AS v, NOT EXISTS (SELECT 1 FROM full_summary f2 JOIN gr USING (metric) WHERE f2.policy_id = f.policy_id AND NOT (f2.unavailable_pairs = 0 AND f2.target_mean IS NOT NULL AND ({_PASS}))) AS ok FROM full_summary f WHERE metric = 'total_driver_pay' AND sensitivity_id = 'declared_rules' AND unavailable_pairs = 0"


@query("L05_frozen_regret", sql_shown(with_views("SELECT '4' AS chosen_policy_id, (SELECT v FROM fe WHERE policy_id = '4') AS chosen_value, (SELECT ok FROM fe WHERE policy_id = '4') AS chosen_feasible, (SELECT policy_id FROM fe WHERE ok ORDER BY v DESC, policy_id LIMIT 1) AS best_policy_id, (SELECT MAX(v) FROM fe WHERE ok) AS best_value, CASE WHEN (SELECT ok FROM fe WHERE policy_id = '4') THEN (SELECT MAX(v) FROM fe WHERE ok) - (SELECT v FROM fe WHERE policy_id = '4') END AS regret", "trajectories", **_DECIDE, fe=_FEAS), {"chosen_policy_id": "", "chosen_value": "r3", "chosen_feasible": "", "best_policy_id": "", "best_value": "r3", "regret": "r3"}))
def l05(spark, sf):
    return shown(policy.frozen_regret(full_summary(spark, sf), guardrails(spark), "total_driver_pay", "4"), 3)


def zone_counts(spark, sf) -> DataFrame:
    order = bindings.table(spark, sf, "orders")
    return order.groupBy((F.col("o_custkey") % 5).alias("zone_id"), F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise("Y").alias("service_id"), (F.floor(F.col("o_custkey") / 5) % N_SEEDS).alias("seed")).agg(
        F.count(F.lit(1)).cast("double").alias("observed")
    ).withColumn("status", F.when((F.col("seed") == 3) & (F.col("zone_id") == 1), "failed").otherwise("succeeded"))


_ZC = f"SELECT o_custkey % 5 AS zone_id, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE 'Y' END AS service_id, (o_custkey // 5) % {N_SEEDS} AS seed, COUNT(*)::DOUBLE AS observed FROM orders GROUP BY 1, 2, 3"
_PLAN_EXP = f"SELECT o_custkey % 5 AS zone_id, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE 'Y' END AS service_id, COUNT(*) * 1.01 / {N_SEEDS} AS expected FROM orders GROUP BY 1, 2"


@query("L06_poisson_check", sql_shown(with_views(f"SELECT zone_id, service_id, expected, n AS available, m AS observed_mean, m - expected AS mean_error, (m - expected) / SQRT(expected / n) AS standardized_error, n = {N_SEEDS} AND ABS((m - expected) / SQRT(expected / n)) <= 4 AS passed FROM pl JOIN (SELECT zone_id, service_id, COUNT(*) AS n, AVG(observed) AS m FROM zc WHERE NOT (seed = 3 AND zone_id = 1) GROUP BY 1, 2) USING (zone_id, service_id)", zc=_ZC, pl=_PLAN_EXP), {"zone_id": "i", "service_id": "", "expected": "r", "available": "i", "observed_mean": "r", "mean_error": "r", "standardized_error": "r", "passed": ""}))
def l06(spark, sf):
    records = zone_counts(spark, sf)
    blocks = bindings.table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("zone_id"), F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise("Y").alias("service_id"), F.lit(1.01 / N_SEEDS).alias("expected_bookings"))
    return shown(policy.poisson_check(records, blocks, ["zone_id", "service_id"], N_SEEDS))


_TRUTHS = [("created_requests", 75.0, 1.0), ("completed_trips", 24.6, 0.5), ("total_driver_pay", 250000.0, 100.0)]


@query("L07_truth_check", sql_shown(with_views("SELECT metric, truth, tolerance, COUNT(v) FILTER (WHERE status = 'succeeded') AS available, AVG(v) FILTER (WHERE status = 'succeeded') AS observed_mean, AVG(v) FILTER (WHERE status = 'succeeded') - truth AS mean_error, COUNT(v) FILTER (WHERE status = 'succeeded') = 200 AND ABS(AVG(v) FILTER (WHERE status = 'succeeded') - truth) <= tolerance AS passed FROM lr JOIN (VALUES " + ", ".join(f"('{m}', {t}::DOUBLE, {x}::DOUBLE)" for m, t, x in _TRUTHS) + ") tr(metric, truth, tolerance) USING (metric) GROUP BY 1, 2, 3", "trajectories", lr=_LONG_RUNS.format(source="trajectories")), {"metric": "", "truth": "r", "tolerance": "r", "available": "i", "observed_mean": "r4", "mean_error": "r4", "passed": ""}))
def l07(spark, sf):
    truths = spark.createDataFrame(_TRUTHS, "metric string, truth double, tolerance double")
    return shown(policy.truth_check(runs(spark, sf), truths, 200), 4)


@query("L08_identity_check", with_views("SELECT metric, COUNT(*) AS compared, COUNT(*) FILTER (WHERE a.v IS DISTINCT FROM b.v) AS different, BOOL_AND(a.v IS NOT DISTINCT FROM b.v) AS identical FROM (SELECT * FROM lr WHERE policy_id = '2') a FULL JOIN (SELECT * FROM lr WHERE policy_id = '4') b USING (seed, metric) GROUP BY 1", "trajectories", lr=_LONG_RUNS.format(source="trajectories")))
def l08(spark, sf):
    return policy.identity_check(runs(spark, sf), "2", "4", METRICS)


_ACT = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(policy.ACTIONS)) + ") a(action, mx, my)"


@query("L09_supported_actions", sql_shown(on_blocks("SELECT action, mx AS multiplier_x, my AS multiplier_y, MIN(COALESCE(n, 0)) AS min_blocks, MIN(COALESCE(n, 0)) >= 1 AS supported FROM act CROSS JOIN (SELECT DISTINCT zone_id, is_weekend, is_peak FROM blocks) s LEFT JOIN (SELECT zone_id, is_weekend, is_peak, multiplier_x AS mx, multiplier_y AS my, COUNT(*) AS n FROM train GROUP BY ALL) c USING (zone_id, is_weekend, is_peak, mx, my) GROUP BY 1, 2, 3", act=_ACT), {"action": "i", "multiplier_x": "r", "multiplier_y": "r", "min_blocks": "i", "supported": ""}))
def l09(spark, sf):
    return shown(policy.supported_actions(train(spark, sf), feature_blocks(spark, sf), 1))


_AV_BASE = f"SELECT zone_id, n_sessions::DOUBLE AS w, {_dot('fit', 2, 1, _WIDTH)} AS bx, {_dot('fit', 2, 2, _WIDTH)} AS by_ FROM blocks"
_AV_THETA = {a: v for a, v in _TH.items()}


def _values(base: str, th: dict[str, str]) -> str:
    ex, ey = f"({th['xx']} * LN(mx) + {th['xy']} * LN(my))", f"({th['yx']} * LN(mx) + {th['yy']} * LN(my))"
    return f"""SELECT zone_id, action, mx AS multiplier_x, my AS multiplier_y, BOOL_AND(px BETWEEN 0 AND 1 AND py BETWEEN 0 AND 1 AND 1 - px - py BETWEEN 0 AND 1) AS valid, CASE WHEN BOOL_AND(px BETWEEN 0 AND 1 AND py BETWEEN 0 AND 1 AND 1 - px - py BETWEEN 0 AND 1) THEN 1000 * SUM(w * (px * mx + py * my)) / SUM(w) END AS value,
CASE WHEN BOOL_AND(px BETWEEN 0 AND 1 AND py BETWEEN 0 AND 1 AND 1 - px - py BETWEEN 0 AND 1) THEN SUM(w * (px + py)) / SUM(w) END AS conversion FROM (SELECT *, bx + {ex} AS px, by_ + {ey} AS py FROM {base} CROSS JOIN act) GROUP BY 1, 2, 3, 4"""


_VAL = {**_ADJUSTED, "act": _ACT, "mb": _AV_BASE, "mv": _values("mb", _AV_THETA)}
_BEST = "SELECT zone_id, action, multiplier_x, multiplier_y, value FROM (SELECT *, MAX(value) OVER (PARTITION BY zone_id) AS top FROM mv) WHERE value >= top - 1e-10 QUALIFY ROW_NUMBER() OVER (PARTITION BY zone_id ORDER BY action) = 1"
_VAL_KINDS = {"zone_id": "i", "action": "i", "multiplier_x": "r", "multiplier_y": "r", "valid": "", "value": "r4", "conversion": "r5"}


@query("L10_action_values", sql_shown(on_blocks("SELECT * FROM mv", **_VAL), {**_VAL_KINDS, "conversion": "r4"}))
def l10(spark, sf):
    _, _, model = fitted(spark, sf)
    return shown(policy.model_action_values(encoded(spark, sf), model, by=["zone_id"]), 4)


@query("L10_best_action", sql_shown(on_blocks(_BEST, **_VAL), {"zone_id": "i", "action": "i", "multiplier_x": "r", "multiplier_y": "r", "value": "r4"}))
def l10_best(spark, sf):
    _, _, model = fitted(spark, sf)
    return shown(policy.best_action(policy.model_action_values(encoded(spark, sf), model, by=["zone_id"]), ["zone_id"]), 4)


TRUE_THETA = [[-0.6, 0.15], [0.12, -0.5]]
_TRUE = {"xx": "-0.6::DOUBLE", "xy": "0.15::DOUBLE", "yx": "0.12::DOUBLE", "yy": "-0.5::DOUBLE"}
_SCORE = {
    **_VAL, "best": _BEST, "tb": "SELECT zone_id, n_sessions::DOUBLE AS w, 0.35::DOUBLE + zone_id * 0.01 AS bx, 0.2::DOUBLE AS by_ FROM blocks", "tv": _values("tb", _TRUE),
    "sel": "SELECT zone_id, 'learned' AS policy, action FROM best UNION ALL SELECT DISTINCT zone_id, 'unchanged', 0 FROM blocks",
}


@query("L11_score_policies", sql_shown(on_blocks("SELECT s.zone_id, policy, s.action, 'ok' AS status, t.value AS gross_value_per_1000, t.value - b.value AS uplift_per_1000, (t.value - b.value) / b.value AS relative_uplift, (SELECT MAX(value) FROM tv q WHERE q.zone_id = s.zone_id) - t.value AS regret_per_1000, t.conversion, 1000 * (t.conversion - b.conversion) AS choice_change_per_1000 FROM sel s JOIN tv t ON t.zone_id = s.zone_id AND t.action = s.action JOIN tv b ON b.zone_id = s.zone_id AND b.action = 0", **_SCORE), {"zone_id": "i", "policy": "", "action": "i", "status": "", **dict.fromkeys(("gross_value_per_1000", "uplift_per_1000", "relative_uplift", "regret_per_1000", "conversion", "choice_change_per_1000"), "r4")}))
def l11(spark, sf):
    _, _, model = fitted(spark, sf)
    contexts = encoded(spark, sf)
    learned = policy.best_action(policy.model_action_values(contexts, model, by=["zone_id"]), ["zone_id"]).select("zone_id", F.lit("learned").alias("policy"), "action")
    unchanged = contexts.select("zone_id").distinct().select("zone_id", F.lit("unchanged").alias("policy"), F.lit(0).alias("action"))
    truth = policy.action_values(contexts, 0.35 + F.col("zone_id") * 0.01, F.lit(0.2), TRUE_THETA, by=["zone_id"])
    return shown(policy.score_policies(learned.unionByName(unchanged), truth, ["zone_id"]), 4)


def seed_values(spark, sf) -> DataFrame:
    ok = F.col("status") == "succeeded"
    return runs(spark, sf).select(F.lit("base").alias("dgp_id"), F.col("policy_id").alias("policy"), "seed", F.when(ok, F.col("total_driver_pay") / 1000).alias("gross_value_per_1000"))


_SV = "SELECT policy_id AS policy, seed, CASE WHEN status = 'succeeded' THEN total_driver_pay / 1000 END AS v FROM trajectories"
_SVQ = {"sv": _SV, "st": "SELECT policy, COUNT(*) AS a, COUNT(v) AS n, AVG(v) AS m, STDDEV_SAMP(v) / SQRT(COUNT(v)) AS se FROM sv GROUP BY 1", "tq_in": "SELECT policy AS id, 0.975::DOUBLE AS p, (n - 1)::DOUBLE AS df FROM st", **_TQ}


@query("L12_policy_seed_summary", sql_shown(with_views("SELECT 'base' AS dgp_id, policy, a AS attempted_seeds, a - n AS failed_value_seeds, n AS valid_seeds, m AS mean, se AS standard_error, m - hi * se AS lower, m + hi * se AS upper FROM st JOIN tq ON tq.id = policy AND step = 48", "trajectories", **_SVQ), {"dgp_id": "", "policy": "", "attempted_seeds": "i", "failed_value_seeds": "i", "valid_seeds": "i", **dict.fromkeys(("mean", "standard_error", "lower", "upper"), "r4")}))
def l12(spark, sf):
    return shown(policy.policy_seed_summary(seed_values(spark, sf)), 4)


@query("L12_policy_pairs", sql_shown(with_views("SELECT 'base' AS dgp_id, policy, comparator, n AS n_pairs, m AS mean, se AS standard_error, m - hi * se AS lower, m + hi * se AS upper FROM sd JOIN tq ON tq.id = policy || comparator AND step = 48", "trajectories", sv=_SV, sd="SELECT a.policy, b.policy AS comparator, COUNT(a.v - b.v) AS n, AVG(a.v - b.v) AS m, STDDEV_SAMP(a.v - b.v) / SQRT(COUNT(a.v - b.v)) AS se FROM sv a JOIN sv b USING (seed) WHERE a.policy <> b.policy AND b.policy IN ('1', '2') GROUP BY 1, 2", tq_in="SELECT policy || comparator AS id, 0.975::DOUBLE AS p, (n - 1)::DOUBLE AS df FROM sd", **_TQ), {"dgp_id": "", "policy": "", "comparator": "", "n_pairs": "i", **dict.fromkeys(("mean", "standard_error", "lower", "upper"), "r4")}))
def l12_pairs(spark, sf):
    return shown(policy.policy_pairs(seed_values(spark, sf), ["1", "2"]), 4)


@query("L13_forecast_error", sql_shown(with_views("SELECT policy_id, metric, o.md AS observed_delta, f.md AS forecast_delta, f.md - o.md AS forecast_error FROM (SELECT policy_id, metric, AVG(d) AS md FROM pairs WHERE seed >= 20 GROUP BY 1, 2) o LEFT JOIN (SELECT policy_id, metric, AVG(d) AS md FROM pairs WHERE seed < 20 AND policy_id <> '5' GROUP BY 1, 2) f USING (policy_id, metric)", "trajectories", lr=_LONG_RUNS.format(source="trajectories"), pairs=_PAIRS), {"policy_id": "", "metric": "", "observed_delta": "r4", "forecast_delta": "r4", "forecast_error": "r4"}))
def l13(spark, sf):
    pairs = policy.paired_differences(runs(spark, sf), "1", METRICS)
    early = policy.paired_summary(pairs.filter("seed < 20 and policy_id <> '5'"), 20)
    late = policy.paired_summary(pairs.filter("seed >= 20"), 20)
    return shown(policy.forecast_error(early, late), 4)


# --- method evaluation --------------------------------------------------------------------

def seed_rows(spark, sf) -> DataFrame:
    """Seed metrics with a zero-truth cell family (dgp N), standard errors and methods."""
    raw = bindings.seed_metrics(spark, sf)
    null = F.col("dgp_id") == "N"
    shifted = {c: F.when(null, F.col(c) - 0.05).otherwise(F.col(c)) for c in ("theta", "true_theta", "theta_lower", "theta_upper")}
    rows = raw.withColumns(shifted).withColumn("true_theta", F.when(null, 0.0).otherwise(0.05))
    se = (F.col("theta_upper") - F.col("theta_lower")) / (2 * 1.96)
    return evaluate.method_metrics(rows).withColumn("standard_error", F.when(F.col("seed") % 13 != 0, se))


ROWS = """SELECT *, (theta_upper - theta_lower) AS interval_width, theta_lower IS NOT NULL AS interval_available, theta - true_theta AS error, POW(theta - true_theta, 2) AS squared_error, theta_lower <= true_theta AND true_theta <= theta_upper AS covered,
CASE WHEN true_theta = 0 AND theta_lower IS NOT NULL THEN NOT (theta_lower <= 0 AND theta_upper >= 0) END AS false_positive, CASE WHEN seed % 13 <> 0 THEN (theta_upper - theta_lower) / (2 * 1.96) END AS standard_error
FROM (SELECT dgp_id, estimator, seed, theta - sh AS theta, CASE dgp_id WHEN 'N' THEN 0.0::DOUBLE ELSE 0.05 END AS true_theta, theta_lower - sh AS theta_lower, theta_upper - sh AS theta_upper FROM (SELECT *, CASE dgp_id WHEN 'N' THEN 0.05::DOUBLE ELSE 0 END AS sh FROM seed_metrics))"""


def on_rows(body: str, **extra: str) -> str:
    return with_views(body, "seed_metrics", rows_=ROWS, **extra)


@query("N01_effect_rows", sql_shown(on_blocks("SELECT effect, outcome, theta, lower AS theta_lower, upper AS theta_upper, CASE WHEN baseline >= 0.3 THEN theta / baseline END AS elasticity, 'ok' AS status, 'ok' AS interval_status FROM pts JOIN iv USING (effect) JOIN bs2 USING (outcome)", **_BOOT, l=_LONG, iv="SELECT effect, QUANTILE_CONT(theta, 0.025) AS lower, QUANTILE_CONT(theta, 0.975) AS upper FROM l GROUP BY 1", ps=price_only("train"), pt=f"SELECT {closed_form()} FROM ps", pts=" UNION ALL ".join(f"SELECT '{t}' AS effect, '{t[6].upper()}' AS outcome, {t} AS theta FROM pt" for t in resample.THETAS), bs2="SELECT 'X' AS outcome, SUM(n_x) / SUM(n_sessions)::DOUBLE AS baseline FROM train UNION ALL SELECT 'Y', SUM(n_y) / SUM(n_sessions)::DOUBLE FROM train"), {"effect": "", "outcome": "", "theta": "r", "theta_lower": "r", "theta_upper": "r", "elasticity": "r", "status": "", "interval_status": ""}))
def n01(spark, sf):
    df = train(spark, sf)
    whole = estimate.theta_from_moments(estimate.moments(df, [])).unpivot([], list(resample.THETAS), "effect", "theta")
    whole = whole.withColumn("outcome", F.upper(F.substring("effect", 7, 1)))
    shares = df.agg(*[(F.sum(f"n_{s}") / F.sum("n_sessions")).alias(s.upper()) for s in "xy"]).unpivot([], ["X", "Y"], "outcome", "baseline")
    draws = long_draws(resample.bootstrap_prices_only(df, 50))
    return shown(evaluate.effect_rows(whole, draws, shares, floor=0.3))


@query("N02_method_metrics", sql_shown(on_rows("SELECT dgp_id, estimator, seed, error, squared_error, covered::INT AS covered, false_positive::INT AS false_positive, interval_width FROM rows_"), {"dgp_id": "", "estimator": "", "seed": "i", "error": "r8", "squared_error": "r8", "covered": "r", "false_positive": "r", "interval_width": "r8"}))
def n02(spark, sf):
    out = seed_rows(spark, sf).withColumns({c: F.col(c).cast("int").cast("double") for c in ("covered", "false_positive")})
    return shown(out.select("dgp_id", "estimator", "seed", "error", "squared_error", "covered", "false_positive", "interval_width"), 8)


_AGGM = "SELECT dgp_id, estimator, 100 AS expected_seeds, COUNT(DISTINCT seed) AS attempted_seeds, COUNT(error) AS valid_estimates, COUNT(*) - COUNT(error) AS failed_estimates, AVG(error) AS bias, SQRT(AVG(error * error)) AS rmse, COUNT(*) FILTER (WHERE covered) AS covered_seeds, COUNT(covered) AS coverage_denominator, COUNT(*) FILTER (WHERE false_positive) AS false_positives, COUNT(false_positive) AS false_positive_denominator FROM rows_ GROUP BY 1, 2"
_CP = {
    "cp_in": "SELECT dgp_id || estimator || 'c' AS id, covered_seeds AS k, coverage_denominator AS n FROM cells UNION ALL SELECT dgp_id || estimator || 'f', false_positives, false_positive_denominator FROM cells",
    **recursive(cp=clopper_bounds("cp_in")),
}
_CELL_FULL = """SELECT c.*, covered_seeds / coverage_denominator::DOUBLE AS coverage, false_positives / NULLIF(false_positive_denominator, 0)::DOUBLE AS false_positive_rate, CASE WHEN covered_seeds > 0 THEN a.ll ELSE 0 END AS coverage_lower, CASE WHEN covered_seeds < coverage_denominator THEN a.uh ELSE 1 END AS coverage_upper,
CASE WHEN b.id IS NOT NULL THEN CASE WHEN false_positives > 0 THEN b.ll ELSE 0 END END AS false_positive_lower, CASE WHEN b.id IS NOT NULL THEN CASE WHEN false_positives < false_positive_denominator THEN b.uh ELSE 1 END END AS false_positive_upper, CASE WHEN failed_estimates = 0 AND attempted_seeds = 100 THEN 'reporting' ELSE 'development_or_unstable' END AS interval_quality
FROM cells c JOIN cp a ON a.id = dgp_id || estimator || 'c' AND a.step = 40 LEFT JOIN cp b ON b.id = dgp_id || estimator || 'f' AND b.step = 40"""
_CELL_CTES = {"cells": _AGGM, **_CP, "full_cells": _CELL_FULL}
_CELL_KINDS = {"dgp_id": "", "estimator": "", **dict.fromkeys(("expected_seeds", "attempted_seeds", "valid_estimates", "failed_estimates", "covered_seeds", "coverage_denominator", "false_positives", "false_positive_denominator"), "i"), **dict.fromkeys(("bias", "rmse", "coverage", "false_positive_rate", "coverage_lower", "coverage_upper", "false_positive_lower", "false_positive_upper"), "r"), "interval_quality": ""}


@query("N03_aggregate_metrics", sql_shown(on_rows("SELECT * FROM full_cells", **_CELL_CTES), _CELL_KINDS))
def n03(spark, sf):
    return shown(evaluate.aggregate_metrics(seed_rows(spark, sf), 100))


LIMITS = {"max_bias": 0.001, "max_rmse": 0.002, "coverage_floor": 0.9, "max_false_positive_rate": 0.08}
_N04 = f"""SELECT *, CASE WHEN check_available AND check_bias AND check_rmse AND check_coverage AND check_false_positives THEN 'controlled_checks_passed' ELSE 'controlled_checks_failed' END AS status FROM (SELECT *, valid_points = attempted AND available_intervals = attempted AS check_available, ABS(bias) <= 0.001 AS check_bias, rmse <= 0.002 AS check_rmse, coverage >= 0.9 AS check_coverage, null_intervals = 0 OR COALESCE(false_positives / NULLIF(null_intervals, 0)::DOUBLE <= 0.08, FALSE) AS check_false_positives FROM (
SELECT dgp_id, estimator, COUNT(*) AS attempted, COUNT(theta) AS valid_points, COUNT(*) FILTER (WHERE interval_available) AS available_intervals, AVG(error) AS bias, SQRT(AVG(error * error)) AS rmse, SQRT(AVG(true_theta * true_theta)) AS no_response_rmse, COUNT(*) FILTER (WHERE covered) AS covered, AVG(interval_width) AS mean_interval_width, COUNT(*) FILTER (WHERE false_positive) AS false_positives, COUNT(false_positive) AS null_intervals, COUNT(*) FILTER (WHERE covered) / COUNT(*) FILTER (WHERE interval_available)::DOUBLE AS coverage FROM rows_ GROUP BY 1, 2))"""
_N04_KINDS = {"dgp_id": "", "estimator": "", **dict.fromkeys(("attempted", "valid_points", "available_intervals", "covered", "false_positives", "null_intervals"), "i"), **dict.fromkeys(("bias", "rmse", "no_response_rmse", "mean_interval_width", "coverage"), "r"), **dict.fromkeys(("check_available", "check_bias", "check_rmse", "check_coverage", "check_false_positives", "status"), "")}


@query("N04_supply_benchmark_summary", sql_shown(on_rows(_N04), _N04_KINDS))
def n04(spark, sf):
    return shown(evaluate.supply_benchmark_summary(seed_rows(spark, sf), LIMITS).select(*_N04_KINDS))


_SDR = """SELECT *, CASE WHEN comparison_status = 'comparable' THEN rms_se / empirical_sd END AS sd_ratio FROM (SELECT *, CASE WHEN unmatched_seeds > 0 THEN 'unmatched_seed_cohorts' WHEN empirical_sd IS NULL THEN 'insufficient_replicates' WHEN empirical_sd = 0 THEN 'zero_variance' ELSE 'comparable' END AS comparison_status FROM (
SELECT dgp_id, estimator, STDDEV_SAMP(theta) AS empirical_sd, AVG(standard_error) AS mean_se, SQRT(AVG(standard_error * standard_error)) AS rms_se, COUNT(standard_error) AS se_denominator, COUNT(*) FILTER (WHERE (theta IS NOT NULL) <> (standard_error IS NOT NULL)) AS unmatched_seeds FROM sr GROUP BY 1, 2))"""
_MATCHED = "SELECT * REPLACE (CASE WHEN dgp_id = 'A' THEN standard_error ELSE (theta_upper - theta_lower) / (2 * 1.96) END AS standard_error) FROM rows_"


def matched_rows(spark, sf) -> DataFrame:
    se = (F.col("theta_upper") - F.col("theta_lower")) / (2 * 1.96)
    return seed_rows(spark, sf).withColumn("standard_error", F.when(F.col("dgp_id") == "A", F.col("standard_error")).otherwise(se))


_SDR_KINDS = {"dgp_id": "", "estimator": "", "empirical_sd": "r", "mean_se": "r", "rms_se": "r", "se_denominator": "i", "unmatched_seeds": "i", "comparison_status": "", "sd_ratio": "r"}


@query("N05_sd_ratio", sql_shown(on_rows(_SDR, sr=_MATCHED), _SDR_KINDS))
def n05(spark, sf):
    return shown(evaluate.sd_ratio(matched_rows(spark, sf)))


def method_rows(spark, sf) -> DataFrame:
    """Two interval methods per seed: the given one, and one 1.3 times as wide."""
    base = seed_rows(spark, sf)
    mid, half = F.col("theta"), (F.col("theta_upper") - F.col("theta_lower")) * 0.65
    wide = base.withColumns({"theta_lower": mid - half, "theta_upper": mid + half})
    wide = wide.withColumns({c: F.when(F.col("seed") % 7 != 0, F.col(c)) for c in ("theta_lower", "theta_upper")})
    return base.withColumn("interval_method", F.lit("percentile")).unionByName(evaluate.method_metrics(wide).withColumn("interval_method", F.lit("wide")))


_MROWS = "SELECT dgp_id, estimator, seed, 'percentile' AS im, theta_lower AS lo, theta_upper AS hi_, true_theta AS tt FROM rows_ UNION ALL SELECT dgp_id, estimator, seed, 'wide', CASE WHEN seed % 7 <> 0 THEN theta - 0.65 * (theta_upper - theta_lower) END, CASE WHEN seed % 7 <> 0 THEN theta + 0.65 * (theta_upper - theta_lower) END, true_theta FROM rows_"
_CMP_KINDS = {"paired_intervals": "i", "coverage_change": "r", "coverage_gains": "i", "coverage_losses": "i", "width_ratio_denominator": "i", "mean_width_ratio": "r"}


@query("N06_interval_comparison", sql_shown(on_rows("""SELECT c.dgp_id, c.estimator, c.im AS interval_method, c.a AS available_intervals, c.u AS unavailable_intervals, c.mw AS mean_width, p.* EXCLUDE (dgp_id, estimator, im) FROM (SELECT dgp_id, estimator, im, COUNT(lo) AS a, COUNT(*) - COUNT(lo) AS u, AVG(hi_ - lo) AS mw FROM mr GROUP BY 1, 2, 3) c JOIN (SELECT x.dgp_id, x.estimator, x.im, COUNT(*) AS paired_intervals, AVG(x.cv::INT - y.cv::INT) AS coverage_change, COUNT(*) FILTER (WHERE x.cv AND NOT y.cv) AS coverage_gains, COUNT(*) FILTER (WHERE NOT x.cv AND y.cv) AS coverage_losses, COUNT(*) AS width_ratio_denominator, AVG((x.hi_ - x.lo) / (y.hi_ - y.lo)) AS mean_width_ratio FROM mc x JOIN mc y USING (dgp_id, estimator, seed) WHERE y.im = 'percentile' GROUP BY 1, 2, 3) p USING (dgp_id, estimator, im)""", mr=_MROWS, mc="SELECT *, lo <= tt AND tt <= hi_ AS cv FROM mr WHERE lo IS NOT NULL"), {"dgp_id": "", "estimator": "", "interval_method": "", "available_intervals": "i", "unavailable_intervals": "i", "mean_width": "r", **_CMP_KINDS}))
def n06(spark, sf):
    return shown(evaluate.interval_comparison(method_rows(spark, sf)))


@query("N07_paired_estimators", sql_shown(on_rows("SELECT dgp_id, COUNT(a.theta - b.theta) AS paired_points, AVG(a.error - b.error) AS mean_error_difference, COUNT(*) FILTER (WHERE a.covered IS NOT NULL AND b.covered IS NOT NULL) AS paired_intervals, AVG(a.covered::INT - b.covered::INT) AS coverage_change, COUNT(*) FILTER (WHERE a.covered AND NOT b.covered) AS coverage_gains, COUNT(*) FILTER (WHERE NOT a.covered AND b.covered) AS coverage_losses, COUNT(a.interval_width / b.interval_width) AS width_ratio_denominator, AVG(a.interval_width / b.interval_width) AS mean_width_ratio FROM rows_ a JOIN rows_ b USING (dgp_id, seed) WHERE a.estimator = 'F' AND b.estimator = 'O' GROUP BY 1"), {"dgp_id": "", "paired_points": "i", "mean_error_difference": "r", **_CMP_KINDS}))
def n07(spark, sf):
    return shown(evaluate.paired_estimators(seed_rows(spark, sf), "F", "O"))


_N08_KINDS = {"dgp_id": "", "estimator": "", "attempted_seeds": "i", "bias": "r", "rmse": "r", "covered_seeds": "i", "coverage": "r", "coverage_lower": "r", "coverage_upper": "r", "empirical_sd": "r", "rms_se": "r", "se_ratio": "r", "mean_width": "r", "available_intervals": "i"}


@query("N08_score_summary", sql_shown(on_rows("SELECT f.dgp_id, f.estimator, attempted_seeds, bias, rmse, covered_seeds, coverage, coverage_lower, coverage_upper, empirical_sd, rms_se, sd_ratio AS se_ratio, mw AS mean_width, ai AS available_intervals FROM full_cells f JOIN sdr USING (dgp_id, estimator) JOIN (SELECT dgp_id, estimator, AVG(interval_width) AS mw, COUNT(*) FILTER (WHERE interval_available) AS ai FROM rows_ GROUP BY 1, 2) w USING (dgp_id, estimator)", **_CELL_CTES, sr=_MATCHED, sdr=_SDR), _N08_KINDS))
def n08(spark, sf):
    return shown(evaluate.score_summary(matched_rows(spark, sf), 100).select(*_N08_KINDS))


_TESTS = f"SELECT dgp_id, estimator, 'covered' AS \"check\", covered_seeds AS n_success, coverage_denominator AS n_trials, {binomial_terms('coverage_denominator', '0.95', '0', 'covered_seeds')} AS p_value FROM cells WHERE coverage_denominator > 0 UNION ALL SELECT dgp_id, estimator, 'false_positive', false_positives, false_positive_denominator, {binomial_terms('false_positive_denominator', '0.05', 'false_positives', 'false_positive_denominator')} FROM cells WHERE false_positive_denominator > 0"
_HOLM = "SELECT *, LEAST(1, MAX(raw) OVER (ORDER BY p_value, raw DESC ROWS UNBOUNDED PRECEDING)) AS p_holm FROM (SELECT *, p_value * (COUNT(*) OVER () - ROW_NUMBER() OVER (ORDER BY p_value) + 1) AS raw FROM {source})"


@query("N09_coverage_tests", sql_shown(on_rows('SELECT dgp_id, estimator, "check", n_success, n_trials, p_value, p_holm, p_holm < 0.05 AS rejected FROM (' + _HOLM.format(source="tests_") + ")", cells=_AGGM, tests_=_TESTS), {"dgp_id": "", "estimator": "", "check": "", "n_success": "i", "n_trials": "i", "p_value": "r", "p_holm": "r", "rejected": ""}))
def n09(spark, sf):
    return shown(evaluate.coverage_tests(evaluate.aggregate_metrics(seed_rows(spark, sf), 100)))


@query("N10_method_overview", sql_shown(on_rows("SELECT estimator, MAX(ABS(bias)) AS max_abs_bias, MAX(rmse) AS max_rmse, MIN(covered_seeds / coverage_denominator::DOUBLE) AS coverage_min, MAX(covered_seeds / coverage_denominator::DOUBLE) AS coverage_max FROM cells GROUP BY 1", cells=_AGGM), {"estimator": "", "max_abs_bias": "r", "max_rmse": "r", "coverage_min": "r", "coverage_max": "r"}))
def n10(spark, sf):
    return shown(evaluate.method_overview(evaluate.aggregate_metrics(seed_rows(spark, sf), 100), ["estimator"]))


@query("N11_audit_rows", on_rows("SELECT 'error_mismatch' AS rule, COUNT(*) FILTER (WHERE theta IS NOT NULL AND seed % 11 = 0) AS violations FROM rows_ UNION ALL SELECT 'coverage_mismatch', COUNT(*) FILTER (WHERE seed % 19 = 0 AND covered IS NOT NULL) FROM rows_ UNION ALL SELECT 'reversed_interval', 0 UNION ALL SELECT 'interval_without_point', 0 UNION ALL SELECT 'true_theta_varies', 0 UNION ALL SELECT 'theta_varies', COUNT(*) FROM (SELECT dgp_id, seed FROM rows_ GROUP BY 1, 2 HAVING MAX(theta) <> MIN(theta))"))
def n11(spark, sf):
    rows = seed_rows(spark, sf)
    stored = rows.withColumns(
        {
            "error": F.when(F.col("seed") % 11 == 0, F.col("error") + 0.5).otherwise(F.col("error")),
            "covered": F.when(F.col("seed") % 19 == 0, ~F.col("covered")).otherwise(F.col("covered")),
        }
    )
    return evaluate.audit_rows(stored, ["dgp_id", "seed"], ["true_theta", "theta"])


_FAMILY = "SELECT dgp_id, estimator, COUNT(*) AS attempted, COUNT(theta) AS valid, COUNT(*) FILTER (WHERE interval_available) AS intervals, AVG(error) AS bias, SQRT(AVG(error * error)) AS rmse, COUNT(*) FILTER (WHERE SIGN(theta) <> SIGN(true_theta) AND true_theta <> 0) AS sign_errors, COUNT(*) FILTER (WHERE covered) AS covered, AVG(interval_width) AS mean_width, COUNT(*) FILTER (WHERE theta_lower > 0 OR theta_upper < 0) AS zero_exclusions FROM rows_ GROUP BY 1, 2"
_FAMP = f"SELECT *, {binomial_terms('intervals', '0.95', '0', 'covered')} AS p_value FROM fam"
_N12_KINDS = {"dgp_id": "", "estimator": "", **dict.fromkeys(("attempted", "valid", "intervals", "sign_errors", "covered", "zero_exclusions"), "i"), **dict.fromkeys(("bias", "rmse", "mean_width", "undercoverage_p", "undercoverage_holm"), "r")}


@query("N12_contrast_family_summary", sql_shown(on_rows("SELECT f.* EXCLUDE (p_value), f.p_value AS undercoverage_p, h.p_holm AS undercoverage_holm FROM famp f LEFT JOIN (" + _HOLM.format(source="(SELECT * FROM famp WHERE estimator = 'F')") + ") h USING (dgp_id, estimator)", fam=_FAMILY, famp=_FAMP), _N12_KINDS))
def n12(spark, sf):
    out = evaluate.contrast_family_summary(seed_rows(spark, sf), evaluate.CELL, F.col("estimator") == "F")
    return shown(out.select(*_N12_KINDS))


@query("N12_paired_rmse", sql_shown(on_rows("SELECT b.estimator AS reference, dgp_id, COUNT(*) AS attempted, COUNT(a.error + b.error) AS common_valid, SQRT(AVG(CASE WHEN b.error IS NOT NULL THEN a.error * a.error END)) AS new_rmse, SQRT(AVG(CASE WHEN a.error IS NOT NULL THEN b.error * b.error END)) AS reference_rmse FROM rows_ a JOIN rows_ b USING (dgp_id, seed) WHERE a.estimator = 'F' AND b.estimator = 'O' GROUP BY 1, 2"), {"reference": "", "dgp_id": "", "attempted": "i", "common_valid": "i", "new_rmse": "r", "reference_rmse": "r"}))
def n12_paired(spark, sf):
    return shown(evaluate.paired_rmse(seed_rows(spark, sf), "F", ["O"]))


@query("N12_gates", on_rows("SELECT FALSE AS recovery_and_availability, BOOL_AND(COALESCE(p_holm >= 0.05, TRUE)) AS no_undercoverage_rejection FROM (" + _HOLM.format(source="(SELECT * FROM famp WHERE estimator = 'F')") + ")", fam=_FAMILY, famp=_FAMP))
def n12_gates(spark, sf):
    family = evaluate.contrast_family_summary(seed_rows(spark, sf), evaluate.CELL, F.col("estimator") == "F")
    return evaluate.gates(family, 0.01, 0.005, 0.05)


# --- distribution functions ---------------------------------------------------------------

_RETURNED = "SELECT l_suppkey AS id, AVG((l_returnflag = 'R')::INT)::DOUBLE AS p FROM lineitem GROUP BY 1"
_NQ = ", ".join(f"{name} AS ({sql})" for name, sql in recursive(nq=normal_quantiles("nq_in")).items())


@query("R01_norm_ppf", sql_shown(f"WITH RECURSIVE nq_in AS (SELECT * FROM ({_RETURNED}) WHERE p > 0 AND p < 1), {_NQ} SELECT id AS l_suppkey, (lo + hi) / 2 AS quantile FROM nq WHERE step = 48", {"l_suppkey": "i", "quantile": "r"}))
def r01_norm(spark, sf):
    shares = bindings.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("p"))
    return shown(shares.filter("p > 0 and p < 1").select("l_suppkey", norm_ppf("p").alias("quantile")))


@query("R01_t_ppf", sql_shown("WITH RECURSIVE tq_in AS (SELECT l_suppkey AS id, 0.975::DOUBLE AS p, (COUNT(*) - 1)::DOUBLE AS df FROM lineitem GROUP BY 1), " + ", ".join(f"{n} AS ({b})" for n, b in _TQ.items()) + " SELECT id AS l_suppkey, df, hi AS critical FROM tq WHERE step = 48", {"l_suppkey": "i", "df": "r", "critical": "r"}))
def r01(spark, sf):
    counts = bindings.table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.count(F.lit(1)) - 1).alias("df"))
    return shown(counts.select("l_suppkey", F.col("df").cast("double").alias("df"), t_ppf(0.975, "df").alias("critical")))


_RK = "SELECT l_suppkey AS id, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS k, COUNT(*) AS n FROM lineitem GROUP BY 1"


def _return_counts(spark, sf) -> DataFrame:
    return bindings.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n"))


@query("R02_clopper_pearson", sql_shown(f"WITH RECURSIVE kn AS ({_RK}), " + ", ".join(f"{n} AS ({b})" for n, b in recursive(cp=clopper_bounds("kn")).items()) + " SELECT id AS l_suppkey, k, n, ll AS lower, uh AS upper FROM cp WHERE step = 40", {"l_suppkey": "i", "k": "i", "n": "i", "lower": "r", "upper": "r"}))
def r02(spark, sf):
    counts = _return_counts(spark, sf).withColumn("b", clopper_pearson("k", "n"))
    return shown(counts.select("l_suppkey", "k", "n", "b.lower", "b.upper"))


@query("R03_binom_test", sql_shown(f"SELECT id AS l_suppkey, {binomial_terms('n', '0.3', '0', 'k')} AS less, {binomial_terms('n', '0.3', 'k', 'n')} AS greater FROM ({_RK})", {"l_suppkey": "i", "less": "r", "greater": "r"}))
def r03(spark, sf):
    return shown(_return_counts(spark, sf).select("l_suppkey", binom_test("k", "n", 0.3, "less").alias("less"), binom_test("k", "n", 0.3, "greater").alias("greater")))


@query("R04_holm_adjust", sql_shown("SELECT l_suppkey, p_value, p_holm FROM (" + _HOLM.format(source=f"(SELECT id AS l_suppkey, {binomial_terms('n', '0.3', '0', 'k')} AS p_value FROM ({_RK}))") + ")", {"l_suppkey": "i", "p_value": "r", "p_holm": "r"}))
def r04(spark, sf):
    tests = _return_counts(spark, sf).select("l_suppkey", binom_test("k", "n", 0.3, "less").alias("p_value"))
    return shown(holm_adjust(tests, "p_value", []))


@query("R05_weighted_mean", sql_shown("SELECT l_returnflag, SUM(l_quantity * l_discount) / SUM(l_quantity) AS weighted, SUM(l_tax) / NULLIF(SUM(CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity END), 0) AS guarded, COUNT(*) AS n_finite FROM lineitem GROUP BY 1", {"l_returnflag": "", "weighted": "r", "guarded": "r", "n_finite": "i"}))
def r05(spark, sf):
    line = bindings.table(spark, sf, "lineitem")
    kept = F.sum(F.when(F.col("l_returnflag") == "A", 0.0).otherwise(F.col("l_quantity")))
    return shown(line.groupBy("l_returnflag").agg(weighted_mean("l_discount", "l_quantity").alias("weighted"), safe_div(F.sum("l_tax"), kept).alias("guarded"), F.count_if(is_finite("l_extendedprice")).alias("n_finite")))


@query("R06_fingerprint", "SELECT n_nationkey::BIGINT AS n_nationkey, SHA256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}') AS fingerprint FROM nation")
def r06(spark, sf):
    nation = bindings.table(spark, sf, "nation")
    return nation.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), fingerprint("n_nationkey", "n_name").alias("fingerprint"))


@query("R07_hash_uniform", sql_shown("SELECT user_id % 10 AS g, COUNT(*) AS n, AVG(u) AS mean_u, MIN(u) AS min_u FROM (SELECT user_id, ('0x' || SUBSTR(MD5('5-' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events) GROUP BY 1", {"g": "i", "n": "i", "mean_u": "r", "min_u": "r"}))
def r07(spark, sf):
    events = bindings.table(spark, sf, "events").select("user_id", hash_uniform(F.lit(5), "event_id").alias("u"))
    return shown(events.groupBy((F.col("user_id") % 10).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("mean_u"), F.min("u").alias("min_u")))


# --- choice model -------------------------------------------------------------------------

def tasks(spark, sf) -> DataFrame:
    return bindings.choice_tasks(spark, sf).withColumns({"av0": F.lit(True), "av1": F.lit(True)})


def on_tasks(body: str, **extra: str) -> str:
    return with_views(body, "choice_tasks", **extra)


@query("O01_choice_quality", on_tasks("SELECT 'nonfinite_attribute' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'negative_attribute', 0 UNION ALL SELECT 'unknown_choice', 0 UNION ALL SELECT 'chosen_unavailable', COUNT(*) FILTER (WHERE choice_index = 2 AND NOT av2) FROM choice_tasks UNION ALL SELECT 'nothing_available', 0 UNION ALL SELECT 'repeated_task', COALESCE(SUM(n - 1), 0)::BIGINT FROM (SELECT COUNT(*) AS n FROM choice_tasks GROUP BY person_id, choice_index, tt0, co0 HAVING COUNT(*) > 1)"))
def o01(spark, sf):
    return mnl.choice_quality(tasks(spark, sf), ["person_id", "choice_index", "tt0", "co0"])


@query("O01_prepare_choices", on_tasks("SELECT choice_index::BIGINT AS choice_index, COUNT(*) AS n FROM choice_tasks WHERE NOT (choice_index = 2 AND NOT av2) GROUP BY 1"))
def o01_prepare(spark, sf):
    kept = mnl.prepare_choices(tasks(spark, sf))
    return kept.groupBy(F.col("choice_index").cast("bigint").alias("choice_index")).agg(F.count(F.lit(1)).alias("n"))


_PEOPLE = "SELECT person_id, ROW_NUMBER() OVER (ORDER BY ('0x' || SUBSTR(MD5('42-' || person_id), 1, 8))::BIGINT) - 1 AS r, COUNT(*) OVER () AS n FROM (SELECT DISTINCT person_id FROM choice_tasks)"
_SPLIT_P = "SELECT person_id, CASE WHEN r < FLOOR(n * 0.7) THEN 'train' WHEN r < FLOOR(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM people"


@query("O02_split_people", on_tasks("SELECT split, COUNT(*) AS n_tasks, COUNT(DISTINCT person_id) AS n_people FROM choice_tasks JOIN sp USING (person_id) GROUP BY 1", people=_PEOPLE, sp=_SPLIT_P))
def o02(spark, sf):
    split = mnl.split_people(tasks(spark, sf), 42)
    per_person = split.groupBy("split", "person_id").count()
    return per_person.groupBy("split").agg(F.sum("count").alias("n_tasks"), F.count(F.lit(1)).alias("n_people"))


@query("O03_choice_features", sql_shown(on_tasks("SELECT person_id, COUNT(*) AS n, SUM(tt0 / 100) AS t0, SUM(tt2 / 100) AS t2, SUM(CASE WHEN person_id % 2 = 0 THEN 0 ELSE co0 / 100 END) AS c0, SUM(CASE WHEN person_id % 2 = 0 THEN 0 ELSE co1 / 100 END) AS c1, SUM(co2 / 100) AS c2 FROM choice_tasks GROUP BY 1"), {"person_id": "i", "n": "i", **dict.fromkeys(("t0", "t2", "c0", "c1", "c2"), "r9")}))
def o03(spark, sf):
    holders = tasks(spark, sf).withColumn("pass", F.col("person_id") % 2 == 0)
    out = mnl.choice_features(holders, "pass")
    return shown(out.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("t0", "t2", "c0", "c1", "c2")]), 9)


BETA = (0.2, -0.1, -1.5, -0.8)
_UTIL = "SELECT person_id, choice_index, 0.2 - 1.5::DOUBLE * tt0 / 100 - 0.8::DOUBLE * co0 / 100 AS u0, -1.5::DOUBLE * tt1 / 100 - 0.8::DOUBLE * co1 / 100 AS u1, CASE WHEN av2 THEN -0.1 - 1.5::DOUBLE * tt2 / 100 - 0.8::DOUBLE * co2 / 100 END AS u2 FROM choice_tasks"
_LP = "SELECT person_id, choice_index, u0 - d AS lp0, u1 - d AS lp1, u2 - d AS lp2, CASE choice_index WHEN 0 THEN u0 WHEN 1 THEN u1 ELSE u2 END - d AS lpc, CASE WHEN u0 >= u1 AND (u2 IS NULL OR u0 >= u2) THEN 0 WHEN u2 IS NULL OR u1 >= u2 THEN 1 ELSE 2 END AS pick FROM (SELECT *, LN(EXP(u0) + EXP(u1) + COALESCE(EXP(u2), 0)) AS d FROM ut)"


@query("O04_log_probabilities", sql_shown(on_tasks("SELECT person_id, SUM(lp0) AS lp0, SUM(lp1) AS lp1, SUM(lp2) AS lp2, COUNT(lp2) AS n2 FROM lp GROUP BY 1", ut=_UTIL, lp=_LP), {"person_id": "i", "lp0": "r5", "lp1": "r5", "lp2": "r5", "n2": "i"}))
def o04(spark, sf):
    out = mnl.log_probabilities(mnl.choice_features(tasks(spark, sf)), BETA)
    return shown(out.groupBy("person_id").agg(*[F.sum(f"lp{j}").alias(f"lp{j}") for j in range(3)], F.count("lp2").alias("n2")), 5)


@query("O05_fit_mnl_constants", sql_shown(on_tasks("SELECT LN(n0 / n1) AS asc_0, LN(n2 / n1) AS asc_2, n0 * LN(n0 / n) + n1 * LN(n1 / n) + n2 * LN(n2 / n) AS log_likelihood FROM (SELECT COUNT(*) FILTER (WHERE choice_index = 0)::DOUBLE AS n0, COUNT(*) FILTER (WHERE choice_index = 1)::DOUBLE AS n1, COUNT(*) FILTER (WHERE choice_index = 2)::DOUBLE AS n2, COUNT(*)::DOUBLE AS n FROM choice_tasks)"), {"asc_0": "r", "asc_2": "r", "log_likelihood": "r3"}))
def o05_constants(spark, sf):
    free = mnl.choice_features(tasks(spark, sf).withColumn("av2", F.lit(True)))
    fit = mnl.fit_mnl(free, attributes=False)
    row = (float(fit["beta"][0]), float(fit["beta"][1]), round(float(fit["log_likelihood"]), 3))
    return shown(spark.createDataFrame([row], "asc_0 double, asc_2 double, log_likelihood double"))


def _newton_sql(name: str = "nw", source: str = "mt") -> str:
    """Recursive body: twelve Newton steps from zero; b holds the estimates, se their errors."""
    x = [["1", "0", "t0", "c0"], ["0", "0", "t1", "c1"], ["0", "1", "t2", "c2"]]
    p = ["p0", "p1", "p2"]
    mean = [" + ".join(f"{p[j]} * {x[j][a]}" for j in range(3)) for a in range(4)]
    chosen = [f"CASE choice_index WHEN 0 THEN {x[0][a]} WHEN 1 THEN {x[1][a]} ELSE {x[2][a]} END" for a in range(4)]
    rows = []
    for a in range(4):
        second = [f"SUM({' + '.join(f'{p[j]} * {x[j][a]} * {x[j][b]}' for j in range(3))} - ({mean[a]}) * ({mean[b]}))" for b in range(4)]
        unit = ["1.0" if a == b else "0.0" for b in range(4)]
        rows.append("[" + ", ".join([*second, f"SUM({chosen[a]} - ({mean[a]}))", *unit]) + "]")
    utility = "b[1] + b[3] * t0 + b[4] * c0 AS u0, b[3] * t1 + b[4] * c1 AS u1, b[2] + b[3] * t2 + b[4] * c2 AS u2"
    shares = f"SELECT k, b, choice_index, t0, t1, t2, c0, c1, c2, EXP(u0) / d AS p0, EXP(u1) / d AS p1, CASE WHEN av2 THEN EXP(u2) ELSE 0 END / d AS p2 FROM (SELECT *, EXP(u0) + EXP(u1) + CASE WHEN av2 THEN EXP(u2) ELSE 0 END AS d FROM (SELECT {name}.k, {name}.b, {source}.*, {utility} FROM {name} CROSS JOIN {source} WHERE k < 12))"
    body = f"SELECT k, b, [{', '.join(rows)}]::DOUBLE[][] AS m FROM ({shares}) GROUP BY k, b"
    for i in range(1, 5):
        body = f"SELECT k, b, list_transform(m, lambda r, i: CASE WHEN i = {i} THEN list_transform(r, lambda v: v / m[{i}][{i}]) ELSE list_transform(r, lambda v, j: v - r[{i}] * m[{i}][j] / m[{i}][{i}]) END) AS m FROM ({body})"
    return f"SELECT 0 AS k, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS b, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS se UNION ALL SELECT k + 1, list_transform(b, lambda v, i: v + m[i][5]), list_transform(b, lambda v, i: SQRT(m[i][5 + i])) FROM ({body})"


_TASKS_SQL = "SELECT choice_index, av2, tt0 / 100 AS t0, tt1 / 100 AS t1, tt2 / 100 AS t2, co0 / 100 AS c0, co1 / 100 AS c1, co2 / 100 AS c2 FROM choice_tasks WHERE NOT (choice_index = 2 AND NOT av2)"


@query("O05_fit_mnl", sql_shown(on_tasks("SELECT UNNEST(['asc_0', 'asc_2', 'time', 'cost']) AS parameter, UNNEST(b) AS estimate, UNNEST(se) AS standard_error FROM nw WHERE k = 12", mt=_TASKS_SQL, nw=_newton_sql()), {"parameter": "", "estimate": "r5", "standard_error": "r5"}))
def o05(spark, sf):
    data = mnl.choice_features(mnl.prepare_choices(tasks(spark, sf)))
    fit = mnl.fit_mnl(data)
    rows = [(n, float(b), float(s)) for n, b, s in zip(mnl.PARAMETERS, fit["beta"], fit["standard_errors"])]
    return shown(spark.createDataFrame(rows, "parameter string, estimate double, standard_error double"), 5)


_KEYED_NEWTON = {}
for _k in (0, 1):
    _KEYED_NEWTON |= {f"mt{_k}": f"{_TASKS_SQL} AND person_id % 2 = {_k}", f"nw{_k}": _newton_sql(f"nw{_k}", f"mt{_k}")}
_KEYED_FITS = " UNION ALL ".join(
    f"SELECT {k} AS dataset, 'ok' AS status, (SELECT COUNT(*) FROM mt{k}) AS n, UNNEST(['asc_0', 'asc_2', 'time', 'cost']) AS parameter, "
    f"UNNEST(b) AS estimate, UNNEST(se) AS standard_error FROM nw{k} WHERE k = 12"
    for k in (0, 1)
)


@query("O05_fit_mnl_by", sql_shown(on_tasks(_KEYED_FITS, **_KEYED_NEWTON), {"dataset": "i", "status": "", "n": "i", "parameter": "", "estimate": "r5", "standard_error": "r5"}))
def o05_by(spark, sf):
    data = mnl.choice_features(mnl.prepare_choices(tasks(spark, sf))).withColumn("dataset", (F.col("person_id") % 2).cast("int"))
    fits = choice_fits.fit_mnl_by(data, ["dataset"])
    names = F.array(*[F.lit(p) for p in mnl.PARAMETERS])
    rows = fits.select("dataset", "status", "n", F.explode(F.arrays_zip(names.alias("parameter"), F.col("beta").alias("estimate"), F.col("standard_errors").alias("standard_error"))).alias("r"))
    return shown(rows.select("dataset", "status", "n", "r.parameter", "r.estimate", "r.standard_error"), 5)


@query("O06_score_mnl", sql_shown(on_tasks("SELECT split, SUM(n) AS n_tasks, COUNT(*) AS n_people, SUM(l) / SUM(n) AS log_loss, AVG(l / n) AS person_mean_loss, SUM(h) / SUM(n) AS accuracy FROM (SELECT split, person_id, COUNT(*) AS n, SUM(-lpc) AS l, SUM((pick = choice_index)::INT)::DOUBLE AS h FROM lp JOIN sp USING (person_id) WHERE lpc IS NOT NULL GROUP BY 1, 2) GROUP BY 1", people=_PEOPLE, sp=_SPLIT_P, ut=_UTIL, lp=_LP), {"split": "", "n_tasks": "i", "n_people": "i", "log_loss": "r", "person_mean_loss": "r", "accuracy": "r"}))
def o06(spark, sf):
    data = mnl.split_people(mnl.choice_features(mnl.prepare_choices(tasks(spark, sf))), 42)
    return shown(mnl.score_mnl(data, BETA, ["split"]))
