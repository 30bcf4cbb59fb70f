"""Registered queries: price scenarios, support, forecasts and demand plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.functions.scalars import ntz
from farewise.operators import analytic, choice, demand, inference, resample, scenario
from farewise.plans.catalogue import query, shown, sql_shown
from farewise.plans.choices import (
    _ADJUSTED,
    _SCORE_CTES,
    _TQ,
    _WIDTH,
    T,
    Y,
    Z,
    ZONES,
    _dot,
    coefficient,
    encoded,
    feature_blocks,
    fitted,
    mult,
    ols,
    on_a_line,
    on_blocks,
    train,
)
from farewise.sources import bindings

MIN_BLOCKS = 2
REQUESTS = [
    ("x_plus_10", "all", 1.0, 1.0, 1.1, 1.0, 10000),
    ("y_plus_5", "zone_1", 1.0, 1.0, 1.0, 1.05, 5000),
    ("off_range", "zone_2", 1.0, 1.0, 1.2, 1.0, 1000),
    ("middle", "zone_3", 0.95, 1.0, 1.05, 1.05, 2000),
    ("x_minus_10", "zone_0", 1.0, 1.0, 0.9, 1.0, 3000),
]
_FIELDS = "scenario_id string, target_context_set string, multiplier_x0 double, multiplier_y0 double, multiplier_x1 double, multiplier_y1 double, n_sessions bigint"
_REQ = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{s}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {k}::BIGINT)" for n, s, a, b, c, d, k in REQUESTS
) + ") r(scenario_id, target_context_set, multiplier_x0, multiplier_y0, multiplier_x1, multiplier_y1, n_sessions)"


def requests(spark: SparkSession, rows=REQUESTS) -> DataFrame:
    return spark.createDataFrame(rows, _FIELDS)


TZ, SLOT = "America/New_York", 240
START_UTC, END_UTC = "2024-01-10 05:00:00", "2024-01-13 05:00:00"
_UTC = "SELECT *, CAST(day_id AS TIMESTAMP) + hr * INTERVAL '1' HOUR + INTERVAL '5' HOUR AS block_start, CAST(day_id AS TIMESTAMP) + (hr + 9) * INTERVAL '1' HOUR AS block_end FROM blocks"


@query("G01_select_contexts", sql_shown(on_blocks(f"SELECT zone_id, block_start, block_end, FALSE AS clock_unclear FROM u WHERE block_start >= TIMESTAMP '{START_UTC}' AND block_end <= TIMESTAMP '{END_UTC}'", u=_UTC), {"zone_id": "i", "block_start": "t", "block_end": "t", "clock_unclear": ""}))
def g01(spark, sf):
    rows = scenario.select_contexts(feature_blocks(spark, sf), ntz(START_UTC), ntz(END_UTC), TZ, SLOT)
    return shown(rows.select("zone_id", "block_start", "block_end", "clock_unclear"))


@query("G01_tiling", sql_shown(on_blocks(f"SELECT zone_id, COUNT(*) AS n_blocks, MIN(block_start) = TIMESTAMP '{START_UTC}' AS starts_on_horizon, MAX(block_end) = TIMESTAMP '{END_UTC}' AS ends_on_horizon, COUNT(*) FILTER (WHERE nx <> block_end) AS broken_joints FROM (SELECT *, LEAD(block_start) OVER (PARTITION BY zone_id ORDER BY block_start) AS nx FROM u WHERE block_start >= TIMESTAMP '{START_UTC}' AND block_end <= TIMESTAMP '{END_UTC}' AND NOT (zone_id = 3 AND hr = 8)) GROUP BY 1", u=_UTC), {"zone_id": "i", "n_blocks": "i", "starts_on_horizon": "", "ends_on_horizon": "", "broken_joints": "i"}))
def g01_tiling(spark, sf):
    rows = scenario.select_contexts(feature_blocks(spark, sf), ntz(START_UTC), ntz(END_UTC), TZ, SLOT)
    return shown(scenario.tiling(rows.filter("not (zone_id = 3 and hr = 8)"), ntz(START_UTC), ntz(END_UTC)))


_SUPPORT = {
    "req": _REQ,
    "pts": "SELECT scenario_id, target_context_set AS cs, 'baseline' AS point, multiplier_x0 AS x, multiplier_y0 AS y FROM req UNION ALL SELECT scenario_id, target_context_set, 'target', multiplier_x1, multiplier_y1 FROM req",
    "lv": "SELECT UNNEST([0.9::DOUBLE, 1.0, 1.1]) AS l",
    "adj": "SELECT v, l FROM (SELECT DISTINCT x AS v FROM pts UNION SELECT DISTINCT y FROM pts), lv WHERE ABS(l - v) <= 1e-10 OR (NOT EXISTS (SELECT 1 FROM lv z WHERE ABS(z.l - v) <= 1e-10) AND ABS(l - v) < 0.1 - 1e-9 AND v > 0.9 AND v < 1.1)",
    "crn": "SELECT p.*, a.l AS cx, b.l AS cy FROM pts p LEFT JOIN adj a ON p.x = a.v LEFT JOIN adj b ON p.y = b.v",
    "st": "SELECT DISTINCT zone_id, is_weekend, is_peak FROM blocks",
    "cnt": "SELECT zone_id, is_weekend, is_peak, multiplier_x AS cx, multiplier_y AS cy, COUNT(*) AS n FROM train GROUP BY ALL",
    "tab": "SELECT c.*, s.*, COALESCE(n, 0) AS n, (SELECT COUNT(*) FROM train t WHERE t.multiplier_x = c.cx AND t.multiplier_y = c.cy) AS total FROM crn c JOIN st s ON c.cs = 'all' OR c.cs = 'zone_' || s.zone_id LEFT JOIN cnt USING (zone_id, is_weekend, is_peak, cx, cy)",
    "sup": f"SELECT scenario_id, point, CASE WHEN bool_or(cx IS NULL OR cy IS NULL) OR MIN(total) = 0 THEN 'out_of_support' WHEN MIN(n) < {MIN_BLOCKS} THEN 'insufficient_support' ELSE 'ok' END AS support_status, MIN(n) AS min_blocks, CASE WHEN bool_or(cx IS NULL OR cy IS NULL) OR MIN(total) = 0 THEN 0 ELSE COUNT(*) FILTER (WHERE n < {MIN_BLOCKS}) END AS n_reasons FROM tab GROUP BY 1, 2",
}


@query("G02_joint_support", sql_shown(on_blocks("SELECT * FROM sup", **_SUPPORT), {"scenario_id": "", "point": "", "support_status": "", "min_blocks": "i", "n_reasons": "i"}))
def g02(spark, sf):
    support = scenario.joint_support(train(spark, sf), feature_blocks(spark, sf), requests(spark), MIN_BLOCKS)
    return shown(support.drop("reasons"))


_LINE_REQ = [("exact", "all", 1.0, 1.0, 1.1, 1.1**0.5, 10), ("between", "zone_1", 1.0, 1.0, 1.05, 1.05**0.5, 10), ("beyond", "all", 1.0, 1.0, 1.2, 1.2**0.5, 10), ("off_line", "all", 1.0, 1.0, 1.1, 1.1, 10)]


@query("G03_line_support", sql_shown(on_blocks(f"""SELECT scenario_id, point, CASE WHEN off > 1e-8 OR mn IS NULL THEN 'out_of_support' WHEN mn < {MIN_BLOCKS} THEN 'insufficient_support' ELSE 'ok' END AS support_status, COALESCE(mn, 0) AS min_blocks FROM (
SELECT p.scenario_id, p.point, p.off, (SELECT MIN(COALESCE(n, 0)) FROM st s CROSS JOIN (SELECT UNNEST(p.need) AS lvl) k LEFT JOIN (SELECT zone_id, is_weekend, is_peak, multiplier_x AS lvl, COUNT(*) AS n FROM train GROUP BY ALL) c USING (zone_id, is_weekend, is_peak, lvl) WHERE p.cs = 'all' OR p.cs = 'zone_' || s.zone_id) AS mn
FROM (SELECT *, ABS(LN(y) - 0.5 * LN(x)) AS off, CASE WHEN ABS(LN(y) - 0.5 * LN(x)) > 1e-8 OR x > 1.1 + 1e-9 THEN NULL WHEN x IN (0.9, 1.0, 1.1) THEN [x] ELSE [1.0::DOUBLE, 1.1::DOUBLE] END AS need FROM pts) p)""",
    req="SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, POW({c}::DOUBLE, {0.5 if n != 'off_line' else 1}))" for n, s, a, b, c, d, k in _LINE_REQ) + ") r(scenario_id, target_context_set, multiplier_x0, multiplier_y0, multiplier_x1, multiplier_y1)",
    pts=_SUPPORT["pts"], st=_SUPPORT["st"]), {"scenario_id": "", "point": "", "support_status": "", "min_blocks": "i"}))
def g03(spark, sf):
    priced = on_a_line(train(spark, sf)).withColumn("multiplier_y", F.sqrt("multiplier_x"))
    return shown(scenario.line_support(priced, feature_blocks(spark, sf), requests(spark, _LINE_REQ), MIN_BLOCKS))


_BASED = f"SELECT zone_id, n_sessions::DOUBLE AS w, {_dot('fit', 2, 1, _WIDTH)} AS bx, {_dot('fit', 2, 2, _WIDTH)} AS by_ FROM blocks"
_TH = {f"{y}{t}": coefficient("fit", k + 1, j + 1, _WIDTH) for j, y in enumerate("xy") for k, t in enumerate("xy")}


def _eff(y: str, i: int) -> str:
    return f"({_TH[y + 'x']} * LN(multiplier_x{i}) + {_TH[y + 'y']} * LN(multiplier_y{i}))"


_SUMS = "SELECT r.*, SUM(w * bx) / SUM(w) AS mx, SUM(w * by_) / SUM(w) AS my, MIN(bx) AS lox, MAX(bx) AS hix, MIN(by_) AS loy, MAX(by_) AS hiy, MIN(bx + by_) AS los, MAX(bx + by_) AS his FROM req r JOIN based b ON r.target_context_set = 'all' OR r.target_context_set = 'zone_' || b.zone_id GROUP BY ALL"
_PROBS = "SELECT *, " + ", ".join(f"mx + ex{i} AS p_x{i}, my + ey{i} AS p_y{i}, 1 - mx - my - ex{i} - ey{i} AS p_none{i}" for i in (0, 1)) + ", " + " AND ".join(f"lox + ex{i} >= 0 AND hix + ex{i} <= 1 AND loy + ey{i} >= 0 AND hiy + ey{i} <= 1 AND los + ex{i} + ey{i} >= 0 AND his + ex{i} + ey{i} <= 1" for i in (0, 1)) + f" AS probability_valid FROM (SELECT *, {', '.join(f'{_eff(y, i)} AS e{y}{i}' for y in 'xy' for i in (0, 1))} FROM sums)"
_METRICS = []
for _s in ("x", "y", "none"):
    _service = _s.upper()
    for _p, _a, _b in (("baseline", f"p_{_s}0", f"p_{_s}0 * n"), ("target", f"p_{_s}1", f"p_{_s}1 * n"), ("delta", f"100 * (p_{_s}1 - p_{_s}0)", f"(p_{_s}1 - p_{_s}0) * n")):
        _METRICS.append((f"probability_{_p}_{_s}", _service, _p, _a, "percentage_points" if _p == "delta" else "fraction"))
        if _s == "none":
            _METRICS.append((f"expected_non_booking_sessions_{_p}", _service, _p, _b, "non_booking_sessions"))
        else:
            _METRICS.append((f"expected_requests_{_p}_{_s}", _service, _p, _b, "requests"))
for _p, _b in (("baseline", "(p_x0 + p_y0) * n"), ("target", "(p_x1 + p_y1) * n"), ("delta", "(p_x1 + p_y1 - p_x0 - p_y0) * n")):
    _METRICS.append((f"expected_requests_{_p}_total", "TOTAL", _p, _b, "requests"))
_METRIC_SQL = " UNION ALL ".join(f"SELECT scenario_id, '{m}' AS metric_id, '{s}' AS service, '{p}' AS period, {e.replace('* n', '* n_sessions')} AS estimate, '{u}' AS unit, probability_valid FROM probs" for m, s, p, e, u in _METRICS)
_SCENARIO = {**_ADJUSTED, "req": _REQ, "based": _BASED, "sums": _SUMS, "probs": _PROBS}


@query("G04_scenario_metrics", sql_shown(on_blocks("SELECT * REPLACE (CASE WHEN probability_valid THEN estimate END AS estimate) FROM mm", **_SCENARIO, mm=_METRIC_SQL), {"scenario_id": "", "metric_id": "", "service": "", "period": "", "estimate": "r4", "unit": "", "probability_valid": ""}))
def g04(spark, sf):
    _, _, model = fitted(spark, sf)
    return shown(scenario.scenario_metrics(model, encoded(spark, sf), requests(spark)), 4)


@query("G05_elasticity", sql_shown(on_blocks(" UNION ALL ".join(f"SELECT scenario_id, '{y.upper()}' AS outcome, '{t.upper()}' AS treatment, {_TH[y + t]} AS theta, p_{y}0 AS baseline_share, CASE WHEN p_{y}0 >= 0.3 THEN {_TH[y + t]} / p_{y}0 END AS elasticity FROM probs" for y in "xy" for t in "xy"), **_SCENARIO), {"scenario_id": "", "outcome": "", "treatment": "", "theta": "r", "baseline_share": "r", "elasticity": "r"}))
def g05(spark, sf):
    _, _, model = fitted(spark, sf)
    return shown(scenario.elasticity(model, encoded(spark, sf), requests(spark), floor=0.3))


# Resampled days may miss a weekday, which leaves its level undefined; these controls do not.
SLIM = [*choice.BASE_FEATURES, *[f"zone_{z}" for z in ZONES[1:]]]
_SLIM_Z = ["1", *choice.BASE_FEATURES, *[f"(zone_id = {z})::INT" for z in ZONES[1:]]]
_SLIM_WIDTH = len(_SLIM_Z) + 2
_SLIM_BOOT = {**mult(20), **ols("sampled", [*T, *_SLIM_Z], Y, "bfit", "draw_id", "times")}
_ZLIST = "[" + ", ".join(f"({z})::DOUBLE" for z in _SLIM_Z) + "]"
_DRAW_TH = {f"{y}{t}": f"m[{k + 1}][{_SLIM_WIDTH + j + 1}]" for j, y in enumerate("xy") for k, t in enumerate("xy")}
_DRAW_BASED = f"SELECT draw_id, zone_id, w, {', '.join(f'{v} AS t{a}' for a, v in _DRAW_TH.items())}, list_dot_product(list_transform(m[3:{_SLIM_WIDTH}], lambda r: r[{_SLIM_WIDTH + 1}]), zl) AS bx, list_dot_product(list_transform(m[3:{_SLIM_WIDTH}], lambda r: r[{_SLIM_WIDTH + 2}]), zl) AS by_ FROM (SELECT zone_id, n_sessions::DOUBLE AS w, {_ZLIST} AS zl FROM blocks) CROSS JOIN (SELECT * FROM bfit WHERE k = {_SLIM_WIDTH})"
_DRAW_SUMS = _SUMS.replace("SELECT r.*,", "SELECT r.*, draw_id, txx, txy, tyx, tyy,")
_DRAW_PROBS = _PROBS.replace(_eff("x", 0), "(txx * LN(multiplier_x0) + txy * LN(multiplier_y0))").replace(_eff("x", 1), "(txx * LN(multiplier_x1) + txy * LN(multiplier_y1))").replace(_eff("y", 0), "(tyx * LN(multiplier_x0) + tyy * LN(multiplier_y0))").replace(_eff("y", 1), "(tyx * LN(multiplier_x1) + tyy * LN(multiplier_y1))")


@query("G06_bootstrap_scenario", sql_shown(on_blocks("""SELECT scenario_id, metric_id, valid_draws, invalid_draws, 1 - valid_draws / 20.0 AS failure_fraction, CASE WHEN invalid_draws = 0 AND valid_draws >= 10 THEN 'ok' ELSE 'interval_unstable' END AS interval_status, CASE WHEN invalid_draws = 0 AND valid_draws >= 10 THEN lower END AS lower, CASE WHEN invalid_draws = 0 AND valid_draws >= 10 THEN upper END AS upper
FROM (SELECT scenario_id, metric_id, COUNT(*) FILTER (WHERE probability_valid) AS valid_draws, COUNT(*) FILTER (WHERE NOT probability_valid) AS invalid_draws, QUANTILE_CONT(estimate, 0.025) FILTER (WHERE probability_valid) AS lower, QUANTILE_CONT(estimate, 0.975) FILTER (WHERE probability_valid) AS upper FROM mm GROUP BY 1, 2)""", **_SLIM_BOOT, req=_REQ, based=_DRAW_BASED, sums=_DRAW_SUMS, probs=_DRAW_PROBS, mm=_METRIC_SQL), {"scenario_id": "", "metric_id": "", "valid_draws": "i", "invalid_draws": "i", "failure_fraction": "r", "interval_status": "", "lower": "r4", "upper": "r4"}))  # fmt: skip
def g06(spark, sf):
    draws = resample.day_bootstrap(train(spark, sf), SLIM, 20)
    return shown(scenario.bootstrap_scenario(encoded(spark, sf), SLIM, draws, requests(spark), 20, minimum=10), 4)


def _gates(spark, sf, model):
    support = scenario.joint_support(train(spark, sf), feature_blocks(spark, sf), requests(spark), MIN_BLOCKS)
    return scenario.scenario_gates(model, encoded(spark, sf), requests(spark), support)


_WIDE = "SELECT scenario_id, MAX(support_status) FILTER (WHERE point = 'baseline') AS baseline_support, MAX(support_status) FILTER (WHERE point = 'target') AS target_support FROM sup GROUP BY 1"
_STATUS = "CASE WHEN 'out_of_support' IN (baseline_support, target_support) THEN 'out_of_support' WHEN baseline_support <> 'ok' AND target_support <> 'ok' THEN target_support WHEN NOT probability_valid THEN 'invalid_probability' WHEN target_support <> 'ok' THEN target_support WHEN baseline_support <> 'ok' THEN baseline_support ELSE 'interval_unstable' END"


@query("G07_scenario_status", on_blocks(f"SELECT scenario_id, baseline_support, target_support, probability_valid, {_STATUS} AS status FROM probs JOIN wide USING (scenario_id)", **{**_SUPPORT, **_SCENARIO}, wide=_WIDE))
def g07(spark, sf):
    _, _, model = fitted(spark, sf)
    gates = _gates(spark, sf, model)
    status = scenario.scenario_status(F.col("identified"), F.col("probability_valid"), F.col("baseline_support"), F.col("target_support"), F.lit("interval_unavailable"))
    return gates.select("scenario_id", "baseline_support", "target_support", "probability_valid", status.alias("status"))


@query("G07_forecast", sql_shown(on_blocks(f"""SELECT scenario_id, metric_id, CASE WHEN stopped OR point <> 'ok' THEN NULL ELSE estimate END AS estimate, CASE WHEN stopped THEN st ELSE point END AS status, st AS scenario_status FROM (
SELECT *, st IN ('out_of_support', 'invalid_probability') OR (baseline_support <> 'ok' AND target_support <> 'ok') AS stopped, CASE period WHEN 'baseline' THEN baseline_support WHEN 'target' THEN target_support ELSE CASE WHEN target_support <> 'ok' THEN target_support ELSE baseline_support END END AS point
FROM (SELECT mm.*, baseline_support, target_support, {_STATUS} AS st FROM mm JOIN wide USING (scenario_id)))""", **{**_SUPPORT, **_SCENARIO}, wide=_WIDE, mm=_METRIC_SQL), {"scenario_id": "", "metric_id": "", "estimate": "r4", "status": "", "scenario_status": ""}))  # fmt: skip
def g07_forecast(spark, sf):
    _, _, model = fitted(spark, sf)
    metrics = scenario.scenario_metrics(model, encoded(spark, sf), requests(spark))
    draws = resample.day_bootstrap(train(spark, sf), SLIM, 20)
    intervals = scenario.bootstrap_scenario(encoded(spark, sf), SLIM, draws, requests(spark), 20)
    out = scenario.forecast(metrics, _gates(spark, sf, model), intervals)
    return shown(out.select("scenario_id", "metric_id", "estimate", "status", "scenario_status"), 4)


# Standard errors of every metric: squares of each training row's influence on it, at the mean controls of its set.
_ANALYTIC = {
    "cm": f"SELECT r.scenario_id, multiplier_x0, multiplier_y0, multiplier_x1, multiplier_y1, r.n_sessions AS asked, [{', '.join(f'SUM(b.n_sessions::DOUBLE * {z}) / SUM(b.n_sessions::DOUBLE)' for z in Z)}] AS c FROM req r JOIN blocks b ON r.target_context_set = 'all' OR r.target_context_set = 'zone_' || b.zone_id GROUP BY 1, 2, 3, 4, 5, 6",
    "infl": "SELECT scenario_id, asked AS n_sessions, " + ", ".join(f"(list_dot_product(load[3:{_WIDTH}], c) + load[1] * LN(multiplier_x{i}) + load[2] * LN(multiplier_y{i})) * e_{y} / (1 - lev) AS p_{y}{i}" for y in "xy" for i in (0, 1)) + " FROM scored, cm",
    "gr": "SELECT *, " + ", ".join(f"-p_x{i} - p_y{i} AS p_none{i}" for i in (0, 1)) + " FROM infl",
    "se": " UNION ALL ".join(f"SELECT scenario_id, '{m}' AS metric_id, SQRT(SUM(POW({e.replace('* n', '* n_sessions')}, 2))) AS se FROM gr GROUP BY 1" for m, _, _, e, _ in _METRICS),
    "tq_in": f"SELECT 1 AS id, 0.975::DOUBLE AS p, (COUNT(*) - {_WIDTH})::DOUBLE AS df FROM train",
    **_TQ,
}
_SURE = _STATUS.replace("'interval_unstable'", "'ok'")


@query("G07_analytic_forecast", sql_shown(on_blocks(f"""SELECT scenario_id, metric_id, CASE WHEN seen THEN estimate END AS estimate, CASE WHEN stopped THEN st ELSE point END AS status, CASE WHEN seen THEN 'ok' ELSE 'interval_unavailable' END AS interval_status,
CASE WHEN seen THEN estimate - hi * se END AS lower, CASE WHEN seen THEN estimate + hi * se END AS upper, st AS scenario_status FROM (SELECT *, NOT stopped AND point = 'ok' AS seen FROM (
SELECT *, st IN ('out_of_support', 'invalid_probability') OR (baseline_support <> 'ok' AND target_support <> 'ok') AS stopped, CASE period WHEN 'baseline' THEN baseline_support WHEN 'target' THEN target_support ELSE CASE WHEN target_support <> 'ok' THEN target_support ELSE baseline_support END END AS point
FROM (SELECT mm.*, baseline_support, target_support, {_SURE} AS st FROM mm JOIN wide USING (scenario_id)))) JOIN se USING (scenario_id, metric_id), (SELECT hi FROM tq WHERE step = 48)""", **{**_SCORE_CTES, **_SUPPORT, **_SCENARIO}, wide=_WIDE, mm=_METRIC_SQL, **_ANALYTIC), {"scenario_id": "", "metric_id": "", "estimate": "r4", "status": "", "interval_status": "", "lower": "r4", "upper": "r4", "scenario_status": ""}))  # fmt: skip
def g07_analytic(spark, sf):
    df, gram, model = fitted(spark, sf)
    metrics = scenario.scenario_metrics(model, encoded(spark, sf), requests(spark))
    intervals = analytic.scenario_intervals(model, inference.hc3_covariance(df, model, gram), encoded(spark, sf), requests(spark))
    out = scenario.forecast(metrics, _gates(spark, sf, model), intervals)
    return shown(out.select("scenario_id", "metric_id", "estimate", "status", "interval_status", "lower", "upper", "scenario_status"), 4)


_ELIG = f"SELECT scenario_id, zone_id, is_weekend, is_peak, MIN(n) AS min_blocks, COUNT(*) FILTER (WHERE cx IS NULL OR cy IS NULL OR n < {MIN_BLOCKS}) AS failing_corners, COUNT(*) FILTER (WHERE cx IS NULL OR cy IS NULL OR n < {MIN_BLOCKS}) = 0 AS eligible FROM tab GROUP BY 1, 2, 3, 4"


@query("G08_eligible_strata", sql_shown(on_blocks(f"SELECT * FROM ({_ELIG})", **{**_SUPPORT, "st": "SELECT DISTINCT zone_id, is_weekend, is_peak FROM train"}), {"scenario_id": "", "zone_id": "i", "is_weekend": "i", "is_peak": "i", "min_blocks": "i", "failing_corners": "i", "eligible": ""}))
def g08(spark, sf):
    return shown(scenario.eligible_strata(train(spark, sf), requests(spark), MIN_BLOCKS))


@query("G09_scope_contexts", sql_shown(on_blocks("""SELECT q.scenario_id, b.is_weekend, b.is_peak, COUNT(*) AS all_blocks, SUM(n_sessions) AS all_sessions, COUNT(*) FILTER (WHERE eligible) AS retained_blocks, COALESCE(SUM(n_sessions) FILTER (WHERE eligible), 0) AS retained_sessions,
COUNT(*) FILTER (WHERE NOT COALESCE(eligible, FALSE)) AS excluded_blocks, COUNT(*) FILTER (WHERE eligible IS NULL) AS unseen_blocks FROM blocks b CROSS JOIN (SELECT DISTINCT scenario_id FROM elig) q LEFT JOIN elig e ON e.scenario_id = q.scenario_id AND e.zone_id = b.zone_id AND e.is_weekend = b.is_weekend AND e.is_peak = b.is_peak GROUP BY 1, 2, 3""", **{**_SUPPORT, "st": "SELECT DISTINCT zone_id, is_weekend, is_peak FROM train"}, elig=_ELIG), {"scenario_id": "", **dict.fromkeys(("is_weekend", "is_peak", "all_blocks", "all_sessions", "retained_blocks", "retained_sessions", "excluded_blocks", "unseen_blocks"), "i")}))
def g09(spark, sf):
    eligible = scenario.eligible_strata(train(spark, sf), requests(spark), MIN_BLOCKS)
    return shown(scenario.scope_contexts(feature_blocks(spark, sf), eligible))


# --- demand plans -------------------------------------------------------------------------

PLAN = {"scenario_id": "x_minus_10", "multiplier_x0": 1.0, "multiplier_y0": 1.0, "multiplier_x1": 0.9, "multiplier_y1": 1.0}
_LOG = "LN(0.9::DOUBLE)"
_PLAN_BASE = f"SELECT zone_id, CAST(day_id AS TIMESTAMP) + hr * INTERVAL '1' HOUR AS block_start, n_sessions, {_dot('fit', 2, 1, _WIDTH)} AS bx, {_dot('fit', 2, 2, _WIDTH)} AS by_ FROM blocks"
_PLAN_SQL = " UNION ALL ".join(
    f"SELECT zone_id, block_start, block_start + INTERVAL '4' HOUR AS block_end, 4.0::DOUBLE AS block_hours, n_sessions AS quote_sessions, '{y.upper()}' AS service_id, 'ok' AS status, ({b} + {_TH[y + 'x']} * {_LOG}) * n_sessions AS expected_bookings, {b} * n_sessions AS baseline_expected_bookings, ({b} + {_TH[y + 'x']} * {_LOG}) * n_sessions / 4 AS request_rate, {b} * n_sessions / 4 AS baseline_request_rate FROM pb"
    for y, b in (("x", "bx"), ("y", "by_"))
)
_PLAN_CTES = {**_ADJUSTED, "pb": _PLAN_BASE, "plan": _PLAN_SQL}
_PLAN_KINDS = {"zone_id": "i", "block_start": "t", "block_end": "t", "block_hours": "r", "quote_sessions": "i", "service_id": "", "status": "", "expected_bookings": "r5", "baseline_expected_bookings": "r5", "request_rate": "r5", "baseline_request_rate": "r5"}


def plan_blocks(spark, sf) -> DataFrame:
    start = F.col("slot_start_local")
    return encoded(spark, sf).withColumns({"block_start": start, "block_end": F.timestamp_add("HOUR", F.lit(4), start)})


def _open_gates(spark, model, sf):
    """Gates whose support floor is one block, so that the plan is usable."""
    support = scenario.joint_support(train(spark, sf), feature_blocks(spark, sf), requests(spark), 0)
    return scenario.scenario_gates(model, encoded(spark, sf), requests(spark), support)


def build_plan(spark, sf):
    _, _, model = fitted(spark, sf)
    return model, demand.demand_plan(model, plan_blocks(spark, sf), _open_gates(spark, model, sf), PLAN)


@query("H01_demand_plan", sql_shown(on_blocks("SELECT * FROM plan", **_PLAN_CTES), _PLAN_KINDS))
def h01(spark, sf):
    return shown(build_plan(spark, sf)[1], 5)


_PLAN_GATE = "CASE WHEN NOT probability_valid THEN 'invalid_probability' WHEN target_support <> 'ok' THEN target_support WHEN baseline_support <> 'ok' THEN baseline_support ELSE 'ok' END"
_PLANS = " UNION ALL ".join(
    f"SELECT scenario_id, zone_id, block_start, block_start + INTERVAL '4' HOUR AS block_end, 4.0::DOUBLE AS block_hours, pb.n_sessions AS quote_sessions, '{y.upper()}' AS service_id, {_PLAN_GATE} AS status, ({b} + e{y}1) * pb.n_sessions AS after, ({b} + e{y}0) * pb.n_sessions AS before FROM pb JOIN probs q ON q.target_context_set = 'all' OR q.target_context_set = 'zone_' || pb.zone_id JOIN wide USING (scenario_id)"
    for y, b in (("x", "bx"), ("y", "by_"))
)


@query("H01_demand_plans", sql_shown(on_blocks("SELECT * EXCLUDE (after, before), CASE WHEN status = 'ok' THEN after END AS expected_bookings, CASE WHEN status = 'ok' THEN before END AS baseline_expected_bookings, CASE WHEN status = 'ok' THEN after / 4 END AS request_rate, CASE WHEN status = 'ok' THEN before / 4 END AS baseline_request_rate FROM plans", **{**_SUPPORT, **_SCENARIO}, wide=_WIDE, pb=_PLAN_BASE, plans=_PLANS), {"scenario_id": "", **_PLAN_KINDS}))
def h01_plans(spark, sf):
    _, _, model = fitted(spark, sf)
    return shown(demand.demand_plans(model, plan_blocks(spark, sf), _gates(spark, sf, model), requests(spark)), 5)


@query("H01_plan_summary", sql_shown(on_blocks("SELECT SUM(quote_sessions) FILTER (WHERE service_id = 'X') AS quote_sessions, SUM(baseline_expected_bookings) AS baseline_expected_bookings, SUM(expected_bookings) AS expected_bookings, SUM(quote_sessions) FILTER (WHERE service_id = 'X') - SUM(expected_bookings) AS expected_outside_choices FROM plan", **_PLAN_CTES), {"quote_sessions": "i", "baseline_expected_bookings": "r4", "expected_bookings": "r4", "expected_outside_choices": "r4"}))
def h01_summary(spark, sf):
    return shown(demand.plan_summary(build_plan(spark, sf)[1]), 4)


_TILE = "SELECT zone_id, CAST(day_id AS TIMESTAMP) + hr * INTERVAL '1' HOUR AS block_start, CAST(day_id AS TIMESTAMP) + (hr + 4) * INTERVAL '1' HOUR AS block_end FROM blocks WHERE NOT (zone_id = 2 AND day_id = DATE '2024-01-11' AND hr = 12)"


@query("H02_tile_violations", sql_shown(on_blocks("SELECT *, starts_on_horizon AND ends_on_horizon AND broken_joints = 0 AS tiles FROM (SELECT zone_id, COUNT(*) AS n_blocks, MIN(block_start) = TIMESTAMP '2024-01-10 00:00:00' AS starts_on_horizon, MAX(block_end) = TIMESTAMP '2024-01-13 00:00:00' AS ends_on_horizon, COUNT(*) FILTER (WHERE nx <> block_end) AS broken_joints FROM (SELECT *, LEAD(block_start) OVER (PARTITION BY zone_id ORDER BY block_start) AS nx FROM tl WHERE block_start < TIMESTAMP '2024-01-13 00:00:00' AND block_end > TIMESTAMP '2024-01-10 00:00:00') GROUP BY 1)", tl=_TILE), {"zone_id": "i", "n_blocks": "i", "starts_on_horizon": "", "ends_on_horizon": "", "broken_joints": "i", "tiles": ""}))
def h02(spark, sf):
    kept = plan_blocks(spark, sf).filter("not (zone_id = 2 and day_id = date'2024-01-11' and hr = 12)")
    return shown(demand.tile_violations(kept, ntz("2024-01-10 00:00:00"), ntz("2024-01-13 00:00:00")))


def roster(spark, sf) -> DataFrame:
    """A vehicle roster from customers, with some broken rows."""
    key = F.col("c_custkey")
    day = ntz("2024-01-10 00:00:00")
    return bindings.table(spark, sf, "customer").select(
        F.concat(F.lit("v"), (key - F.when(key % 101 == 0, 1).otherwise(0)).cast("string")).alias("vehicle_id"),
        F.concat(F.lit("d"), key.cast("string")).alias("driver_id"),
        F.when(key % 89 != 0, F.concat(F.lit("s"), key.cast("string"))).alias("shift_id"),
        F.col("c_nationkey").alias("zone_id"),
        F.when(key % 7 == 0, F.array(F.lit("X"), F.lit("X"))).when(key % 5 == 0, F.array(F.lit("X"), F.lit("Z"))).otherwise(F.array(F.lit("X"), F.lit("Y"))).alias("eligible_services"),
        (F.col("c_acctbal") / 10000).alias("soc"),
        F.when(key % 3 == 0, "offline").when(key % 53 == 0, "busy").otherwise("idle").alias("state"),
        F.timestamp_add("HOUR", (key % 5 - 3).cast("int"), day).alias("shift_start"),
        F.timestamp_add("HOUR", (key % 11).cast("int"), day).alias("shift_end"),
    )


_ROSTER = """SELECT 'v' || (c_custkey - CASE WHEN c_custkey % 101 = 0 THEN 1 ELSE 0 END) AS vehicle_id, 'd' || c_custkey AS driver_id, CASE WHEN c_custkey % 89 <> 0 THEN 's' || c_custkey END AS shift_id, c_nationkey AS zone_id,
c_custkey % 7 = 0 OR c_custkey % 5 = 0 AS bad_services, c_acctbal / 10000 AS soc, CASE WHEN c_custkey % 3 = 0 THEN 'offline' WHEN c_custkey % 53 = 0 THEN 'busy' ELSE 'idle' END AS state, c_custkey % 5 - 3 AS s0, c_custkey % 11 AS s1 FROM customer"""


@query("H03_roster_violations", on_blocks("""SELECT 'blank_id' AS rule, COUNT(*) FILTER (WHERE shift_id IS NULL) AS violations FROM ro UNION ALL SELECT 'unknown_zone', COUNT(*) FILTER (WHERE zone_id > 20) FROM ro UNION ALL SELECT 'bad_services', COUNT(*) FILTER (WHERE bad_services) FROM ro
UNION ALL SELECT 'bad_charge', COUNT(*) FILTER (WHERE soc < 0 OR soc > 1) FROM ro UNION ALL SELECT 'empty_shift', COUNT(*) FILTER (WHERE s1 <= s0) FROM ro UNION ALL SELECT 'bad_state', COUNT(*) FILTER (WHERE state = 'busy') FROM ro UNION ALL SELECT 'idle_out_of_shift', COUNT(*) FILTER (WHERE state = 'idle' AND NOT (s0 <= 0 AND 0 < s1)) FROM ro
UNION ALL SELECT 'repeated_vehicle_id', (SELECT COUNT(*) FROM (SELECT 1 FROM ro GROUP BY vehicle_id HAVING COUNT(*) > 1)) UNION ALL SELECT 'repeated_driver_id', 0 UNION ALL SELECT 'repeated_shift_id', (SELECT COUNT(*) FROM (SELECT 1 FROM ro GROUP BY shift_id HAVING COUNT(*) > 1))""", ro=_ROSTER))
def h03(spark, sf):
    return demand.roster_violations(roster(spark, sf), list(range(21)), ntz("2024-01-10 00:00:00"))


@query("H04_plan_reconciliation", on_blocks("""SELECT 'rate_times_hours' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'baseline_rate_times_hours', COUNT(*) FILTER (WHERE zone_id = 3 AND baseline_request_rate <> 0) FROM plan UNION ALL SELECT 'negative_bookings', COUNT(*) FILTER (WHERE expected_bookings < 0 OR baseline_expected_bookings < 0) FROM plan
UNION ALL SELECT 'incomplete_block', COUNT(*) FROM pb WHERE zone_id = 4 UNION ALL SELECT 'sessions_differ', 0 UNION ALL SELECT 'bookings_exceed_sessions', 0""", **_PLAN_CTES))
def h04(spark, sf):
    plan = build_plan(spark, sf)[1].filter("not (zone_id = 4 and service_id = 'Y')")
    broken = plan.withColumn("baseline_request_rate", F.col("baseline_request_rate") * F.when(F.col("zone_id") == 3, 2).otherwise(1))
    return demand.plan_reconciliation(broken)


@query("H05_truth_plan", sql_shown(on_blocks("SELECT zone_id, block_start, service_id, b * quote_sessions AS baseline_expected_bookings, (b + e) * quote_sessions AS expected_bookings, (b + e) * quote_sessions / 4 AS request_rate FROM (SELECT *, CASE service_id WHEN 'X' THEN 0.4 + zone_id * 0.01 ELSE 0.2 - zone_id * 0.01 END::DOUBLE AS b, CASE service_id WHEN 'X' THEN -0.6 ELSE 0.12 END::DOUBLE * LN(0.9::DOUBLE) AS e FROM plan)", **_PLAN_CTES), {"zone_id": "i", "block_start": "t", "service_id": "", "baseline_expected_bookings": "r", "expected_bookings": "r", "request_rate": "r"}))
def h05(spark, sf):
    truth = plan_blocks(spark, sf).select("zone_id", "block_start", (0.4 + F.col("zone_id") * 0.01).alias("b_x"), (0.2 - F.col("zone_id") * 0.01).alias("b_y"))
    plan = demand.truth_plan(build_plan(spark, sf)[1], truth, [[-0.6, 0.15], [0.12, -0.5]], PLAN)
    return shown(plan.select("zone_id", "block_start", "service_id", "baseline_expected_bookings", "expected_bookings", "request_rate"))
