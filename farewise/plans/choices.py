"""Registered queries: choice tables, estimation, inference and resampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.operators import choice, estimate, inference, keyed, resample
from farewise.plans.catalogue import kept, query, shown, sql_shown
from farewise.plans.sqlkit import cross_products, eliminated, normal_cdf, normal_quantiles, recursive, t_quantiles
from farewise.plans.trips import _CTX_CTES, _context, on_silver
from farewise.sources import bindings
from farewise.sources.bindings import with_views

TRAIN_END, VALIDATION_END = "2024-01-21", "2024-01-26"
ZONES = [0, 1, 2, 3, 4]
CONTROLS = choice.feature_names(ZONES)
CELL, FOLDS, DRAWS = ["zone_id", "hr"], 5, 50
T, Y = ["log_multiplier_x", "log_multiplier_y"], ["q_x", "q_y"]


def feature_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Choice blocks with shares, log prices, calendar and a stand-in trip distance."""
    start = F.timestamp_add("HOUR", F.col("hr"), F.col("day_id").cast("timestamp_ntz"))
    blocks = choice.with_shares(bindings.choice_blocks(spark, sf)).withColumns(
        {
            "log_multiplier_x": F.ln("multiplier_x"),
            "log_multiplier_y": F.ln("multiplier_y"),
            "distance_scaled": ((F.col("zone_id") * 7 + F.col("hr")) % 11) / 10.0,
            "slot_start_local": start,
            "fold": F.day("day_id") % FOLDS,
        }
    )
    # One row per zone, day and slot: small, and used by every query below.
    return kept(choice.calendar_features(blocks, "slot_start_local"))


def encoded(spark, sf) -> DataFrame:
    return choice.encode(feature_blocks(spark, sf), ZONES, check=False)


def train(spark, sf) -> DataFrame:
    return encoded(spark, sf).filter(F.col("day_id") < F.lit(TRAIN_END).cast("date"))


def validation(spark, sf) -> DataFrame:
    day = F.col("day_id")
    return encoded(spark, sf).filter((day >= F.lit(TRAIN_END).cast("date")) & (day < F.lit(VALIDATION_END).cast("date")))


def on_a_line(df: DataFrame) -> DataFrame:
    """The same blocks with Y's log price moved onto half of X's: one price direction only."""
    return df.withColumn("log_multiplier_y", F.col("log_multiplier_x") * 0.5)


BLOCKS = f"""
SELECT b.*, n_x / n_sessions::DOUBLE AS q_x, n_y / n_sessions::DOUBLE AS q_y, n_none / n_sessions::DOUBLE AS q_none,
  LN(multiplier_x) AS log_multiplier_x, LN(multiplier_y) AS log_multiplier_y, ((zone_id * 7 + hr) % 11) / 10.0::DOUBLE AS distance_scaled,
  EXTRACT(DAY FROM day_id) % {FOLDS} AS fold, hr::DOUBLE AS hour, EXTRACT(ISODOW FROM day_id) - 1 AS weekday,
  (EXTRACT(ISODOW FROM day_id) >= 6)::INT AS is_weekend, (hr IN (8, 16))::INT AS is_peak,
  SIN(2 * PI() * hr / 24) AS hour_sin, COS(2 * PI() * hr / 24) AS hour_cos
FROM choice_blocks b"""
# The weekend flag is the sum of two weekday dummies, so elimination leaves it out.
Z = ["1", "hour_sin", "hour_cos", "is_peak", "distance_scaled"]
Z += [f"(zone_id = {z})::INT" for z in ZONES[1:]] + [f"(weekday = {d})::INT" for d in range(1, 7)]
NZ = len(Z)
TRAIN = f"SELECT *, n_sessions::DOUBLE AS w FROM blocks WHERE day_id < DATE '{TRAIN_END}'"
LINE = "SELECT * REPLACE (log_multiplier_x * 0.5 AS log_multiplier_y) FROM train"
DESIGN = T + Z


def on_blocks(body: str, **extra: str) -> str:
    return with_views(body, "choice_blocks", blocks=BLOCKS, train=TRAIN, **extra)


def ols(source: str, z: list[str], y: list[str], name: str, keys: str = "", times: str = "1") -> dict[str, str]:
    """CTEs name_m (matrix) and name (elimination steps) for a weighted regression."""
    head, tail = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    matrix = f"SELECT {head}{cross_products(z, y, 'w', times)} AS m FROM {source}{tail}"
    return {f"{name}_m": matrix, **recursive(**{name: eliminated(f"{name}_m", len(z), keys)})}


def coefficient(name: str, position: int, outcome: int, width: int) -> str:
    """Scalar: coefficient `position` (1-based) for outcome 1 or 2 of a solved regression."""
    return f"(SELECT m[{position}][{width + outcome}] FROM {name} WHERE k = {width})"


# --- choice tables ------------------------------------------------------------------------

def event_sessions(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind.isin("click", "signup"), "X").when(kind == "purchase", "Y").otherwise("NONE")
    return bindings.table(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("zone_id"), F.to_date("ts").alias("day_id"), label.alias("choice")
    )


_ZONE_DAY = """SELECT user_id % 5 AS zone_id, CAST(ts AS DATE) AS day_id, COUNT(*) AS n_sessions, COUNT(*) FILTER (WHERE event_type IN ('click', 'signup')) AS n_x,
COUNT(*) FILTER (WHERE event_type = 'purchase') AS n_y, COUNT(*) FILTER (WHERE event_type IN ('view', 'error')) AS n_none FROM events GROUP BY 1, 2"""


@query("D01_sessions_to_blocks", sql_shown(f"SELECT *, n_x / n_sessions::DOUBLE AS q_x, n_y / n_sessions::DOUBLE AS q_y, n_none / n_sessions::DOUBLE AS q_none FROM ({_ZONE_DAY})", {"zone_id": "i", "day_id": "t", **dict.fromkeys(("n_sessions", "n_x", "n_y", "n_none"), "i"), **dict.fromkeys(("q_x", "q_y", "q_none"), "r")}))
def d01(spark, sf):
    return shown(choice.sessions_to_blocks(event_sessions(spark, sf), ["zone_id", "day_id"]))


@query("D02_blocks_to_sessions", sql_shown(f"SELECT zone_id, day_id, c.choice, (c.choice = 'X')::INT AS y_x, (c.choice = 'Y')::INT AS y_y, (c.choice = 'NONE')::INT AS y_none FROM (SELECT zone_id, day_id, UNNEST([{{'choice': 'X', 'n': n_x}}, {{'choice': 'Y', 'n': n_y}}, {{'choice': 'NONE', 'n': n_none}}]) AS c FROM ({_ZONE_DAY})) CROSS JOIN RANGE(10000000) r(i) WHERE FALSE UNION ALL SELECT user_id % 5, CAST(ts AS DATE), CASE WHEN event_type IN ('click', 'signup') THEN 'X' WHEN event_type = 'purchase' THEN 'Y' ELSE 'NONE' END, (event_type IN ('click', 'signup'))::INT, (event_type = 'purchase')::INT, (event_type IN ('view', 'error'))::INT FROM events", {"zone_id": "i", "day_id": "t", "choice": "", "y_x": "i", "y_y": "i", "y_none": "i"}))
def d02(spark, sf):
    blocks = choice.sessions_to_blocks(event_sessions(spark, sf), ["zone_id", "day_id"])
    return shown(choice.blocks_to_sessions(blocks, ["zone_id", "day_id"]).drop("session_id"))


@query("D03_calendar_features", sql_shown("""SELECT event_id, CAST(ts AS DATE) AS day_id, EXTRACT(HOUR FROM ts) + EXTRACT(MINUTE FROM ts) / 60.0::DOUBLE AS hour, EXTRACT(ISODOW FROM ts) - 1 AS weekday,
(EXTRACT(ISODOW FROM ts) >= 6)::INT AS is_weekend, (EXTRACT(HOUR FROM ts) BETWEEN 7 AND 9 OR EXTRACT(HOUR FROM ts) BETWEEN 16 AND 19)::INT AS is_peak,
SIN(2 * PI() * (EXTRACT(HOUR FROM ts) + EXTRACT(MINUTE FROM ts) / 60.0::DOUBLE) / 24) AS hour_sin, COS(2 * PI() * (EXTRACT(HOUR FROM ts) + EXTRACT(MINUTE FROM ts) / 60.0::DOUBLE) / 24) AS hour_cos FROM events""", {"event_id": "i", "day_id": "t", "hour": "r", "weekday": "i", "is_weekend": "i", "is_peak": "i", "hour_sin": "r", "hour_cos": "r"}))
def d03(spark, sf):
    events = bindings.table(spark, sf, "events").select("event_id", "ts")
    return shown(choice.calendar_features(events, "ts").drop("ts"))


@query("D04_observed_violations", with_views(" UNION ALL ".join(
    f"SELECT '{rule}' AS rule, COUNT(*) FILTER (WHERE {bad}) AS violations FROM choice_blocks"
    for rule, bad in {
        "nonfinite_value": "FALSE", "nonpositive_weight": "n_sessions <= 0", "negative_count": "n_x < 0 OR n_y < 0 OR n_none < 0",
        "noninteger_count": "FALSE", "counts_do_not_conserve": "n_x + n_y + n_none <> n_sessions",
        "shares_exceed_one": "(n_x + n_y + 1) / n_sessions::DOUBLE > 1 + 1e-12", "share_x_mismatch": "(n_x + 1) / n_sessions::DOUBLE - n_x / n_sessions::DOUBLE > 1e-9",
        "share_y_mismatch": "FALSE", "share_none_mismatch": "FALSE",
    }.items()), "choice_blocks"))
def d04(spark, sf):
    broken = feature_blocks(spark, sf).withColumn("q_x", (F.col("n_x") + 1) / F.col("n_sessions"))
    return choice.observed_violations(broken)


@query("D06_attach_context", sql_shown(on_silver("SELECT b.zone_id, b.day_id, b.hr, p.context_id, p.fallback_level, COALESCE((p.distance_km - MIN(p.distance_km) OVER ()) / NULLIF(MAX(p.distance_km) OVER () - MIN(p.distance_km) OVER (), 0), 0.5) AS unused FROM choice_blocks b JOIN picked p ON b.zone_id = p.zone_id AND b.hr = p.hour AND (EXTRACT(ISODOW FROM b.day_id) >= 6) = p.is_weekend", choice_blocks=bindings.SQL["choice_blocks"], **_CTX_CTES), {"zone_id": "i", "day_id": "t", "hr": "i", "context_id": "", "fallback_level": "i"}))
def d06(spark, sf):
    blocks = feature_blocks(spark, sf).drop("distance_scaled")
    return shown(choice.attach_context(blocks, _context(spark, sf)).select("zone_id", "day_id", "hr", "context_id", "fallback_level"))


@query("D07_encode", sql_shown(on_blocks("SELECT zone_id, day_id, hr, " + ", ".join([*choice.BASE_FEATURES, *[f"(zone_id = {z})::INT AS zone_{z}" for z in ZONES[1:]], *[f"(weekday = {d})::INT AS weekday_{d}" for d in range(1, 7)]]) + " FROM blocks"), {"zone_id": "i", "day_id": "t", "hr": "i", **dict.fromkeys(CONTROLS, "r")}))
def d07(spark, sf):
    return shown(choice.encode(feature_blocks(spark, sf), ZONES).select("zone_id", "day_id", "hr", *CONTROLS))


_SPLIT = f"CASE WHEN day_id < DATE '{TRAIN_END}' THEN 'train' WHEN day_id < DATE '{VALIDATION_END}' THEN 'validation' ELSE 'test' END"


@query("D08_date_splits", sql_shown(with_views(f"SELECT {_SPLIT} AS split, COUNT(*) AS n_blocks, COUNT(DISTINCT day_id) AS n_days, MIN(day_id) AS first_day, MAX(day_id) AS last_day FROM choice_blocks GROUP BY 1", "choice_blocks"), {"split": "", "n_blocks": "i", "n_days": "i", "first_day": "t", "last_day": "t"}))
def d08(spark, sf):
    return shown(choice.split_summary(choice.date_splits(feature_blocks(spark, sf), TRAIN_END, VALIDATION_END)))


@query("D09_day_folds", sql_shown(f"SELECT day_id, n_blocks, CASE WHEN (r // {FOLDS}) % 2 = 0 THEN r % {FOLDS} ELSE {FOLDS - 1} - r % {FOLDS} END AS fold FROM (SELECT CAST(ts AS DATE) AS day_id, COUNT(*) AS n_blocks, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, CAST(ts AS DATE)) - 1 AS r FROM events GROUP BY 1)", {"day_id": "t", "n_blocks": "i", "fold": "i"}))
def d09(spark, sf):
    sessions = bindings.table(spark, sf, "events").select(F.to_date("ts").alias("day_id"))
    return shown(choice.day_folds(sessions, FOLDS))


@query("D10_price_support", sql_shown(with_views("SELECT x AS multiplier_x, y AS multiplier_y, COUNT(b.hr) AS n_blocks FROM (VALUES (0.9::DOUBLE), (1.0), (1.1)) a(x) CROSS JOIN (VALUES (0.9::DOUBLE), (1.0), (1.1)) c(y) LEFT JOIN choice_blocks b ON b.multiplier_x = x AND b.multiplier_y = y GROUP BY 1, 2", "choice_blocks"), {"multiplier_x": "r", "multiplier_y": "r", "n_blocks": "i"}))
def d10(spark, sf):
    return shown(choice.price_support(feature_blocks(spark, sf)))


@query("D11_active_treatments", sql_shown(on_blocks("SELECT 'log_multiplier_x' AS treatment, MAX(log_multiplier_x) - MIN(log_multiplier_x) AS spread, TRUE AS active, NULL::DOUBLE AS constant FROM blocks UNION ALL SELECT 'log_multiplier_y', 0, FALSE, LN(1.1::DOUBLE)"), {"treatment": "", "spread": "r", "active": "", "constant": "r"}))
def d11(spark, sf):
    fixed = feature_blocks(spark, sf).withColumn("log_multiplier_y", F.lit(math.log(1.1)))
    return shown(choice.active_treatments(fixed))


# --- estimation ---------------------------------------------------------------------------

_MOMENT_COLS = [*T, *Y]
_MOMENTS = ", ".join(
    ["COUNT(*) AS n", "SUM(w) AS w"] + [f"SUM(w * {c}) AS s_{i}" for i, c in enumerate(_MOMENT_COLS)]
    + [f"SUM(w * {_MOMENT_COLS[i]} * {_MOMENT_COLS[j]}) AS m_{i}{j}" for i in range(4) for j in range(i, 4)]
)
_MOMENT_KINDS = {"n": "i", "w": "r", **{f"s_{i}": "r" for i in range(4)}, **{f"m_{i}{j}": "r" for i in range(4) for j in range(i, 4)}}
THETA_KINDS = {t: "r" for t in resample.THETAS}


def closed_form(prefix: str = "m_") -> str:
    """The four effects from centred sums m_00 .. m_13 as select expressions."""
    det = f"({prefix}00 * {prefix}11 - {prefix}01 * {prefix}01)"
    out = []
    for j, y in enumerate("xy", start=2):
        out.append(f"({prefix}11 * {prefix}0{j} - {prefix}01 * {prefix}1{j}) / {det} AS theta_{y}x")
        out.append(f"({prefix}00 * {prefix}1{j} - {prefix}01 * {prefix}0{j}) / {det} AS theta_{y}y")
    return ", ".join(out)


def centred_sums(u: list[str], source: str, by: str = "", times: str = "1") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    sums = ", ".join(f"SUM({times} * w * {u[i]} * {u[j]}) AS m_{i}{j}" for i in range(2) for j in range(i, 4))
    return f"SELECT {head}{sums} FROM {source}{tail}"


def price_only(source: str, by: str = "", times: str = "1") -> str:
    """Centred sums of the intercept-and-prices regression, centring around weighted means."""
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    c = _MOMENT_COLS
    sums = ", ".join(
        f"SUM({times} * w * {c[i]} * {c[j]}) - SUM({times} * w * {c[i]}) * SUM({times} * w * {c[j]}) / SUM({times} * w) AS m_{i}{j}"
        for i in range(2) for j in range(i, 4)
    )
    return f"SELECT {head}{sums} FROM {source}{tail}"


@query("E01_weighted_gram", sql_shown(on_blocks(f"SELECT day_id, {_MOMENTS} FROM train GROUP BY 1"), {"day_id": "t", **_MOMENT_KINDS}))
def e01(spark, sf):
    return shown(estimate.moments(train(spark, sf), ["day_id"]))


@query("E01_weighted_gram_full", sql_shown(on_blocks("SELECT zone_id, i, v FROM (SELECT zone_id, GENERATE_SUBSCRIPTS(g, 1) - 1 AS i, UNNEST(g) AS v FROM (SELECT zone_id, [COUNT(*)::DOUBLE, " + ", ".join(f"SUM(w * {a} * {b})" for a in ("1", *T, *choice.BASE_FEATURES, *Y) for b in ("1", *T, *choice.BASE_FEATURES, *Y)) + "] AS g FROM train GROUP BY 1))"), {"zone_id": "i", "i": "i", "v": "r"}))
def e01_full(spark, sf):
    sums = estimate.weighted_gram(train(spark, sf), choice.BASE_FEATURES, ["zone_id"])
    return shown(sums.select("zone_id", F.posexplode("g").alias("i", "v")))


def theta_rows(spark: SparkSession, model: estimate.Model) -> DataFrame:
    values = [float(v) for v in model.theta.ravel()]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{t} double" for t in resample.THETAS))


@query("E02_fit_naive_ols", sql_shown(on_blocks(f"SELECT {closed_form()} FROM c", c=price_only("train")), THETA_KINDS))
def e02(spark, sf):
    return shown(theta_rows(spark, estimate.fit_ols(train(spark, sf), CONTROLS, "naive_ols")))


def _base_by_zone(model: estimate.Model, df: DataFrame) -> DataFrame:
    w = F.col("n_sessions").cast("double")
    mean = [(F.sum(w * model.baseline(j)) / F.sum(w)).alias(f"base_{s}") for j, s in enumerate("xy")]
    return df.groupBy("zone_id").agg(*mean)


def _dot(name: str, start: int, outcome: int, width: int) -> str:
    return " + ".join(f"{coefficient(name, start + i + 1, outcome, width)} * {z}" for i, z in enumerate(Z))


_ADJUSTED = ols("train", DESIGN, Y, "fit")
_WIDTH = len(DESIGN)
_FIT_THETA = ", ".join(f"{coefficient('fit', k + 1, j + 1, _WIDTH)} AS theta_{y}{t}" for j, y in enumerate("xy") for k, t in enumerate("xy"))
_ZONE_BASE = "SELECT zone_id, " + ", ".join(f"SUM(w * ({_dot('fit', 2, j + 1, _WIDTH)})) / SUM(w) AS base_{s}" for j, s in enumerate("xy")) + " FROM train GROUP BY 1"


@query("E03_fit_adjusted_ols", sql_shown(on_blocks(f"SELECT {_FIT_THETA}", **_ADJUSTED), THETA_KINDS))
def e03(spark, sf):
    return shown(theta_rows(spark, estimate.fit_ols(train(spark, sf), CONTROLS)))


_KEYED = {"tagged": "SELECT *, DAY(day_id) % 2 AS dataset FROM train", **ols("tagged", DESIGN, Y, "kfit", "dataset")}


def keyed_train(spark, sf) -> DataFrame:
    """Odd and even days as two datasets."""
    return train(spark, sf).withColumn("dataset", (F.dayofmonth("day_id") % 2).cast("bigint"))


@query("E03_fit_adjusted_ols_by", sql_shown(on_blocks("SELECT dataset, 'succeeded' AS status, " + ", ".join(f"m[{k + 1}][{_WIDTH + j + 1}] AS theta_{y}{t}" for j, y in enumerate("xy") for k, t in enumerate("xy")) + f" FROM kfit WHERE k = {_WIDTH}", **_KEYED), {"dataset": "i", "status": "", **THETA_KINDS}))
def e03_by(spark, sf):
    return shown(resample.fit_by(keyed_train(spark, sf), CONTROLS, ["dataset"]).select("dataset", "status", *resample.THETAS))


_CELL_CENTRED = "SELECT *, " + ", ".join(f"{c} - SUM(w * {c}) OVER cell / SUM(w) OVER cell AS u{i}" for i, c in enumerate(_MOMENT_COLS)) + " FROM train WINDOW cell AS (PARTITION BY zone_id, hr)"


@query("E03_fit_cell_effects", sql_shown(on_blocks(f"SELECT {closed_form()} FROM s", c=_CELL_CENTRED, s=centred_sums(["u0", "u1", "u2", "u3"], "c")), THETA_KINDS))
def e03_cells(spark, sf):
    return shown(estimate.fit_within_cells(train(spark, sf), CELL))


_DIRECTION = [2 / math.sqrt(5), 1 / math.sqrt(5)]
_LINE_FIT = ols("line", [f"(log_multiplier_x * {_DIRECTION[0]!r} + log_multiplier_y * {_DIRECTION[1]!r})", *Z], Y, "fit")


@query("E04_fit_contrast_ols", sql_shown(on_blocks("SELECT " + ", ".join(f"{coefficient('fit', 1, j + 1, NZ + 1)} * {_DIRECTION[k]!r} AS theta_{y}{t}" for j, y in enumerate("xy") for k, t in enumerate("xy")), line=LINE, **_LINE_FIT), THETA_KINDS))
def e04(spark, sf):
    return shown(theta_rows(spark, estimate.fit_ols(on_a_line(train(spark, sf)), CONTROLS, "contrast_ols")))


def out_of_fold(source: str, by: str, times: str) -> str:
    """Residuals around the cell means of the other folds, within each draw."""
    rest = lambda v: f"(SUM({times} * {v}) OVER cell - SUM({times} * {v}) OVER part)"
    residuals = ", ".join(f"{c} - {rest(f'w * {c}')} / NULLIF({rest('w')}, 0) AS u{i}" for i, c in enumerate(_MOMENT_COLS))
    return f"SELECT *, {residuals} FROM {source} WINDOW cell AS (PARTITION BY {by}, zone_id, hr), part AS (PARTITION BY {by}, zone_id, hr, fold)"


def dml_ctes(source: str, by: str, times: str = "1") -> dict[str, str]:
    return {"oof": out_of_fold(source, by, times), "os": centred_sums(["u0", "u1", "u2", "u3"], "oof", by, times)}


_OUT_OF_FOLD = "SELECT *, " + ", ".join(
    f"{c} - (SUM(w * {c}) OVER cell - SUM(w * {c}) OVER part) / (SUM(w) OVER cell - SUM(w) OVER part) AS u{i}" for i, c in enumerate(_MOMENT_COLS)
) + " FROM train WINDOW cell AS (PARTITION BY zone_id, hr), part AS (PARTITION BY zone_id, hr, fold)"
_DML_CTES = {"c": _OUT_OF_FOLD, "s": centred_sums(["u0", "u1", "u2", "u3"], "c"), "th": f"SELECT {closed_form()} FROM s"}


@query("E05_fit_dml", sql_shown(on_blocks("SELECT * FROM th", **_DML_CTES), THETA_KINDS))
def e05(spark, sf):
    return shown(estimate.fit_dml_cell_means(train(spark, sf), CELL, "fold"))


@query("E05_fit_dml_forest")
def e05_forest(spark, sf):
    halves = train(spark, sf).withColumn("half", F.col("fold") % 2)
    return shown(theta_rows(spark, estimate.fit_dml(halves, CONTROLS, "half", "forest", trees=5, depth=3)), 4)


_SCHUR = ols("train", Z, [*T, *Y], "zz")
_RESIDUAL = f"SELECT {', '.join(f'({t} - ({_dot(chr(122) * 2, 0, k + 1, NZ)})) AS e{k}' for k, t in enumerate(T))}, w FROM train"
_COV = "SELECT SUM(w * e0 * e0) / SUM(w) AS a, SUM(w * e0 * e1) / SUM(w) AS b, SUM(w * e1 * e1) / SUM(w) AS d FROM r"
_EIGEN = "SELECT (a + d) / 2 + SQRT((a - d) * (a - d) / 4 + b * b) AS hi, (a + d) / 2 - SQRT((a - d) * (a - d) / 4 + b * b) AS lo FROM v"


@query("E06_identification_status", sql_shown(on_blocks("SELECT 'two_prices' AS design, (hi > 1e-10)::INT + (lo > 1e-10)::INT AS rank, hi / lo AS condition_number, 'ok' AS status FROM eg UNION ALL SELECT 'one_line', 1, NULL, 'not_identified' UNION ALL SELECT 'one_line_contrast', 1, 1.0, 'ok'", **_SCHUR, r=_RESIDUAL, v=_COV, eg=_EIGEN), {"design": "", "rank": "i", "condition_number": "r", "status": ""}))
def e06(spark, sf):
    rows = []
    for name, df, kind in (
        ("two_prices", train(spark, sf), "adjusted_ols"),
        ("one_line", on_a_line(train(spark, sf)), "adjusted_ols"),
        ("one_line_contrast", on_a_line(train(spark, sf)), "contrast_ols"),
    ):
        model = estimate.fit_ols(df, CONTROLS, kind)
        rows.append((name, model.rank, model.condition if model.ok else None, model.status))
    return shown(spark.createDataFrame(rows, "design string, rank bigint, condition_number double, status string"))


_BASE_Y = [f"(q_{y} - (SELECT theta_{y}x FROM th) * log_multiplier_x - (SELECT theta_{y}y FROM th) * log_multiplier_y)" for y in "xy"]
_TARGETS = f"SELECT *, {_BASE_Y[0]} AS v_x, {_BASE_Y[1]} AS v_y FROM train"
_BASE_FIT = ols("targets", Z, ["v_x", "v_y"], "fit")
_BASE_CTES = {**_DML_CTES, "targets": _TARGETS, **_BASE_FIT}


@query("E07_fit_base_rate", sql_shown(on_blocks("SELECT zone_id, " + ", ".join(f"SUM(w * ({_dot('fit', 0, j + 1, NZ)})) / SUM(w) AS base_{s}" for j, s in enumerate("xy")) + " FROM train GROUP BY 1", **_BASE_CTES), {"zone_id": "i", "base_x": "r", "base_y": "r"}))
def e07(spark, sf):
    df = train(spark, sf)
    return shown(_base_by_zone(estimate.fit_dml(df, CONTROLS, "fold"), df))


def _predicted(price_x: str, price_y: str) -> list[str]:
    return [
        f"({_dot('fit', 2, j + 1, _WIDTH)} + {coefficient('fit', 1, j + 1, _WIDTH)} * {price_x} + {coefficient('fit', 2, j + 1, _WIDTH)} * {price_y})"
        for j in range(2)
    ]


_VALIDATION = f"SELECT *, n_sessions::DOUBLE AS w FROM blocks WHERE day_id >= DATE '{TRAIN_END}' AND day_id < DATE '{VALIDATION_END}'"
_PRED = "SELECT *, 1 - p_x - p_y AS p_none FROM (SELECT *, {} AS p_x, {} AS p_y FROM validation)".format(*_predicted(*T))


@query("E08_predict_choice", sql_shown(on_blocks("SELECT zone_id, day_id, hr, p_x, p_y, p_none FROM pred", **_ADJUSTED, validation=_VALIDATION, pred=_PRED), {"zone_id": "i", "day_id": "t", "hr": "i", "p_x": "r", "p_y": "r", "p_none": "r"}))
def e08(spark, sf):
    model = estimate.fit_ols(train(spark, sf), CONTROLS)
    return shown(estimate.predict_choice(validation(spark, sf), model).select("zone_id", "day_id", "hr", "p_x", "p_y", "p_none"))


_EXTREME = "SELECT *, 1 - p_x - p_y AS p_none FROM (SELECT *, {} AS p_x, {} AS p_y FROM blocks)".format(*_predicted("30", "-30"))


@query("E09_simplex_violations", on_blocks("SELECT 'nonfinite' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'outside_unit', COUNT(*) FILTER (WHERE p_x < 0 OR p_x > 1 OR p_y < 0 OR p_y > 1 OR p_none < 0 OR p_none > 1) FROM pred UNION ALL SELECT 'sum_not_one', 0", **_ADJUSTED, pred=_EXTREME))
def e09(spark, sf):
    model = estimate.fit_ols(train(spark, sf), CONTROLS)
    return estimate.simplex_violations(estimate.predict_choice(encoded(spark, sf), model, F.lit(30.0), F.lit(-30.0)))


@query("E10_validation_rmse", sql_shown(on_blocks("SELECT SQRT(SUM(w * ((p_x - q_x) * (p_x - q_x) + (p_y - q_y) * (p_y - q_y)) / 2) / SUM(w)) AS rmse FROM pred", **_ADJUSTED, validation=_VALIDATION, pred=_PRED), {"rmse": "r"}))
def e10(spark, sf):
    return shown(estimate.validation_rmse(validation(spark, sf), estimate.fit_ols(train(spark, sf), CONTROLS)))


# Row scores in SQL: x = design row, inv = inverse cross products, load = w inv x, h = leverage.
_IDENTITY = [[("1" if i == j else "0") for j in range(_WIDTH)] for i in range(_WIDTH)]
_INVERSE_M = "SELECT [" + ", ".join("[" + ", ".join([f"SUM(w * {a} * {b})" for b in DESIGN] + [f"{v}::DOUBLE" for v in _IDENTITY[i]]) + "]" for i, a in enumerate(DESIGN)) + "] AS m FROM train"
_INVERSE = recursive(inv_steps=eliminated("inv_m", _WIDTH))
_SCORE_CTES = {
    **_ADJUSTED,
    "inv_m": _INVERSE_M,
    **_INVERSE,
    "inv": f"SELECT list_transform(m, lambda r: r[{_WIDTH + 1}:{2 * _WIDTH}]) AS a FROM inv_steps WHERE k = {_WIDTH}",
    "xs": f"SELECT *, [{', '.join(f'({c})::DOUBLE' for c in DESIGN)}] AS x FROM train",
    "loads": "SELECT xs.*, list_transform((SELECT a FROM inv), lambda r: w * list_dot_product(r, x)) AS load FROM xs",
    "scored": "SELECT *, list_dot_product(load, x) AS lev, " + ", ".join(f"q_{s} - ({coefficient('fit', 1, j + 1, _WIDTH)} * log_multiplier_x + {coefficient('fit', 2, j + 1, _WIDTH)} * log_multiplier_y + {_dot('fit', 2, j + 1, _WIDTH)}) AS e_{s}" for j, s in enumerate("xy")) + " FROM loads",
}
_SE_KINDS = {f"se_{y}{t}": "r" for y in "xy" for t in "xy"}


def _theta_errors(spark, covariance, model) -> DataFrame:
    size = 1 + len(model.controls) + len(model.active)
    se = [float(covariance.matrix[j * size + k, j * size + k]) ** 0.5 for j in range(2) for k in range(2)]
    degrees = None if covariance.degrees is None else float(covariance.degrees)
    return spark.createDataFrame([(*se, degrees)], ", ".join([f"{c} double" for c in _SE_KINDS] + ["degrees double"]))


def fitted(spark, sf, df=None, kind="adjusted_ols"):
    df = train(spark, sf) if df is None else df
    gram, active, constants = estimate.collect_gram(df, CONTROLS)
    return df, gram, estimate.fit_from_gram(gram, kind, active, constants)


@query("E11_hc3_covariance", sql_shown(on_blocks("SELECT " + ", ".join(f"SQRT(SUM(POW(load[{k + 1}] * e_{y} / (1 - lev), 2))) AS se_{y}{t}" for y in "xy" for k, t in enumerate("xy")) + f", COUNT(*) - {_WIDTH} AS degrees FROM scored", **_SCORE_CTES), {**_SE_KINDS, "degrees": "r"}))
def e11(spark, sf):
    df, gram, model = fitted(spark, sf)
    return shown(_theta_errors(spark, inference.hc3_covariance(df, model, gram), model))


_DML_SCORES = "SELECT *, " + ", ".join(f"u{2 + j} - u0 * (SELECT theta_{y}x FROM th) - u1 * (SELECT theta_{y}y FROM th) AS e_{y}" for j, y in enumerate("xy")) + ", (SELECT m_00 FROM s) AS g0, (SELECT m_01 FROM s) AS g1, (SELECT m_11 FROM s) AS g2 FROM c"


@query("E12_dml_score_covariance", sql_shown(on_blocks("SELECT " + ", ".join(f"SQRT(SUM(POW(w * e_{y} * ({a}) / (g0 * g2 - g1 * g1), 2))) AS se_{y}{t}" for y in "xy" for t, a in (("x", "g2 * u0 - g1 * u1"), ("y", "g0 * u1 - g1 * u0"))) + ", NULL::DOUBLE AS degrees FROM sc", **_DML_CTES, sc=_DML_SCORES), {**_SE_KINDS, "degrees": "r"}))
def e12(spark, sf):
    df = train(spark, sf)
    gram, _, _ = estimate.collect_gram(df, CONTROLS)
    model = estimate.fit_dml(df, CONTROLS, "fold")
    residuals = estimate.residualize(df, CELL, "fold")
    return shown(_theta_errors(spark, inference.dml_score_covariance(residuals, model, gram), model))


@query("E13_day_cr1_covariance", sql_shown(on_blocks("SELECT " + ", ".join(f"SQRT(SUM(POW(d_{y}{t}, 2)) * COUNT(*) / (COUNT(*) - 1) * (SUM(n) - 1) / (SUM(n) - {_WIDTH})) AS se_{y}{t}" for y in "xy" for t in "xy") + ", COUNT(*) - 1 AS degrees FROM days", **_SCORE_CTES, days="SELECT day_id, COUNT(*) AS n, " + ", ".join(f"SUM(load[{k + 1}] * e_{y}) AS d_{y}{t}" for y in "xy" for k, t in enumerate("xy")) + " FROM scored GROUP BY 1"), {**_SE_KINDS, "degrees": "r"}))
def e13(spark, sf):
    df, gram, model = fitted(spark, sf)
    return shown(_theta_errors(spark, inference.day_cr1_covariance(df, model, gram), model))


# The same by dataset: inverse, coefficients and row scores have a key.
_KEYED_SCORES = {
    **_KEYED,
    "kinv_m": _INVERSE_M.replace("SELECT [", "SELECT dataset, [", 1).replace("FROM train", "FROM tagged GROUP BY dataset"),
    **recursive(kinv_steps=eliminated("kinv_m", _WIDTH, "dataset")),
    "kinv": f"SELECT dataset, list_transform(m, lambda r: r[{_WIDTH + 1}:{2 * _WIDTH}]) AS a FROM kinv_steps WHERE k = {_WIDTH}",
    "kbeta": f"SELECT dataset, list_transform(m, lambda r: r[{_WIDTH + 1}]) AS b_x, list_transform(m, lambda r: r[{_WIDTH + 2}]) AS b_y FROM kfit WHERE k = {_WIDTH}",
    "kx": f"SELECT *, [{', '.join(f'({c})::DOUBLE' for c in DESIGN)}] AS x FROM tagged",
    "kload": "SELECT kx.*, b_x, b_y, list_transform(a, lambda r: w * list_dot_product(r, x)) AS load FROM kx JOIN kinv USING (dataset) JOIN kbeta USING (dataset)",
    "kscored": "SELECT *, list_dot_product(load, x) AS lev, " + ", ".join(f"q_{s} - list_dot_product(b_{s}, x) AS e_{s}" for s in "xy") + " FROM kload",
}
_KEYED_KINDS = {"dataset": "i", "status": "", **_SE_KINDS, "degrees": "r"}


def _keyed_errors(spark, sf, method: str) -> DataFrame:
    rows = keyed.keyed_covariance(keyed_train(spark, sf), CONTROLS, ["dataset"], method)
    return shown(rows.select("dataset", "status", *keyed.ERRORS, F.col("degrees").cast("double").alias("degrees")))


@query("E11_hc3_covariance_by", sql_shown(on_blocks("SELECT dataset, 'ok' AS status, " + ", ".join(f"SQRT(SUM(POW(load[{k + 1}] * e_{y} / (1 - lev), 2))) AS se_{y}{t}" for y in "xy" for k, t in enumerate("xy")) + f", COUNT(*) - {_WIDTH} AS degrees FROM kscored GROUP BY dataset", **_KEYED_SCORES), _KEYED_KINDS))
def e11_by(spark, sf):
    return _keyed_errors(spark, sf, "hc3")


@query("E12_dml_score_covariance_by", sql_shown(on_blocks("SELECT dataset, 'ok' AS status, " + ", ".join(f"SQRT(SUM(POW(w * e_{y} * ({a}) / (g0 * g2 - g1 * g1), 2))) AS se_{y}{t}" for y in "xy" for t, a in (("x", "g2 * u0 - g1 * u1"), ("y", "g0 * u1 - g1 * u0"))) + ", NULL::DOUBLE AS degrees FROM ksc GROUP BY dataset", tagged=_KEYED["tagged"], **dml_ctes("tagged", "dataset"), kth=f"SELECT dataset, m_00 AS g0, m_01 AS g1, m_11 AS g2, {closed_form()} FROM os", ksc="SELECT oof.*, g0, g1, g2, " + ", ".join(f"u{2 + j} - u0 * theta_{y}x - u1 * theta_{y}y AS e_{y}" for j, y in enumerate("xy")) + " FROM oof JOIN kth USING (dataset)"), _KEYED_KINDS))
def e12_by(spark, sf):
    return _keyed_errors(spark, sf, "score")


@query("E13_day_cr1_covariance_by", sql_shown(on_blocks("SELECT dataset, 'ok' AS status, " + ", ".join(f"SQRT(SUM(POW(d_{y}{t}, 2)) * COUNT(*) / (COUNT(*) - 1) * (SUM(n) - 1) / (SUM(n) - {_WIDTH})) AS se_{y}{t}" for y in "xy" for t in "xy") + ", COUNT(*) - 1 AS degrees FROM kdays GROUP BY dataset", **_KEYED_SCORES, kdays="SELECT dataset, day_id, COUNT(*) AS n, " + ", ".join(f"SUM(load[{k + 1}] * e_{y}) AS d_{y}{t}" for y in "xy" for k, t in enumerate("xy")) + " FROM kscored GROUP BY 1, 2"), _KEYED_KINDS))
def e13_by(spark, sf):
    return _keyed_errors(spark, sf, "day_cr1")


PLUS_TEN = {"scenario_id": "x_plus_10", "multiplier_x0": 1.0, "multiplier_y0": 1.0, "multiplier_x1": 1.1, "multiplier_y1": 1.0, "n_sessions": 10000.0}
_D = math.log(1.1)
_MEANS = f"SELECT [{', '.join(f'SUM(w * {z}) / SUM(w)' for z in Z)}] AS c FROM train"
_POINTS = "SELECT " + ", ".join(f"list_dot_product(list_transform(m[3:{_WIDTH}], lambda r: r[{_WIDTH + j + 1}]), c) AS b_{s}, m[1][{_WIDTH + j + 1}] AS th_{s}, m[2][{_WIDTH + j + 1}] AS thy_{s}" for j, s in enumerate("xy")) + f" FROM fit, means WHERE k = {_WIDTH}"
# Gradients apply to the X and Y score vectors: base = (0, 0, means), price = first unit vector.
_PROJ = "SELECT *, " + ", ".join(f"list_dot_product(load[3:{_WIDTH}], (SELECT c FROM means)) * e_{s} / (1 - lev) AS base_{s}, load[1] * e_{s} / (1 - lev) AS price_{s}, load[2] * e_{s} / (1 - lev) AS pricey_{s}" for s in "xy") + " FROM scored"
_N = 10000.0


def _delta_rows():
    """(metric, outcome, point, gradient projected on the score vectors) of every interval row."""
    p0 = {"X": ("b_x", "base_x"), "Y": ("b_y", "base_y"), "NONE": ("(1 - b_x - b_y)", "(base_x + base_y)")}
    up = {"X": (f"th_x * {_D!r}", f"price_x * {_D!r}"), "Y": (f"th_y * {_D!r}", f"price_y * {_D!r}"), "NONE": (f"(-(th_x + th_y) * {_D!r})", f"(price_x + price_y) * {_D!r}")}
    for o in p0:
        (p, g), (d, h) = p0[o], up[o]
        yield "before_probability", o, p, g
        yield "after_probability", o, f"{p} + {d}", f"{g} + {h}"
        yield "delta_percentage_points", o, f"100 * {d}", f"100 * {h}"
        yield "before_expected_choices", o, f"{_N} * {p}", f"{_N} * {g}"
        yield "after_expected_choices", o, f"{_N} * ({p} + {d})", f"{_N} * ({g} + {h})"
        yield "delta_expected_choices", o, f"{_N} * {d}", f"{_N} * {h}"
    yield "before_expected_bookings", "ALL", f"{_N} * (b_x + b_y)", f"{_N} * (base_x + base_y)"
    yield "after_expected_bookings", "ALL", f"{_N} * (b_x + b_y + (th_x + th_y) * {_D!r})", f"{_N} * (base_x + base_y + (price_x + price_y) * {_D!r})"
    yield "delta_expected_bookings", "ALL", f"{_N} * (th_x + th_y) * {_D!r}", f"{_N} * (price_x + price_y) * {_D!r}"
    for s in "xy":
        for th, price, label in ((f"th_{s}", f"price_{s}", "X"), (f"thy_{s}", f"pricey_{s}", "Y")):
            yield "theta", f"{s.upper()}/{label}", th, price
            yield "elasticity", f"{s.upper()}/{label}", f"(CASE WHEN b_{s} >= 0.05 THEN {th} / b_{s} END)", f"CASE WHEN b_{s} >= 0.05 THEN {price} / b_{s} - {th} / (b_{s} * b_{s}) * base_{s} END"


_DELTA = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{o}' AS outcome, ANY_VALUE({p})::DOUBLE AS point, SQRT(SUM(POW({g}, 2))) AS standard_error FROM proj, pts" for m, o, p, g in _delta_rows()
)
_TQ = recursive(tq=t_quantiles("tq_in"))


@query("E14_delta_intervals", sql_shown(on_blocks("SELECT d.*, point - hi * standard_error AS lower, point + hi * standard_error AS upper FROM delta d, (SELECT hi FROM tq WHERE step = 48)", **_SCORE_CTES, means=_MEANS, pts=_POINTS, proj=_PROJ, delta=_DELTA, tq_in=f"SELECT 1 AS id, 0.975::DOUBLE AS p, (COUNT(*) - {_WIDTH})::DOUBLE AS df FROM train", **_TQ), {"metric": "", "outcome": "", "point": "r5", "standard_error": "r5", "lower": "r5", "upper": "r5"}))
def e14(spark, sf):
    df, gram, model = fitted(spark, sf)
    covariance = inference.hc3_covariance(df, model, gram)
    controls, _ = inference.mean_controls(df, model)
    requests = spark.createDataFrame([PLUS_TEN], ", ".join(f"{c} {'string' if c == 'scenario_id' else 'double'}" for c in PLUS_TEN))
    rows = inference.delta_intervals(requests, model, covariance, controls)
    return shown(rows.select("metric", "outcome", "point", "standard_error", "lower", "upper"), 5)


@query("E15_contrast_identified", on_blocks("SELECT ABS(log_multiplier_y - 0.5 * log_multiplier_x) < 1e-8 AS identified, COUNT(*) AS n FROM blocks GROUP BY 1"))
def e15(spark, sf):
    _, _, model = fitted(spark, sf, on_a_line(train(spark, sf)), "contrast_ols")
    changes = feature_blocks(spark, sf).select(F.col("log_multiplier_x").alias("d_log_x"), F.col("log_multiplier_y").alias("d_log_y"))
    return estimate.contrast_identified(changes, model).groupBy("identified").agg(F.count(F.lit(1)).alias("n"))


@query("E16_levels_identified", sql_shown(on_blocks("SELECT 'on_line' AS levels, COUNT(*) AS n_contexts, 0.0::DOUBLE AS max_off_span, TRUE AS identified FROM blocks UNION ALL SELECT 'off_line', COUNT(*), 0.05 * 0.8, FALSE FROM blocks"), {"levels": "", "n_contexts": "i", "max_off_span": "r", "identified": ""}))
def e16(spark, sf):
    _, _, model = fitted(spark, sf, on_a_line(train(spark, sf)), "contrast_ols")
    contexts = on_a_line(encoded(spark, sf)).withColumns({"ax": F.lit(0.1), "ay": F.lit(0.1)})
    on = estimate.levels_identified(contexts, model, *T).withColumn("levels", F.lit("on_line"))
    off = estimate.levels_identified(contexts, model, "ax", "ay").withColumn("levels", F.lit("off_line"))
    return shown(on.unionByName(off).select("levels", "n_contexts", "max_off_span", "identified"))


@query("E17_ols_reference_variance", sql_shown(on_blocks("SELECT upper(y) AS outcome, upper(t) AS treatment, expected, variance FROM (" + " UNION ALL ".join(f"SELECT '{y}' AS y, '{t}' AS t, SUM(load[{k + 1}] * p_{y}) AS expected, SUM(POW(load[{k + 1}], 2) * p_{y} * (1 - p_{y}) / w) AS variance FROM scored JOIN truth USING (zone_id, day_id, hr)" for y in "xy" for k, t in enumerate("xy")) + ")", **_SCORE_CTES, truth="SELECT zone_id, day_id, hr, SUM(n_x) OVER z / SUM(n_sessions) OVER z::DOUBLE AS p_x, SUM(n_y) OVER z / SUM(n_sessions) OVER z::DOUBLE AS p_y FROM choice_blocks WINDOW z AS (PARTITION BY zone_id, hr)"), {"outcome": "", "treatment": "", "expected": "r", "variance": "r"}))
def e17(spark, sf):
    df, gram, model = fitted(spark, sf)
    blocks = feature_blocks(spark, sf)
    cells = blocks.groupBy(*CELL).agg(*[(F.sum(f"n_{s}") / F.sum("n_sessions")).alias(f"p_{s}") for s in "xy"])
    truth = blocks.select("zone_id", "day_id", "hr").join(cells, CELL)
    return shown(inference.reference_variance(df, truth, model, gram, ["zone_id", "day_id", "hr"]).drop("observed"))


# --- resampling ---------------------------------------------------------------------------

_RANKED = "SELECT day_id, ROW_NUMBER() OVER (ORDER BY day_id) - 1 AS r FROM (SELECT DISTINCT day_id FROM train)"


def mult(draws: int) -> dict[str, str]:
    return {
        "ranked": _RANKED,
        "picks": f"SELECT b AS draw_id, ('0x' || SUBSTR(MD5(b || '-' || i), 1, 8))::BIGINT % (SELECT COUNT(*) FROM ranked) AS picked FROM RANGE({draws}) x(b) CROSS JOIN (SELECT r AS i FROM ranked)",
        "mult": "SELECT draw_id, day_id, COUNT(*) AS times FROM picks JOIN ranked ON picked = r GROUP BY 1, 2",
        "sampled": "SELECT * FROM train JOIN mult USING (day_id)",
    }


_BOOT = {**mult(DRAWS), "bs": price_only("sampled", "draw_id", "times"), "draws": f"SELECT draw_id, {closed_form()}, 'succeeded' AS status FROM bs"}
_LONG = " UNION ALL ".join(f"SELECT '{t}' AS effect, draw_id, status, {t} AS theta FROM draws" for t in resample.THETAS)


def long_draws(draws: DataFrame, key: str = "draw_id") -> DataFrame:
    return draws.unpivot([key, "status"] if "status" in draws.columns else [key], list(resample.THETAS), "effect", "theta")


@query("F01_day_bootstrap", sql_shown(on_blocks("SELECT * FROM draws", **_BOOT), {"draw_id": "i", **THETA_KINDS, "status": ""}))
def f01(spark, sf):
    return shown(resample.bootstrap_prices_only(train(spark, sf), DRAWS))


_FULL_BOOT = {**mult(20), **ols("sampled", DESIGN, Y, "bfit", "draw_id", "times")}


@query("F01_day_bootstrap_adjusted", sql_shown(on_blocks("SELECT draw_id, 'succeeded' AS status, " + ", ".join(f"m[{k + 1}][{_WIDTH + j + 1}] AS theta_{y}{t}" for j, y in enumerate("xy") for k, t in enumerate("xy")) + f" FROM bfit WHERE k = {_WIDTH}", **_FULL_BOOT), {"draw_id": "i", "status": "", **THETA_KINDS}))
def f01_adjusted(spark, sf):
    return shown(resample.day_bootstrap(train(spark, sf), CONTROLS, 20).select("draw_id", "status", *resample.THETAS))


_DML_BOOT = {**mult(20), **dml_ctes("sampled", "draw_id", "times")}
_DML_JACK = {
    "left_rows": "SELECT train.*, out_day FROM train JOIN (SELECT DISTINCT day_id AS out_day FROM train) ON day_id <> out_day",
    **dml_ctes("left_rows", "out_day"),
}


@query("F01_day_bootstrap_dml", sql_shown(on_blocks(f"SELECT draw_id, 'succeeded' AS status, {closed_form()} FROM os", **_DML_BOOT), {"draw_id": "i", "status": "", **THETA_KINDS}))
def f01_dml(spark, sf):
    return shown(resample.day_bootstrap(train(spark, sf), CONTROLS, 20, "dml").select("draw_id", "status", *resample.THETAS))


@query("F05_day_jackknife_dml", sql_shown(on_blocks(f"SELECT out_day AS day_id, {closed_form()} FROM os", **_DML_JACK), {"day_id": "t", **THETA_KINDS}))
def f05_dml(spark, sf):
    return shown(resample.day_jackknife(train(spark, sf), CONTROLS, "dml").select("day_id", *resample.THETAS))


@query("E05_fit_dml_by", sql_shown(on_blocks(f"SELECT dataset, 'succeeded' AS status, {closed_form()} FROM os", tagged=_KEYED["tagged"], **dml_ctes("tagged", "dataset")), {"dataset": "i", "status": "", **THETA_KINDS}))
def e05_by(spark, sf):
    return shown(resample.fit_by(keyed_train(spark, sf), CONTROLS, ["dataset"], "dml").select("dataset", "status", *resample.THETAS))


@query("F02_percentile_interval", sql_shown(on_blocks("SELECT effect, COUNT(*) AS n_draws, QUANTILE_CONT(theta, 0.025) AS lower, QUANTILE_CONT(theta, 0.975) AS upper FROM l GROUP BY 1", **_BOOT, l=_LONG), {"effect": "", "n_draws": "i", "lower": "r", "upper": "r"}))
def f02(spark, sf):
    draws = resample.bootstrap_prices_only(train(spark, sf), DRAWS)
    return shown(resample.percentile_interval(long_draws(draws), ["effect"], "theta"))


_STABLE = "SELECT effect, COUNT(*) AS n_draws, QUANTILE_CONT(theta, 0.975) - QUANTILE_CONT(theta, 0.025) AS wd, QUANTILE_CONT(theta, 0.975) FILTER (WHERE draw_id < 25) - QUANTILE_CONT(theta, 0.025) FILTER (WHERE draw_id < 25) AS hw FROM l GROUP BY 1"


@query("F03_interval_stability", sql_shown(on_blocks(f"SELECT effect, n_draws, TRUE AS assessed, ABS(wd - hw) / GREATEST(wd, 1e-8) AS relative_width_change, ABS(wd - hw) / GREATEST(wd, 1e-8) > 0.5 AS unstable FROM ({_STABLE})", **_BOOT, l=_LONG), {"effect": "", "n_draws": "i", "assessed": "", "relative_width_change": "r", "unstable": ""}))
def f03(spark, sf):
    draws = resample.bootstrap_prices_only(train(spark, sf), DRAWS)
    return shown(resample.interval_stability(long_draws(draws), ["effect"], "theta"))


_JACK = {
    "left_out": "SELECT t.*, d.day_id AS out_day FROM train t JOIN (SELECT DISTINCT day_id FROM train) d ON t.day_id <> d.day_id",
    "js": price_only("left_out", "out_day"),
    "jack": f"SELECT out_day, {closed_form()} FROM js",
    "lj": " UNION ALL ".join(f"SELECT '{t}' AS effect, {t} AS theta FROM jack" for t in resample.THETAS),
    "ps": price_only("train"),
    "pt": f"SELECT {closed_form()} FROM ps",
    "lp": " UNION ALL ".join(f"SELECT '{t}' AS effect, {t} AS point FROM pt" for t in resample.THETAS),
}


def point_rows(spark, sf) -> DataFrame:
    whole = estimate.theta_from_moments(estimate.moments(train(spark, sf), []))
    return whole.unpivot([], list(resample.THETAS), "effect", "point")


def jack_rows(spark, sf) -> DataFrame:
    return resample.jackknife_prices_only(train(spark, sf)).unpivot(["day_id"], list(resample.THETAS), "effect", "theta")


_BCA_STATS = """SELECT effect, MAX(point) AS point, MAX(n_draws) AS n_draws, MAX(rk) AS rank, COUNT(*) AS n_jackknife, SUM(POW(mj - j.theta, 3)) / (6 * POW(SUM(POW(mj - j.theta, 2)), 1.5)) AS acceleration
FROM (SELECT *, AVG(theta) OVER (PARTITION BY effect) AS mj FROM lj) j JOIN (SELECT effect, MAX(point) AS point, COUNT(*) AS n_draws, (COUNT(*) FILTER (WHERE theta < point) + COUNT(*) FILTER (WHERE theta <= point)) / (2.0 * COUNT(*))::DOUBLE AS rk FROM l JOIN lp USING (effect) GROUP BY 1) d USING (effect) GROUP BY 1"""


@query("F04_bca_statistics", sql_shown(on_blocks("SELECT * FROM st", **_BOOT, l=_LONG, **_JACK, st=_BCA_STATS), {"effect": "", "point": "r", "n_draws": "i", "rank": "r", "n_jackknife": "i", "acceleration": "r"}))
def f04_statistics(spark, sf):
    draws = long_draws(resample.bootstrap_prices_only(train(spark, sf), DRAWS))
    stats = resample.bca_statistics(point_rows(spark, sf), draws, jack_rows(spark, sf), ["effect"], "theta")
    return shown(stats.select("effect", "point", "n_draws", "rank", "n_jackknife", "acceleration"))


_Z975 = "1.959963984540054::DOUBLE"
_BCA = {
    "nq_in": "SELECT effect AS id, rank AS p FROM st",
    **recursive(nq=normal_quantiles("nq_in")),
    "shift": f"SELECT st.*, z0, z0 + (z0 - {_Z975}) / (1 - acceleration * (z0 - {_Z975})) AS a1, z0 + (z0 + {_Z975}) / (1 - acceleration * (z0 + {_Z975})) AS a2 FROM st JOIN (SELECT id AS effect, (lo + hi) / 2 AS z0 FROM nq WHERE step = 48) USING (effect)",
    "adj": f"SELECT *, {normal_cdf('a1')} AS p1, {normal_cdf('a2')} AS p2, (SELECT list_sort(list(theta)) FROM l WHERE l.effect = shift.effect) AS s FROM shift",
    "bca": "SELECT *, p1 >= 1.0 / (n_draws + 1) AND p2 <= 1 - 1.0 / (n_draws + 1) AS inside, p1 * (n_draws - 1) AS h1, p2 * (n_draws - 1) AS h2 FROM adj",
}
_AT = "CASE WHEN inside THEN s[FLOOR({h})::INT + 1] + ({h} - FLOOR({h})) * (s[CEIL({h})::INT + 1] - s[FLOOR({h})::INT + 1]) END"


@query("F04_basic_bca_interval", sql_shown(on_blocks(f"""SELECT effect, pl AS percentile_lower, pu AS percentile_upper, 2 * point - pu AS basic_lower, 2 * point - pl AS basic_upper, {_AT.format(h="h1")} AS bca_lower, {_AT.format(h="h2")} AS bca_upper, z0, acceleration, p1 AS adjusted_lower_probability, p2 AS adjusted_upper_probability,
CASE WHEN NOT inside THEN 'adjusted_probabilities_outside_empirical_tail_support' END AS reason FROM bca JOIN (SELECT effect, QUANTILE_CONT(theta, 0.025) AS pl, QUANTILE_CONT(theta, 0.975) AS pu FROM l GROUP BY 1) USING (effect)""", **_BOOT, l=_LONG, **_JACK, st=_BCA_STATS, **_BCA), {"effect": "", **dict.fromkeys(("percentile_lower", "percentile_upper", "basic_lower", "basic_upper", "bca_lower", "bca_upper", "z0", "acceleration", "adjusted_lower_probability", "adjusted_upper_probability"), "r"), "reason": ""}))
def f04(spark, sf):
    draws = long_draws(resample.bootstrap_prices_only(train(spark, sf), DRAWS))
    return shown(resample.basic_bca_interval(point_rows(spark, sf), draws, jack_rows(spark, sf), ["effect"], "theta"))


@query("F05_day_jackknife", sql_shown(on_blocks("SELECT out_day AS day_id, * EXCLUDE (out_day) FROM jack", **_JACK), {"day_id": "t", **THETA_KINDS}))
def f05(spark, sf):
    return shown(resample.jackknife_prices_only(train(spark, sf)))


_FULL_JACK = {"left_out": _JACK["left_out"], **ols("left_out", DESIGN, Y, "jfit", "out_day")}


_KEYED_JACK = {
    "kleft": "SELECT t.*, d.day_id AS out_day FROM tagged t JOIN (SELECT DISTINCT dataset, day_id FROM tagged) d ON t.dataset = d.dataset AND t.day_id <> d.day_id",
    **ols("kleft", DESIGN, Y, "kjfit", "dataset, out_day"),
}


@query("F05_day_jackknife_by", sql_shown(on_blocks("SELECT dataset, out_day AS day_id, " + ", ".join(f"m[{k + 1}][{_WIDTH + j + 1}] AS theta_{y}{t}" for j, y in enumerate("xy") for k, t in enumerate("xy")) + f" FROM kjfit WHERE k = {_WIDTH}", tagged=_KEYED["tagged"], **_KEYED_JACK), {"dataset": "i", "day_id": "t", **THETA_KINDS}))
def f05_by(spark, sf):
    return shown(resample.day_jackknife(keyed_train(spark, sf), CONTROLS, by=["dataset"]).select("dataset", "day_id", *resample.THETAS))


@query("F05_day_jackknife_adjusted", sql_shown(on_blocks("SELECT out_day AS day_id, " + ", ".join(f"m[{k + 1}][{_WIDTH + j + 1}] AS theta_{y}{t}" for j, y in enumerate("xy") for k, t in enumerate("xy")) + f" FROM jfit WHERE k = {_WIDTH}", **_FULL_JACK), {"day_id": "t", **THETA_KINDS}))
def f05_adjusted(spark, sf):
    return shown(resample.day_jackknife(train(spark, sf), CONTROLS).select("day_id", *resample.THETAS))


@query("F06_jackknife_t_interval", sql_shown(on_blocks("SELECT effect, groups, point, v AS jackknife_variance, SQRT(v) AS jackknife_se, hi AS critical, point - hi * SQRT(v) AS lower, point + hi * SQRT(v) AS upper FROM (SELECT effect, COUNT(*) AS groups, MAX(point) AS point, (COUNT(*) - 1) * VAR_POP(theta) AS v FROM lj JOIN lp USING (effect) GROUP BY 1), (SELECT hi FROM tq WHERE step = 48)", **_JACK, tq_in="SELECT 1 AS id, 0.975::DOUBLE AS p, (COUNT(*) - 1)::DOUBLE AS df FROM jack", **_TQ), {"effect": "", "groups": "i", **dict.fromkeys(("point", "jackknife_variance", "jackknife_se", "critical", "lower", "upper"), "r")}))
def f06(spark, sf):
    estimates = jack_rows(spark, sf).join(point_rows(spark, sf), "effect")
    return shown(resample.jackknife_t_interval(estimates, ["effect"], "theta", "point").drop("reason"))


@query("F07_draw_diagnostics", sql_shown(on_blocks("""SELECT effect, COUNT(*) AS attempted, 0::BIGINT AS failed, 60 - COUNT(*) AS not_attempted, STDDEV_SAMP(theta) AS bootstrap_sd, QUANTILE_CONT(theta, 0.025) AS lower, QUANTILE_CONT(theta, 0.975) AS upper,
QUANTILE_CONT(theta, 0.975) - QUANTILE_CONT(theta, 0.025) AS interval_width, QUANTILE_CONT(theta, 0.975) < 0.09 AS miss_below_truth, QUANTILE_CONT(theta, 0.025) > 0.09 AS miss_above_truth, COUNT(*) FILTER (WHERE draw_id < 30) AS prefix_successful,
QUANTILE_CONT(theta, 0.025) - QUANTILE_CONT(theta, 0.025) FILTER (WHERE draw_id < 30) AS lower_shift, QUANTILE_CONT(theta, 0.975) - QUANTILE_CONT(theta, 0.975) FILTER (WHERE draw_id < 30) AS upper_shift FROM l GROUP BY 1""", **_BOOT, l=_LONG), {"effect": "", "attempted": "i", "failed": "i", "not_attempted": "i", "bootstrap_sd": "r", "lower": "r", "upper": "r", "interval_width": "r", "miss_below_truth": "", "miss_above_truth": "", "prefix_successful": "i", "lower_shift": "r", "upper_shift": "r"}))
def f07(spark, sf):
    draws = long_draws(resample.bootstrap_prices_only(train(spark, sf), DRAWS))
    return shown(resample.draw_diagnostics(draws, ["effect"], "theta", 60, F.lit(0.09), prefix=30))
