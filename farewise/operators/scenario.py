"""Price scenarios: context selection, support, expected choices, intervals, status.

Scenario requests are a table: scenario_id, target_context_set ('all' or 'zone_<id>'),
multiplier_x0, multiplier_y0 (baseline), multiplier_x1, multiplier_y1 (target), n_sessions.
Contexts are reduced once per zone; requests then join that small table by context set.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.functions.scalars import rounded
from farewise.functions.skew import with_neighbour, with_running_max
from farewise.operators.choice import PRICE_LEVELS, price_key
from farewise.operators.estimate import SPAN_TOLERANCE, WEIGHT, Model
from farewise.sources.tables import ContractError

STRATUM = ["zone_id", "is_weekend", "is_peak"]
SERVICES = ("X", "Y", "NONE")
POINT_EPSILON = 1e-10
#: Draws in a block and pieces of the zones that meet as one group.
DRAW_BLOCK = 256
CONTEXT_PIECES = 16


# --- context selection --------------------------------------------------------------------

def with_utc(df: DataFrame, tz: str, slot_minutes: int, ts: str = "slot_start_local") -> DataFrame:
    """Add block_start/block_end in UTC and a flag for local times a clock change makes unclear."""
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col(ts))
    local = lambda c: F.convert_timezone(F.lit("UTC"), F.lit(tz), c)
    hour = F.expr("INTERVAL 1 HOUR")
    unclear = (local(utc) != F.col(ts)) | (local(utc + hour) == F.col(ts)) | (local(utc - hour) == F.col(ts))
    return df.withColumns(
        {
            "block_start": utc,
            "block_end": F.timestamp_add("MINUTE", F.lit(slot_minutes), utc),
            "clock_unclear": unclear,
        }
    )


def select_contexts(
    df: DataFrame, start_utc: Column, end_utc: Column, tz: str, slot_minutes: int, zone: int | None = None
) -> DataFrame:
    """Whole blocks inside the half-open horizon, optionally of one zone."""
    placed = with_utc(df if zone is None else df.filter(F.col("zone_id") == zone), tz, slot_minutes)
    return placed.filter((F.col("block_start") >= start_utc) & (F.col("block_end") <= end_utc))


def tiling(blocks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per zone: does it start and end on the horizon, without gap, overlap or repeat."""
    linked = with_neighbour(
        blocks, ["zone_id"], ["block_start"], F.to_date("block_start"), ["block_start"], "next"
    )
    broken = F.col("next.block_start") != F.col("block_end")
    return linked.groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        (F.min("block_start") == start).alias("starts_on_horizon"),
        (F.max("block_end") == end).alias("ends_on_horizon"),
        F.count_if(broken).alias("broken_joints"),
    )


# --- support ------------------------------------------------------------------------------

def _adjacent(value: Column) -> Column:
    """The price level itself, or the levels on both sides; empty outside the designed range."""
    exact = [F.when(F.abs(value - v) <= POINT_EPSILON, F.array(F.lit(v))) for v in PRICE_LEVELS]
    between = [
        F.when((value > low) & (value < high), F.array(F.lit(low), F.lit(high)))
        for low, high in zip(PRICE_LEVELS, PRICE_LEVELS[1:])
    ]
    return F.coalesce(*exact, *between, F.array().cast("array<double>"))


def _points(requests: DataFrame) -> DataFrame:
    """One row per scenario and price point (baseline, target)."""
    point = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("point"), F.col(f"multiplier_x{i}").alias("x"), F.col(f"multiplier_y{i}").alias("y"))
                for i, name in enumerate(("baseline", "target"))
            ]
        )
    ).alias("p")
    return requests.select("scenario_id", "target_context_set", point).select("scenario_id", "target_context_set", "p.*")


def corners(requests: DataFrame) -> DataFrame:
    """Adjacent joint price corners of each point; a point outside the range has none."""
    return (
        _points(requests)
        .withColumn("cx", F.explode_outer(_adjacent(F.col("x"))))
        .withColumn("cy", F.explode_outer(_adjacent(F.col("y"))))
        .withColumn("corner", F.when(F.col("cx").isNotNull() & F.col("cy").isNotNull(), price_key("cx", "cy")))
    )


def _keyed(df: DataFrame) -> DataFrame:
    """Stratum flags as integers, whether they arrive as flags or as encoded features."""
    return df.withColumns({c: F.col(c).cast("int") for c in ("is_weekend", "is_peak")})


def strata(contexts: DataFrame) -> DataFrame:
    """Distinct strata, once for 'all' and once for their own zone's context set."""
    own = F.concat(F.lit("zone_"), F.col("zone_id").cast("string"))
    return _keyed(contexts).select(*STRATUM).distinct().withColumn(
        "target_context_set", F.explode(F.array(F.lit("all"), own))
    )


def corner_counts(train: DataFrame) -> DataFrame:
    return _keyed(train).groupBy(*STRATUM, price_key("multiplier_x", "multiplier_y").alias("corner")).agg(
        F.count(F.lit(1)).alias("blocks")
    )


def corner_table(train: DataFrame, contexts: DataFrame, requests: DataFrame, min_n: int) -> DataFrame:
    """(scenario, point, stratum, corner) with its training blocks and corner status."""
    counts = corner_counts(train)
    anywhere = counts.groupBy("corner").agg(F.sum("blocks").alias("total_blocks"))
    placed = corners(requests).join(strata(contexts), "target_context_set")
    counted = placed.join(counts, [*STRATUM, "corner"], "left").join(anywhere, "corner", "left")
    blocks = F.coalesce("blocks", F.lit(0))
    status = F.when(F.col("corner").isNull(), "outside").when(blocks == 0, "missing").when(blocks < min_n, "insufficient").otherwise("ok")
    return counted.select(
        "scenario_id", "point", *STRATUM, F.col("cx").alias("multiplier_x"), F.col("cy").alias("multiplier_y"),
        blocks.alias("training_blocks"), F.coalesce("total_blocks", F.lit(0)).alias("total_blocks"), status.alias("corner_status"),
    )


def _reason(min_n: int) -> Column:
    c = {k: F.col(k).cast("string") for k in ("multiplier_x", "multiplier_y", "training_blocks", *STRATUM)}
    short = F.concat(
        F.lit("corner ("), c["multiplier_x"], F.lit(", "), c["multiplier_y"], F.lit(") has "), c["training_blocks"],
        F.lit(" blocks in zone "), c["zone_id"], F.lit(" weekend "), c["is_weekend"], F.lit(" peak "), c["is_peak"],
        F.lit(f", minimum {min_n}"),
    )
    return F.when(F.col("corner_status").isin("missing", "insufficient"), short)


def joint_support(
    train: DataFrame, contexts: DataFrame, requests: DataFrame, min_n: int, well_conditioned: bool = True
) -> DataFrame:
    """(scenario, point): ok, insufficient_support or out_of_support, with every reason.

    Strata x corners are few per scenario, so the reason list stays short.
    """
    table = corner_table(train, contexts, requests, min_n)
    outside = F.max(F.col("corner_status") == "outside")
    unseen = F.min("total_blocks") == 0
    thin = F.count_if(F.col("training_blocks") < min_n)
    return table.groupBy("scenario_id", "point").agg(
        F.when(outside | unseen, "out_of_support")
        .when((thin > 0) | F.lit(not well_conditioned), "insufficient_support")
        .otherwise("ok").alias("support_status"),
        F.min("training_blocks").alias("min_blocks"),
        F.when(outside | unseen, 0).otherwise(thin).alias("n_reasons"),
        F.array_sort(F.collect_list(_reason(min_n))).alias("reasons"),
    )


def line_support(train: DataFrame, contexts: DataFrame, requests: DataFrame, min_n: int) -> DataFrame:
    """Support when prices move along one line: an exact training point, or one on each side."""
    logs = _keyed(train).select(*STRATUM, F.ln("multiplier_x").alias("lx"), F.ln("multiplier_y").alias("ly"))
    ends = logs.agg(F.min(F.struct("lx", "ly")).alias("a"), F.max(F.struct("lx", "ly")).alias("b")).first()
    a, b = np.array([*ends["a"]]), np.array([*ends["b"]])
    length = float(np.linalg.norm(b - a))
    if length <= SPAN_TOLERANCE:
        raise ContractError("no joint price line in the training prices")
    ux, uy = (float(v) for v in (b - a) / length)
    along = lambda x, y: (x - float(a[0])) * ux + (y - float(a[1])) * uy
    off = lambda x, y: F.abs((x - float(a[0])) * uy - (y - float(a[1])) * ux)
    placed = logs.withColumns({"t": rounded(along(F.col("lx"), F.col("ly")), 9), "off": off(F.col("lx"), F.col("ly"))})
    if placed.agg(F.max("off")).first()[0] > SPAN_TOLERANCE:
        raise ContractError("line support needs one observed line of prices")
    asked = _points(requests).withColumns({"t": rounded(along(F.ln("x"), F.ln("y")), 9), "off": off(F.ln("x"), F.ln("y"))})
    asked = asked.select("scenario_id", "target_context_set", "point", "t", "off")
    # Nearest training point on either side: requests and points in one order, cut into short pieces.
    points = placed.select("t").distinct()
    nothing = {c: F.lit(None).cast(asked.schema[c].dataType) for c in asked.columns if c != "t"}
    along_line = asked.withColumns({"seen": F.lit(None).cast("double"), "kind": F.lit(0)}).unionByName(
        points.withColumns({**nothing, "seen": F.col("t"), "kind": F.lit(1)})
    ).withColumns({"line": F.lit(0), "back": -F.col("t"), "seen_back": -F.col("seen")})
    piece = lambda c: F.floor(F.col(c) * 1000)
    along_line = with_running_max(along_line, ["line"], ["t", "kind"], piece("t"), "seen", "below")
    along_line = with_running_max(along_line, ["line"], ["back", "kind"], piece("back"), "seen_back", "above")
    placed_requests = along_line.filter("kind = 0").withColumn("above", -F.col("above"))
    asked = placed_requests.join(points.withColumn("exact", F.lit(True)), "t", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    exact, below, above = F.col("exact"), F.col("below"), F.col("above")
    supported = (F.col("off") <= SPAN_TOLERANCE) & (exact | (below.isNotNull() & above.isNotNull()))
    needed = F.when(supported, F.when(exact, F.array("t")).otherwise(F.array(below, above)))
    asked = asked.select("scenario_id", "target_context_set", "point", F.explode_outer(needed).alias("t"))
    counts = placed.groupBy(*STRATUM, "t").agg(F.count(F.lit(1)).alias("blocks"))
    table = asked.join(strata(contexts), "target_context_set").join(counts, [*STRATUM, "t"], "left")
    blocks = F.coalesce("blocks", F.lit(0))
    thin = F.count_if(blocks < min_n)
    return table.groupBy("scenario_id", "point").agg(
        F.when(F.max(F.col("t").isNull()), "out_of_support").when(thin > 0, "insufficient_support").otherwise("ok").alias("support_status"),
        F.min(blocks).alias("min_blocks"),
    )


def eligible_strata(train: DataFrame, requests: DataFrame, min_n: int) -> DataFrame:
    """Training strata with enough blocks at every corner of both prices, per scenario."""
    table = corner_table(train, train, requests, min_n)
    return table.groupBy("scenario_id", *STRATUM).agg(
        F.min("training_blocks").alias("min_blocks"),
        F.count_if(F.col("corner_status") != "ok").alias("failing_corners"),
        (F.count_if(F.col("corner_status") != "ok") == 0).alias("eligible"),
    )


def scope_contexts(contexts: DataFrame, eligible: DataFrame) -> DataFrame:
    """Retained, excluded and unseen blocks and sessions by scenario, weekend and peak."""
    per_stratum = _keyed(contexts).groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("blocks"), F.sum(WEIGHT).alias("sessions"))
    names = eligible.agg(F.collect_set("scenario_id")).scalar()
    keyed = per_stratum.withColumn("scenario_id", F.explode(names))
    marked = keyed.join(eligible.select("scenario_id", *STRATUM, "eligible"), ["scenario_id", *STRATUM], "left")
    kept, unseen = F.coalesce("eligible", F.lit(False)), F.col("eligible").isNull()
    zero = F.lit(0)
    return marked.groupBy("scenario_id", "is_weekend", "is_peak").agg(
        F.sum("blocks").alias("all_blocks"),
        F.sum("sessions").alias("all_sessions"),
        F.sum(F.when(kept, F.col("blocks")).otherwise(zero)).alias("retained_blocks"),
        F.sum(F.when(kept, F.col("sessions")).otherwise(zero)).alias("retained_sessions"),
        F.sum(F.when(~kept, F.col("blocks")).otherwise(zero)).alias("excluded_blocks"),
        F.sum(F.when(unseen, F.col("blocks")).otherwise(zero)).alias("unseen_blocks"),
    )


# --- expected choices ---------------------------------------------------------------------

_RANGES = {"lo_x": F.min, "hi_x": F.max, "lo_y": F.min, "hi_y": F.max, "lo_s": F.min, "hi_s": F.max}


def _by_context_set(per_zone: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Zone summaries under their own context set, plus their total under 'all'."""
    merged = [F.sum(c).alias(c) for c in ("n", "w", "s_x", "s_y")] + [f(c).alias(c) for c, f in _RANGES.items()]
    own = per_zone.withColumn("target_context_set", F.concat(F.lit("zone_"), F.col("zone_id").cast("string")))
    whole = per_zone.groupBy(*extra).agg(*merged).withColumn("target_context_set", F.lit("all"))
    return own.drop("zone_id").unionByName(whole)


def context_summary(contexts: DataFrame, model: Model) -> DataFrame:
    """Per context set: blocks, sessions, weighted base shares and their extremes.

    Probabilities are base plus a constant price effect, so the extremes decide whether any
    context leaves the simplex at any requested price without visiting contexts again.
    """
    w, bx, by = F.col(WEIGHT).cast("double"), model.baseline(0), model.baseline(1)
    based = contexts.select("zone_id", w.alias("w"), bx.alias("bx"), by.alias("by"))
    total = F.col("bx") + F.col("by")
    per_zone = based.groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"),
        F.sum(F.col("w") * F.col("bx")).alias("s_x"), F.sum(F.col("w") * F.col("by")).alias("s_y"),
        F.min("bx").alias("lo_x"), F.max("bx").alias("hi_x"), F.min("by").alias("lo_y"), F.max("by").alias("hi_y"),
        F.min(total).alias("lo_s"), F.max(total).alias("hi_s"),
    )
    return _by_context_set(per_zone)


def _valid(e_x: Column, e_y: Column) -> Column:
    return (
        (F.col("lo_x") + e_x >= 0) & (F.col("hi_x") + e_x <= 1) & (F.col("lo_y") + e_y >= 0) & (F.col("hi_y") + e_y <= 1)
        & (F.col("lo_s") + e_x + e_y >= 0) & (F.col("hi_s") + e_x + e_y <= 1)
    )


def _with_effects(df: DataFrame, theta: dict[str, Column]) -> DataFrame:
    """Add mean probabilities p<service><point> and the validity flag from summaries and theta."""
    out, flags = {}, []
    for i in (0, 1):
        lx, ly = F.ln(f"multiplier_x{i}"), F.ln(f"multiplier_y{i}")
        ex, ey = theta["xx"] * lx + theta["xy"] * ly, theta["yx"] * lx + theta["yy"] * ly
        px, py = F.col("s_x") / F.col("w") + ex, F.col("s_y") / F.col("w") + ey
        out |= {f"p_x{i}": px, f"p_y{i}": py, f"p_none{i}": 1 - px - py}
        flags.append(_valid(ex, ey))
    return df.withColumns({**out, "probability_valid": flags[0] & flags[1]})


def scenario_probabilities(model: Model, contexts: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request with mean shares before and after, and simplex validity."""
    joined = requests.join(context_summary(contexts, model), "target_context_set")
    theta = {f"{y}{t}": F.lit(float(model.theta[j, k])) for j, y in enumerate("xy") for k, t in enumerate("xy")}
    return _with_effects(joined, theta)


def _metric_rows() -> list[Column]:
    """All metric records of one scenario row as structs."""
    n = F.col("n_sessions").cast("double")
    rows = []

    def add(metric: str, service: str, period: str, value: Column, unit: str):
        rows.append(
            F.struct(
                F.lit(metric).alias("metric_id"), F.lit(service).alias("service"), F.lit(period).alias("period"),
                value.cast("double").alias("estimate"), F.lit(unit).alias("unit"),
            )
        )

    def change(low: Column, high: Column):
        return (("baseline", low), ("target", high), ("delta", high - low))

    for service in SERVICES:
        key = service.lower()
        p0, p1 = F.col(f"p_{key}0"), F.col(f"p_{key}1")
        for period, value in change(p0, p1):
            percent = period == "delta"
            add(f"probability_{period}_{key}", service, period, value * 100 if percent else value, "percentage_points" if percent else "fraction")
        for period, value in change(p0 * n, p1 * n):
            if service == "NONE":
                add(f"expected_non_booking_sessions_{period}", service, period, value, "non_booking_sessions")
            else:
                add(f"expected_requests_{period}_{key}", service, period, value, "requests")
    totals = [(F.col(f"p_x{i}") + F.col(f"p_y{i}")) * n for i in (0, 1)]
    for period, value in change(*totals):
        add(f"expected_requests_{period}_total", "TOTAL", period, value, "requests")
    return rows


def scenario_metrics(model: Model, contexts: DataFrame, requests: DataFrame) -> DataFrame:
    """Long metric rows; estimates are withheld when any context leaves the simplex."""
    rows = scenario_probabilities(model, contexts, requests)
    long = rows.select("scenario_id", "probability_valid", F.explode(F.array(*_metric_rows())).alias("m"))
    return long.select("scenario_id", "m.*", "probability_valid").withColumn(
        "estimate", F.when(F.col("probability_valid"), F.col("estimate"))
    )


def elasticity(model: Model, contexts: DataFrame, requests: DataFrame, floor: float = 0.05) -> DataFrame:
    """theta / mean baseline share per (scenario, outcome, treatment); NULL below the floor."""
    rows = scenario_probabilities(model, contexts, requests)
    cells = []
    for j, y in enumerate("xy"):
        for k, t in enumerate("xy"):
            theta = F.lit(float(model.theta[j, k])) if k in model.active else F.lit(None).cast("double")
            base = F.col(f"p_{y}0")
            cells.append(
                F.struct(
                    F.lit(y.upper()).alias("outcome"), F.lit(t.upper()).alias("treatment"), theta.alias("theta"),
                    base.alias("baseline_share"), F.when(base >= floor, theta / base).alias("elasticity"),
                )
            )
    return rows.select("scenario_id", F.explode(F.array(*cells)).alias("c")).select("scenario_id", "c.*")


def draw_summaries(contexts: DataFrame, controls: Sequence[str], draws: DataFrame, requested: int) -> DataFrame:
    """`context_summary` for every successful bootstrap draw, with the draw's effects beside it.

    Contexts are reduced to distinct control values per zone first. Draws stay a table: blocks of
    about DRAW_BLOCK of them meet the pieces of the contexts by key, and a block and piece leave
    zone-by-draw sums and ranges from one matrix product.
    """
    names, k = list(controls), len(controls)
    effects = [f"th_{a}" for a in ("xx", "xy", "yx", "yy")]
    blocks = -(-int(requested) // DRAW_BLOCK)
    w = F.col(WEIGHT).cast("double")
    values = [F.col(c).cast("double").alias(c) for c in names]
    distinct = contexts.groupBy("zone_id", *values).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"))
    piece = F.pmod(F.xxhash64("zone_id"), F.lit(CONTEXT_PIECES)).cast("int").alias("piece")
    spread = distinct.select("*", piece, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    ok = draws.filter("status = 'succeeded'").select(
        "draw_id", "intercept", "coefficients", *[F.col(f"theta_{e[3:]}").alias(e) for e in effects],
        F.pmod("draw_id", F.lit(blocks)).cast("int").alias("block"),
    )
    ok = ok.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(CONTEXT_PIECES - 1))))
    schema = ", ".join(["zone_id bigint, draw_id bigint", *[f"{e} double" for e in effects], "n bigint, w double, s_x double, s_y double", *[f"{c} double" for c in _RANGES]])

    def ranges(key, part: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])]
        level = np.array([list(v) for v in drawn["intercept"]]).reshape(len(drawn), 2)
        slope = np.array([list(v) for v in drawn["coefficients"]]).reshape(len(drawn), 2, k)
        for zone, rows in part.groupby("zone_id") if len(drawn) else ():
            z, weight = rows[names].to_numpy(float), rows["w"].to_numpy(float)
            bx, by = (z @ slope[:, j].T + level[:, j] for j in range(2))
            both = bx + by
            out.append(
                pd.DataFrame(
                    {
                        "zone_id": int(zone), "draw_id": drawn["draw_id"].to_numpy(), **{e: drawn[e].to_numpy() for e in effects},
                        "n": int(rows["n"].sum()), "w": weight.sum(), "s_x": weight @ bx, "s_y": weight @ by,
                        "lo_x": bx.min(0), "hi_x": bx.max(0), "lo_y": by.min(0), "hi_y": by.max(0), "lo_s": both.min(0), "hi_s": both.max(0),
                    }
                )
            )
        return pd.concat(out[1:] or out)

    met = spread.groupBy("block", "piece").cogroup(ok.groupBy("block", "piece"))
    return _by_context_set(met.applyInPandas(ranges, schema), ["draw_id", *effects])


def bootstrap_scenario(
    contexts: DataFrame, controls: Sequence[str], draws: DataFrame, requests: DataFrame,
    requested: int, level: float = 0.95, minimum: int = 199, max_failed: float = 0.05,
) -> DataFrame:
    """Percentile intervals of every metric, gated by failed and invalid draws.

    Output: scenario_id, metric_id, valid_draws, invalid_draws, failure_fraction,
    interval_status, lower, upper; bounds are NULL unless the status is ok.
    """
    summaries = draw_summaries(contexts, controls, draws, requested)
    joined = requests.join(summaries, "target_context_set")
    rows = _with_effects(joined, {a: F.col(f"th_{a}") for a in ("xx", "xy", "yx", "yy")})
    long = rows.select("scenario_id", "draw_id", "probability_valid", F.explode(F.array(*_metric_rows())).alias("m"))
    tail = (1 - level) / 2
    value = F.when(F.col("probability_valid"), F.col("m.estimate"))
    stats = long.groupBy("scenario_id", F.col("m.metric_id").alias("metric_id")).agg(
        F.count_if("probability_valid").alias("valid_draws"),
        F.count_if(~F.col("probability_valid")).alias("invalid_draws"),
        F.percentile(value, tail).alias("lower"),
        F.percentile(value, 1 - tail).alias("upper"),
    )
    failed = 1 - F.col("valid_draws") / F.lit(float(requested))
    stable = (F.col("invalid_draws") == 0) & (F.col("valid_draws") >= minimum) & (failed <= max_failed)
    return stats.select(
        "scenario_id", "metric_id", "valid_draws", "invalid_draws", failed.alias("failure_fraction"),
        F.when(stable, "ok").otherwise("interval_unstable").alias("interval_status"),
        F.when(stable, F.col("lower")).alias("lower"), F.when(stable, F.col("upper")).alias("upper"),
    )


# --- status -------------------------------------------------------------------------------

def scenario_status(
    identified: Column, probability_valid: Column, baseline: Column, target: Column, interval: Column
) -> Column:
    """Final status of a scenario; earlier problems hide later ones."""
    either = lambda s: (baseline == s) | (target == s)
    return (
        F.when(~identified, "not_identified")
        .when(either("out_of_support"), "out_of_support")
        .when((baseline != "ok") & (target != "ok"), target)
        .when(~probability_valid, "invalid_probability")
        .when(target != "ok", target)
        .when(baseline != "ok", baseline)
        .when(interval != "ok", "interval_unstable")
        .otherwise("ok")
    )


def wide_support(support: DataFrame) -> DataFrame:
    """(scenario, baseline_support, target_support) from the per-point table."""
    at = lambda p: F.max(F.when(F.col("point") == p, F.col("support_status")))
    return support.groupBy("scenario_id").agg(at("baseline").alias("baseline_support"), at("target").alias("target_support"))


def scenario_gates(
    model: Model, contexts: DataFrame, requests: DataFrame, support: DataFrame, identified: DataFrame | None = None
) -> DataFrame:
    """Per scenario: identification, validity and support, before any interval."""
    base = scenario_probabilities(model, contexts, requests).select("scenario_id", "probability_valid")
    gates = base.join(wide_support(support), "scenario_id")
    if identified is None:
        return gates.withColumn("identified", F.lit(model.ok))
    return gates.join(identified.select("scenario_id", "identified"), "scenario_id")


def forecast(metrics: DataFrame, gates: DataFrame, intervals: DataFrame) -> DataFrame:
    """Metric records with point-level withholding and the scenario's final status.

    A baseline metric needs only baseline support, a target metric only target support, a
    delta both; identification or simplex failures withhold everything.
    """
    joined = metrics.drop("probability_valid").join(gates, "scenario_id").join(
        intervals.select("scenario_id", "metric_id", "lower", "upper", F.col("interval_status").alias("_interval")),
        ["scenario_id", "metric_id"], "left",
    )
    b, t = F.col("baseline_support"), F.col("target_support")
    interval = F.coalesce("_interval", F.lit("interval_unavailable"))
    status = scenario_status(F.col("identified"), F.col("probability_valid"), b, t, interval)
    stopped = status.isin("not_identified", "invalid_probability", "out_of_support") | ((b != "ok") & (t != "ok"))
    point = F.when(F.col("period") == "baseline", b).when(F.col("period") == "target", t).when(t != "ok", t).otherwise(b)
    shown = ~stopped & (point == "ok")
    return joined.select(
        "scenario_id", "metric_id", "service", "period", "unit",
        F.when(shown, F.col("estimate")).alias("estimate"),
        F.when(stopped, status).otherwise(point).alias("status"),
        F.when(shown, interval).otherwise("interval_unavailable").alias("interval_status"),
        F.when(shown & (interval == "ok"), F.col("lower")).alias("lower"),
        F.when(shown & (interval == "ok"), F.col("upper")).alias("upper"),
        status.alias("scenario_status"),
    )
