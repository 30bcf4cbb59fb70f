"""Choice tables: block counts, sessions, calendar and encoded features, splits, folds, support."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewise.functions.scalars import any_of, is_finite, safe_div
from farewise.operators.quality import assert_unique, check_contract
from farewise.sources.tables import ContractError

# The three price levels, the truth-only column names and the base features.
PRICE_LEVELS = (0.9, 1.0, 1.1)
TRUTH_COLUMNS = ("u", "p_x", "p_y", "p_none", "b_x", "b_y", "theta", "true_probability")
BASE_FEATURES = ("hour_sin", "hour_cos", "is_weekend", "is_peak", "distance_scaled")

EXPAND_CHUNK = 10_000


def sessions_to_blocks(sessions: DataFrame, keys: Sequence[str], choice: str = "choice") -> DataFrame:
    """Block counts and shares from one labelled row per session; one partial aggregate."""
    label = F.col(choice)
    counted = sessions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.count_if(label == "X").alias("n_x"),
        F.count_if(label == "Y").alias("n_y"),
        F.count_if(label == "NONE").alias("n_none"),
    )
    return with_shares(counted)


def with_shares(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({f"q_{s}": safe_div(f"n_{s}", "n_sessions") for s in ("x", "y", "none")})


def blocks_to_sessions(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per session with its label and 0/1 indicators.

    A count is expanded in bounded chunks, so a block of any size never becomes one array.
    """
    labels = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("choice"), F.col(f"n_{s.lower()}").alias("n"))
                for s in ("X", "Y", "NONE")
            ]
        )
    ).alias("l")
    per_label = blocks.select(*keys, labels).select(*keys, "l.choice", "l.n").filter("n > 0")
    chunks = per_label.withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {EXPAND_CHUNK}")))
    )
    first = F.col("c") * EXPAND_CHUNK
    rows = chunks.withColumn(
        "i", F.explode(F.sequence(first, F.least(first + EXPAND_CHUNK, F.col("n")) - 1))
    )
    session = F.concat_ws("-", *[F.col(k).cast("string") for k in keys], "choice", F.col("i").cast("string"))
    indicators = {f"y_{s.lower()}": (F.col("choice") == s).cast("int") for s in ("X", "Y", "NONE")}
    return rows.select(*keys, "choice", session.alias("session_id")).withColumns(indicators)


def hour_features(hour: Column) -> dict[str, Column]:
    angle = hour * (2 * math.pi / 24)
    peak = ((hour >= 7) & (hour < 10)) | ((hour >= 16) & (hour < 20))
    return {"is_peak": peak.cast("int"), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle)}


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """Day id, fractional hour, weekday (Monday 0), weekend, peak and the hour on a circle."""
    hour = F.hour(ts) + F.minute(ts) / 60
    return df.withColumns(
        {
            "day_id": F.to_date(ts),
            "hour": hour,
            "weekday": F.weekday(ts),
            "is_weekend": (F.weekday(ts) >= 5).cast("int"),
            **hour_features(hour),
        }
    )


def observed_rules(columns: Sequence[str]) -> dict[str, Column]:
    """Bad-row conditions of an observed block table."""
    counts = [F.col(c) for c in ("n_x", "n_y", "n_none")]
    numeric = [c for c in ("log_multiplier_x", "log_multiplier_y", "q_x", "q_y", "n_x", "n_y", "n_none", "n_sessions") if c in columns]
    rules = {
        "nonfinite_value": any_of([~is_finite(c) for c in numeric]),
        "nonpositive_weight": ~F.coalesce(F.col("n_sessions") > 0, F.lit(False)),
        "negative_count": any_of([c < 0 for c in counts]),
        "noninteger_count": any_of([c != F.round(c) for c in (*counts, F.col("n_sessions"))]),
        "counts_do_not_conserve": (counts[0] + counts[1] + counts[2]) != F.col("n_sessions"),
        "shares_exceed_one": (F.col("q_x") < 0) | (F.col("q_y") < 0) | (F.col("q_x") + F.col("q_y") > 1 + 1e-12),
    }
    for s in ("x", "y", "none"):
        if f"q_{s}" in columns:
            ratio = safe_div(f"n_{s}", "n_sessions")
            rules[f"share_{s}_mismatch"] = F.abs(F.col(f"q_{s}") - ratio) > 1e-9 + 1e-9 * F.abs(ratio)
    return rules


def observed_violations(blocks: DataFrame) -> DataFrame:
    """Violations per rule; truth-only columns are refused outright."""
    leaked = sorted(set(TRUTH_COLUMNS) & {c.lower() for c in blocks.columns})
    if leaked:
        raise ContractError(f"truth columns in estimation input: {leaked}")
    return check_contract(blocks, observed_rules(blocks.columns))


def attach_context(blocks: DataFrame, contexts: DataFrame, hour: str = "hour") -> DataFrame:
    """Many-to-one join on (zone, hour, weekend); uncovered blocks are an error."""
    picked = contexts.select(
        F.col("zone_id").alias("_z"), F.col("hour").alias("_h"),
        F.col("is_weekend").cast("int").alias("_w"), "distance_scaled", "context_id", "fallback_level",
    )
    assert_unique(picked, ["_z", "_h", "_w"])
    on = (F.col("zone_id") == F.col("_z")) & (F.floor(hour) == F.col("_h")) & (F.col("is_weekend") == F.col("_w"))
    joined = blocks.join(picked, on, "left").drop("_z", "_h", "_w")
    if joined.filter(F.col("context_id").isNull()).limit(1).count():
        raise ContractError("context templates do not cover every block")
    return joined


def feature_names(zones: Sequence[int]) -> list[str]:
    return [*BASE_FEATURES, *[f"zone_{z}" for z in list(zones)[1:]], *[f"weekday_{d}" for d in range(1, 7)]]


def encode(df: DataFrame, zones: Sequence[int], check: bool = True) -> DataFrame:
    """Add one numeric column per feature under the fixed taxonomy."""
    if check:
        outside = ~F.col("zone_id").isin(list(zones)) | ~F.col("weekday").between(0, 6) | ~F.col("distance_scaled").between(0, 1)
        if df.filter(F.coalesce(outside, F.lit(True))).limit(1).count():
            raise ContractError("context outside the declared taxonomy or domain")
    dummies = {f"zone_{z}": (F.col("zone_id") == z).cast("double") for z in list(zones)[1:]}
    dummies |= {f"weekday_{d}": (F.col("weekday") == d).cast("double") for d in range(1, 7)}
    plain = {c: F.col(c).cast("double") for c in BASE_FEATURES}
    return df.withColumns({**plain, **dummies})


def date_splits(df: DataFrame, train_end: str, validation_end: str, day: str = "day_id") -> DataFrame:
    """Label each block train, validation or test by its date."""
    date = F.to_date(day)
    label = (
        F.when(date < F.lit(train_end).cast("date"), "train")
        .when(date < F.lit(validation_end).cast("date"), "validation")
        .otherwise("test")
    )
    return df.withColumn("split", label)


def split_summary(df: DataFrame, day: str = "day_id") -> DataFrame:
    """Blocks, days and day range of each split; disjoint ranges mean no leaked day."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.countDistinct(day).alias("n_days"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    )


def day_folds(df: DataFrame, k: int, day: str = "day_id") -> DataFrame:
    """(day, n_blocks, fold): days dealt to k folds largest first, back and forth.

    The ranking window runs over one row per calendar day.
    """
    days = df.groupBy(day).agg(F.count(F.lit(1)).alias("n_blocks"))
    place = F.row_number().over(Window.orderBy(F.desc("n_blocks"), day)) - 1
    turn, seat = F.floor(place / k), place % k
    fold = F.when(turn % 2 == 0, seat).otherwise(k - 1 - seat).cast("int")
    return days.withColumn("fold", fold)


def with_folds(df: DataFrame, k: int, day: str = "day_id") -> DataFrame:
    folds = day_folds(df, k, day).select(day, "fold")
    return df.join(folds, day)


def price_key(x: Column | str, y: Column | str) -> Column:
    as_int = [F.round((F.col(c) if isinstance(c, str) else c) * 1e6).cast("bigint").cast("string") for c in (x, y)]
    return F.concat_ws("/", *as_int)


def price_grid(df: DataFrame, levels: Sequence[float] = PRICE_LEVELS) -> DataFrame:
    """The joint price points as a table."""
    points = [(float(a), float(b)) for a in levels for b in levels]
    return df.sparkSession.createDataFrame(points, "multiplier_x double, multiplier_y double")


def price_support(df: DataFrame) -> DataFrame:
    """Blocks at each joint price point, zero kept."""
    seen = df.groupBy(price_key("multiplier_x", "multiplier_y").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    grid = price_grid(df).withColumn("k", price_key("multiplier_x", "multiplier_y"))
    return grid.join(seen, "k", "left").select(
        "multiplier_x", "multiplier_y", F.coalesce("n", F.lit(0)).alias("n_blocks")
    )


def active_treatments(df: DataFrame, columns: Sequence[str] = ("log_multiplier_x", "log_multiplier_y")) -> DataFrame:
    """(treatment, spread, active, constant): which log prices vary at all."""
    stats = [F.struct(F.lit(c).alias("treatment"), (F.max(c) - F.min(c)).alias("spread"), F.min(c).alias("low")) for c in columns]
    return (
        df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
        .select("treatment", "spread", (F.col("spread") > 1e-10).alias("active"), F.when(F.col("spread") <= 1e-10, F.col("low")).alias("constant"))
    )
