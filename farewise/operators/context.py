"""Train-only trip context per (zone, hour, weekend) with hierarchical fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farewise.functions.scalars import ntz, safe_div
from farewise.functions.skew import Quantile, exact_quantiles
from farewise.sources.tables import ContractError

KEYS = ["zone_id", "hour", "is_weekend"]
WANTED = (
    Quantile("distance_km", "trip_km", 0.5),
    Quantile("trip_seconds_p50", "trip_time", 0.5),
    Quantile("trip_seconds_p90", "trip_time", 0.9),
)
VALUES = ["sample_count", *[q.name for q in WANTED]]


def train_rows(silver: DataFrame, train_end: str) -> DataFrame:
    """Valid training trips with their hour and ISO weekend flag."""
    usable = F.col("valid_core") & F.col("valid_duration") & F.col("valid_distance")
    return silver.filter(usable & (F.col("pickup_datetime") < ntz(train_end))).select(
        F.col("PULocationID").alias("zone_id"),
        F.hour("pickup_datetime").alias("hour"),
        (F.weekday("pickup_datetime") >= 5).alias("is_weekend"),
        "trip_km",
        "trip_time",
    )


def context_levels(train: DataFrame) -> DataFrame:
    """Counts and quantiles at the four fallback levels (0 = finest, 3 = whole cluster)."""
    kept = F.posexplode(F.array(F.lit(3), F.lit(2), F.lit(1), F.lit(0))).alias("level", "n_keys")
    tagged = train.select("*", kept).withColumns(
        {k: F.when(F.col("n_keys") > i, F.col(k)) for i, k in enumerate(KEYS)}
    )
    rows = F.count(F.lit(1)).alias("sample_count")
    return exact_quantiles(tagged, ["level", *KEYS], WANTED, [rows]).select(
        "level", *KEYS, *VALUES
    )


def hierarchical_fallback(levels: DataFrame, zones: Sequence[int], min_n: int) -> DataFrame:
    """For every zone x hour x weekend the statistics of the finest level with enough trips.

    Each level row is expanded to the keys it can serve and the lowest level per key is kept:
    one aggregate over a few rows per key instead of one join per level.
    """
    serves = levels.filter(F.col("sample_count") >= min_n).select(
        "level",
        F.when(F.col("zone_id").isNull(), F.array(*[F.lit(int(z)) for z in zones])).otherwise(F.array("zone_id")).alias("zs"),
        F.when(F.col("hour").isNull(), F.sequence(F.lit(0), F.lit(23))).otherwise(F.array("hour")).alias("hs"),
        F.when(F.col("is_weekend").isNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array("is_weekend")).alias("ws"),
        F.struct(*VALUES).alias("v"),
    )
    keyed = (
        serves.withColumn("zone_id", F.explode("zs")).withColumn("hour", F.explode("hs"))
        .withColumn("is_weekend", F.explode("ws")).filter(F.col("zone_id").isin([int(z) for z in zones]))
    )
    best = keyed.groupBy(*KEYS).agg(F.min_by("v", "level").alias("v"), F.min("level").alias("fallback_level"))
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    asked = levels.sparkSession.createDataFrame([(int(z),) for z in dict.fromkeys(zones)], "zone_id int").select("zone_id", hours)
    asked = asked.withColumn("is_weekend", F.explode(F.array(F.lit(False), F.lit(True))))
    name = F.concat(F.lit("z"), "zone_id", F.lit("-h"), "hour", F.lit("-w"), F.col("is_weekend").cast("int"))
    # Every key is served by the whole-cluster level at least, unless even that is too thin.
    found = F.when(F.col("fallback_level").isNotNull(), name).otherwise(
        F.raise_error("too few valid training trips even for the whole cluster").cast("string")
    )
    return asked.join(best, KEYS, "left").select(*KEYS, *[F.col(f"v.{c}").alias(c) for c in VALUES], "fallback_level", found.alias("context_id"))


def minmax_scale(contexts: DataFrame, column: str, out: str) -> DataFrame:
    """(x - min) / (max - min) over the table, 0.5 when the column is constant.

    For the context table, which has one row per zone, hour and weekend flag.
    """
    whole = Window.partitionBy(F.lit(1))
    low, high = F.min(column).over(whole), F.max(column).over(whole)
    return contexts.withColumn(out, F.coalesce(safe_div(F.col(column) - low, high - low), F.lit(0.5)))


def fallback_histogram(contexts: DataFrame) -> DataFrame:
    """Contexts per fallback level and the distance range inside each level."""
    return contexts.groupBy("fallback_level").agg(
        F.count(F.lit(1)).alias("n_contexts"),
        F.min("distance_km").alias("min_distance_km"),
        F.max("distance_km").alias("max_distance_km"),
    )


def build_context(
    silver: DataFrame, *, zones: Sequence[int], train_end: str, min_n: int
) -> DataFrame:
    levels = context_levels(train_rows(silver, train_end))
    contexts = hierarchical_fallback(levels, zones, min_n)
    return minmax_scale(contexts, "distance_km", "distance_scaled")


def require_root(levels: DataFrame, min_n: int) -> None:
    """The whole-cluster level must itself have enough trips."""
    if not levels.filter((F.col("level") == 3) & (F.col("sample_count") >= min_n)).count():
        raise ContractError("too few valid training trips even for the whole cluster")
