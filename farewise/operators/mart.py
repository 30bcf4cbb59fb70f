"""Slot mart: counts, quantiles, shares on a dense grid, with suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.functions.scalars import any_of, ntz, safe_div
from farewise.functions.skew import Quantile, exact_quantiles
from farewise.operators.quality import PLATFORMS
from farewise.sources.tables import ContractError

KEYS = ["zone_id", "slot_start_local", "platform"]

# Published metric, its denominator, its suppression flag, its quantiles.
METRICS = (
    ("trip_seconds", "n_valid_duration", "low_duration_sample", ("trip_seconds_p50", "trip_seconds_p90")),
    ("trip_km", "n_valid_distance", "low_distance_sample", ("trip_km_p50",)),
    ("base_fare", "n_valid_fare_transaction", "low_fare_sample", ("base_fare_usd_p50",)),
    ("driver_pay", "n_valid_driver_pay", "low_driver_pay_sample", ("driver_pay_usd_p50",)),
    ("request_to_pickup", "n_valid_wait", "low_wait_sample", ("request_to_pickup_p50", "request_to_pickup_p90")),
)
QUANTILES = (
    Quantile("trip_seconds_p50", "trip_time", 0.5, "valid_duration"),
    Quantile("trip_seconds_p90", "trip_time", 0.9, "valid_duration"),
    Quantile("trip_km_p50", "trip_km", 0.5, "valid_distance"),
    Quantile("base_fare_usd_p50", "base_passenger_fare", 0.5, "valid_fare_transaction"),
    Quantile("driver_pay_usd_p50", "driver_pay", 0.5, "valid_driver_pay"),
    Quantile("request_to_pickup_p50", "request_to_pickup_seconds", 0.5, "valid_wait"),
    Quantile("request_to_pickup_p90", "request_to_pickup_seconds", 0.9, "valid_wait"),
)
COUNT_FLAGS = {
    "completed_trip_count": "valid_core",
    "n_valid_duration": "valid_duration",
    "n_valid_distance": "valid_distance",
    "n_valid_price": "valid_price",
    "n_valid_fare_transaction": "valid_fare_transaction",
    "n_valid_driver_pay": "valid_driver_pay",
    "n_valid_wait": "valid_wait",
}


def _keyed(silver: DataFrame) -> DataFrame:
    return silver.withColumn("zone_id", F.col("PULocationID"))


def count_aggregates() -> list[Column]:
    warned = any_of(
        [F.col(c) for c in ("unknown_dropoff_zone", "unknown_flag_value", "duration_difference_warning")]
    )
    counts = [F.count_if(F.col(flag)).alias(name) for name, flag in COUNT_FLAGS.items()]
    return [*counts, F.count_if(warned).alias("quality_warning_count")]


def share_aggregates() -> list[Column]:
    out = []
    for name in ("shared_request", "shared_match"):
        flag = F.col(f"{name}_flag_normalized")
        out.append(F.count(flag).alias(f"n_{name}_known"))
        out.append(F.avg((flag == "Y").cast("double")).alias(f"{name}_share"))
    return out


def slot_counts(silver: DataFrame) -> DataFrame:
    """Completed trips, one denominator per metric and warned trips for each cell."""
    return _keyed(silver).groupBy(*KEYS).agg(*count_aggregates())


def slot_quantiles(silver: DataFrame, approx: bool = False) -> DataFrame:
    """Interpolated medians and p90s over each metric's own valid rows."""
    rows = _keyed(silver)
    if approx:
        return rows.groupBy(*KEYS).agg(
            *[F.percentile_approx(q.source, q.prob).alias(q.name) for q in QUANTILES]
        )
    return exact_quantiles(rows, KEYS, QUANTILES)


def slot_shares(silver: DataFrame) -> DataFrame:
    """Known shared-ride flags per cell and the Y share among the known ones."""
    return _keyed(silver).groupBy(*KEYS).agg(*share_aggregates())


def slot_aggregates(silver: DataFrame) -> DataFrame:
    """All cell aggregates, quantiles included."""
    extra = [*count_aggregates(), *share_aggregates()]
    return exact_quantiles(_keyed(silver), KEYS, QUANTILES, extra)


def dense_grid(
    spark: SparkSession, zones: Sequence[int], start: str, end: str, minutes: int, platforms: Sequence[str]
) -> DataFrame:
    """Every (zone, slot, platform) cell of the half-open range, grown by explodes."""
    names = [PLATFORMS.get(p, p) for p in platforms]
    slots = F.sequence(ntz(start), ntz(end), F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    return (
        spark.createDataFrame([(int(z),) for z in zones], "zone_id int")
        .withColumn("slot_start_local", F.explode(slots))
        .filter(F.col("slot_start_local") < ntz(end))
        .withColumn("platform", F.explode(F.array(*[F.lit(n) for n in names])))
    )


def fill_grid(grid: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Join one-to-one; absent counts become 0, absent quantiles and shares stay NULL.

    Trips of a cell outside the grid would not reconcile with silver; they fail the job.
    """
    counts = [
        c
        for c in aggregates.columns
        if c.startswith("n_") or c in ("completed_trip_count", "quality_warning_count")
    ]
    joined = grid.withColumn("_cell", F.lit(True)).join(aggregates, KEYS, "full_outer")
    listed = F.when(F.col("_cell"), F.col("platform")).otherwise(F.raise_error("trips outside the mart's grid").cast("string"))
    return joined.withColumn("platform", listed).drop("_cell").fillna(0, subset=counts)


def invalid_share(mart: DataFrame) -> DataFrame:
    """1 - valid / completed for each metric; NULL in empty cells."""
    return mart.withColumns(
        {
            f"{metric}_invalid_or_missing_share": 1 - safe_div(n, "completed_trip_count")
            for metric, n, _, _ in METRICS
        }
    )


def suppress_low_n(mart: DataFrame, min_n: int) -> DataFrame:
    """Flag thin samples and blank their quantiles; counts stay."""
    out = {}
    for _, n, low, quantiles in METRICS:
        thin = F.col(n) < min_n
        out[low] = thin
        for q in quantiles:
            if q in mart.columns:
                out[q] = F.when(~thin, F.col(q))
    return mart.withColumns(out)


def reconcile(mart: DataFrame, silver: DataFrame) -> DataFrame:
    """One row: trips in the mart, trips in silver, whether they agree."""
    expected = silver.agg(F.count_if("valid_core")).scalar()
    return mart.agg(F.coalesce(F.sum("completed_trip_count"), F.lit(0)).alias("mart_total")).select(
        "mart_total",
        expected.alias("silver_total"),
        (F.col("mart_total") == expected).alias("reconciled"),
    )


def build_mart(
    silver: DataFrame,
    *,
    zones: Sequence[int],
    start: str,
    end: str,
    minutes: int,
    platforms: Sequence[str],
    min_n: int,
) -> DataFrame:
    """Complete suppressed mart: aggregate once, then join the (small) grid."""
    shown = silver.filter(F.col("pickup_datetime") < ntz(end))
    grid = dense_grid(silver.sparkSession, zones, start, end, minutes, platforms)
    filled = fill_grid(grid, slot_aggregates(shown))
    return suppress_low_n(invalid_share(filled), min_n).withColumn(
        "source_kind", F.lit("observed_tlc")
    )


def require_reconciled(mart: DataFrame, silver: DataFrame) -> None:
    row = reconcile(mart, silver).first()
    if not row["reconciled"]:
        raise ContractError(f"mart holds {row['mart_total']} of {row['silver_total']} trips")
