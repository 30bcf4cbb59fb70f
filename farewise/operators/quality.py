"""Trip cleaning: scope, enrichment, flags, validity, quality counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.functions.scalars import (
    all_of,
    any_of,
    is_finite,
    micros_between,
    ntz,
    seconds_between,
    total,
    true_or_false,
)
from farewise.sources.tables import FLAG_COLUMNS, TRIP_COLUMNS, ContractError, write_table

# License codes and their brand, and the mile in kilometres.
PLATFORMS = {"HV0003": "Uber", "HV0005": "Lyft"}
KM_PER_MILE = 1.609344
CORE_KEYS = ("pickup_datetime", "PULocationID", "hvfhs_license_num")
FARE_PARTS = (
    "base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee",
)
VALIDITY_FLAGS = (
    "valid_core", "valid_duration", "valid_distance", "valid_price", "valid_fare_transaction",
    "valid_driver_pay", "valid_wait", "duration_difference_warning", "unknown_pickup_zone",
    "unknown_dropoff_zone", "unknown_flag_value",
)

INLINE_LIST = 1000


def split_quarantine(df: DataFrame, required: Sequence[str] = CORE_KEYS) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined): a row missing any required key goes to the second table."""
    broken = any_of([F.col(c).isNull() for c in required])
    return df.filter(~broken), df.filter(broken)


def in_list(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Membership filter: a literal list while short, a semi-join to a table otherwise."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi")
    if len(values) <= INLINE_LIST:
        return df.filter(F.col(column).isin(list(values)))
    kind = df.schema[column].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {kind}")
    return df.join(table, column, "left_semi")


def scope_filter(df: DataFrame, start: str, end: str, zones, platforms) -> DataFrame:
    """Half-open pickup range plus zone and license lists; all three reach the scan."""
    timed = df.filter((F.col("pickup_datetime") >= ntz(start)) & (F.col("pickup_datetime") < ntz(end)))
    return in_list(in_list(timed, "PULocationID", zones), "hvfhs_license_num", platforms)


def enrich_zones(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Flag trips whose pickup or dropoff zone is absent from the dimension."""
    ids = zones.select(F.col("LocationID").alias("_zone")).distinct()
    for key, flag in (("PULocationID", "unknown_pickup_zone"), ("DOLocationID", "unknown_dropoff_zone")):
        df = (
            df.join(ids, F.col(key) == F.col("_zone"), "left")
            .withColumn(flag, F.col("_zone").isNull())
            .drop("_zone")
        )
    return df


def normalize_flags(df: DataFrame, columns: Sequence[str] = FLAG_COLUMNS) -> DataFrame:
    """Add `<flag>_normalized` (Y, N or NULL) and one OR of all unrecognised raw values."""
    clean = {c: F.upper(F.trim(c)) for c in columns}
    known = {c: clean[c].isin("Y", "N") for c in columns}
    return df.withColumns(
        {
            **{f"{c}_normalized": F.when(known[c], clean[c]) for c in columns},
            "unknown_flag_value": any_of([F.col(c).isNotNull() & ~known[c] for c in columns]),
        }
    )


def derive_trip(df: DataFrame, slot_minutes: int = 30) -> DataFrame:
    """Platform, local date, slot start, kilometres, wait and computed trip seconds."""
    license_no, pickup = F.col("hvfhs_license_num"), F.col("pickup_datetime")
    platform = F.lit(None).cast("string")
    for code, brand in PLATFORMS.items():
        platform = F.when(license_no == code, brand).otherwise(platform)
    return df.withColumns(
        {
            "platform": platform,
            "pickup_date_local": F.to_date(pickup),
            "slot_start_local": slot_start(pickup, slot_minutes),
            "trip_km": F.col("trip_miles") * F.lit(KM_PER_MILE),
            "request_to_pickup_seconds": F.when(
                F.col("request_datetime") <= pickup, seconds_between("request_datetime", pickup)
            ),
            "computed_trip_seconds": seconds_between(pickup, "dropoff_datetime"),
        }
    )


def slot_start(ts: Column, minutes: int) -> Column:
    """Start of the slot holding `ts`, counted from local midnight."""
    elapsed = F.hour(ts) * 60 + F.minute(ts)
    return F.timestamp_add("MINUTE", elapsed - elapsed % minutes, F.to_date(ts).cast("timestamp_ntz"))


def validity_flags(df: DataFrame, warn_seconds: float = 60.0) -> DataFrame:
    """Seven independent validity booleans and the duration-difference warning."""
    fare = F.col("base_passenger_fare")
    gap = F.abs(F.col("trip_time") - micros_between("pickup_datetime", "dropoff_datetime") / 1e6)
    return df.withColumns(
        {
            "valid_core": F.lit(True),
            "valid_duration": true_or_false(
                (F.col("trip_time") > 0) & (F.col("dropoff_datetime") >= F.col("pickup_datetime"))
            ),
            "valid_distance": is_finite("trip_miles") & true_or_false(F.col("trip_miles") >= 0),
            "valid_price": is_finite(fare) & true_or_false(fare > 0),
            "valid_fare_transaction": is_finite(fare),
            "valid_driver_pay": is_finite("driver_pay"),
            "valid_wait": true_or_false(F.col("request_datetime") <= F.col("pickup_datetime")),
            "duration_difference_warning": true_or_false(gap > warn_seconds),
        }
    )


def finite_sum(columns: Sequence[str]) -> Column:
    """Sum of the components when every one is finite, else NULL."""
    return F.when(all_of([is_finite(c) for c in columns]), total([F.col(c) for c in columns]))


def build_silver(
    raw: DataFrame,
    zones: DataFrame,
    *,
    start: str,
    end: str,
    zone_ids,
    platforms,
    slot_minutes: int = 30,
    warn_seconds: float = 60.0,
    source_id: str = "trips",
) -> DataFrame:
    """Scoped trips with all derived columns; one scan, no shuffle (broadcast dimension)."""
    good, _ = split_quarantine(raw)
    scoped = scope_filter(good, start, end, zone_ids, platforms)
    flagged = normalize_flags(enrich_zones(scoped, zones))
    return validity_flags(derive_trip(flagged, slot_minutes), warn_seconds).withColumns(
        {
            "source_id": F.lit(source_id),
            "source_kind": F.lit("observed_tlc"),
            "passenger_components_excluding_tips_usd": finite_sum(FARE_PARTS),
        }
    )


def write_silver(silver: DataFrame, path: str) -> DataFrame:
    """Store silver by local date and read it back, so later date filters prune partitions.

    Rows are rebalanced by date first: a day lands in few files, and a day that holds far more
    rows than the others is split over several tasks.
    """
    balanced = silver.hint("rebalance", "pickup_date_local")
    write_table(balanced, path, partition_by=("pickup_date_local",))
    return silver.sparkSession.read.schema(silver.schema).parquet(path).select(*silver.columns)


def quality_report(df: DataFrame, columns: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """(metric, count, denominator): NULLs per column and trues per flag in one pass."""
    aggregates = [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in columns]
    aggregates += [F.count_if(F.col(f)).alias(f"flag:{f}") for f in flags]
    row = df.agg(F.count(F.lit(1)).alias("denominator"), *aggregates)
    return row.unpivot(
        ["denominator"], [c for c in row.columns if c != "denominator"], "metric", "count"
    ).select("metric", "count", "denominator")


def duplicate_groups(df: DataFrame, columns: Sequence[str] = TRIP_COLUMNS) -> DataFrame:
    """Number of repeated contents and of rows in them; nothing is removed.

    Rows meet as a 64-bit hash first; whole rows are compared only where a hash occurs twice.
    """
    picked = df.select(*columns).withColumn("_hash", F.xxhash64(*columns))
    twice = picked.groupBy("_hash").count().filter("count > 1").select("_hash")
    return (
        picked.join(twice, "_hash", "left_semi")
        .groupBy(*columns)
        .count()
        .filter("count > 1")
        .agg(
            F.count(F.lit(1)).alias("duplicate_groups"),
            F.coalesce(F.sum("count"), F.lit(0)).alias("rows_in_groups"),
        )
    )


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if key_violations(df, keys).limit(1).count():
        raise ContractError(f"duplicate key over {list(keys)}")
    return df


def profile_table(df: DataFrame) -> DataFrame:
    """(column, missing, infinite) in one pass; NaN counts as missing."""
    if any(not c.strip() for c in df.columns) or len(set(df.columns)) != len(df.columns):
        raise ContractError("column names must be unique and non-empty")
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    parts = []
    for c in df.columns:
        missing = F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()
        infinite = F.abs(F.col(c)) == float("inf") if c in floats else F.lit(False)
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(missing).alias("missing"),
                F.count_if(infinite).alias("infinite"),
            )
        )
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def check_contract(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations): each rule is a condition that marks a BAD row; NULL is not bad."""
    row = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    return row.unpivot([], list(rules), "rule", "violations")


def require_clean(violations: DataFrame) -> None:
    """Raise when a violations table (a handful of rows) reports anything."""
    broken = {r["rule"]: r["violations"] for r in violations.filter("violations > 0").collect()}
    if broken:
        raise ContractError(f"broken rules: {broken}")


def filtered(df: DataFrame, filters: Mapping[str, object], start=None, end=None, date_column="day") -> DataFrame:
    """Equality filters plus an inclusive date range."""
    for column, value in filters.items():
        df = df.filter(F.col(column) == F.lit(value))
    if start is not None:
        df = df.filter(F.to_date(date_column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.to_date(date_column) <= F.lit(end).cast("date"))
    return df


def table_page(
    df: DataFrame, filters: Mapping[str, object], order: Sequence[str], offset: int, limit: int,
    start=None, end=None, date_column="day",
) -> DataFrame:
    """One page of the filtered table in key order, each row carrying the total row count."""
    rows = filtered(df, filters, start, end, date_column)
    total_rows = rows.agg(F.count(F.lit(1)).alias("total_rows")).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total_rows", total_rows)


def filtered_totals(
    df: DataFrame, filters: Mapping[str, object], columns: Sequence[str], start=None, end=None,
    date_column="day",
) -> DataFrame:
    rows = filtered(df, filters, start, end, date_column)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def union_results(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Concatenate per-job results by name; a repeated key is an error."""
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    return assert_unique(combined, keys)


def incomplete_cells(df: DataFrame, cell: Sequence[str], expected_rows: int) -> DataFrame:
    """Cells whose number of result rows differs from what every job must deliver."""
    return df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") != expected_rows)
