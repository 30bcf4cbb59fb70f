"""Registered queries: trip cleaning, slot mart, context templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.operators import context, mart, quality
from farewise.plans.catalogue import query, shown, sql_shown
from farewise.session import scratch_path
from farewise.sources import bindings, tables
from farewise.sources.bindings import with_views

START, END, TRAIN_END = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-01-21 00:00:00"
ZONES, PLATFORM_CODES, MINUTES, MIN_N = [0, 1, 2, 3, 4], ["HV0003", "HV0005"], 30, 2

LINE_CONTRACT = {
    **dict.fromkeys(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "integer"),
    **dict.fromkeys(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "float"),
    **dict.fromkeys(("l_returnflag", "l_linestatus"), "string"),
    "l_shipdate": "timestamp",
}


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.build_silver(
        bindings.trips(spark, sf_dir), bindings.zones(spark, sf_dir),
        start=START, end=END, zone_ids=ZONES, platforms=PLATFORM_CODES, slot_minutes=MINUTES,
    )


def _yn(c: str) -> str:
    return f"CASE WHEN UPPER(TRIM({c})) IN ('Y', 'N') THEN UPPER(TRIM({c})) END AS {c}_normalized"


_UNKNOWN = " OR ".join(
    f"({c} IS NOT NULL AND UPPER(TRIM({c})) NOT IN ('Y', 'N'))" for c in tables.FLAG_COLUMNS
)
SILVER = f"""
SELECT t.*, CASE hvfhs_license_num WHEN 'HV0003' THEN 'Uber' WHEN 'HV0005' THEN 'Lyft' END AS platform,
  CAST(pickup_datetime AS DATE) AS pickup_date_local,
  TIME_BUCKET(INTERVAL '30 minutes', pickup_datetime) AS slot_start_local,
  trip_miles * 1.609344 AS trip_km,
  CASE WHEN request_datetime <= pickup_datetime
    THEN DATE_DIFF('microsecond', request_datetime, pickup_datetime) / 1000000.0::DOUBLE END AS request_to_pickup_seconds,
  DATE_DIFF('microsecond', pickup_datetime, dropoff_datetime) / 1000000.0::DOUBLE AS computed_trip_seconds,
  TRUE AS valid_core,
  COALESCE(trip_time > 0 AND dropoff_datetime >= pickup_datetime, FALSE) AS valid_duration,
  COALESCE(trip_miles >= 0 AND ISFINITE(trip_miles), FALSE) AS valid_distance,
  COALESCE(base_passenger_fare > 0 AND ISFINITE(base_passenger_fare), FALSE) AS valid_price,
  COALESCE(ISFINITE(base_passenger_fare), FALSE) AS valid_fare_transaction,
  COALESCE(ISFINITE(driver_pay), FALSE) AS valid_driver_pay,
  COALESCE(request_datetime <= pickup_datetime, FALSE) AS valid_wait,
  COALESCE(ABS(trip_time - DATE_DIFF('microsecond', pickup_datetime, dropoff_datetime) / 1000000.0) > 60, FALSE)
    AS duration_difference_warning,
  pz.LocationID IS NULL AS unknown_pickup_zone, dz.LocationID IS NULL AS unknown_dropoff_zone,
  ({_UNKNOWN}) AS unknown_flag_value, {", ".join(_yn(c) for c in tables.FLAG_COLUMNS)},
  CASE WHEN ISFINITE(base_passenger_fare) AND ISFINITE(tolls) AND ISFINITE(bcf) AND ISFINITE(sales_tax)
      AND ISFINITE(congestion_surcharge) AND ISFINITE(airport_fee)
    THEN base_passenger_fare + tolls + bcf + sales_tax + congestion_surcharge + airport_fee END
    AS passenger_components_excluding_tips_usd
FROM trips t LEFT JOIN zones pz ON t.PULocationID = pz.LocationID LEFT JOIN zones dz ON t.DOLocationID = dz.LocationID
WHERE pickup_datetime >= TIMESTAMP '{START}' AND pickup_datetime < TIMESTAMP '{END}'
  AND PULocationID IN (0, 1, 2, 3, 4) AND hvfhs_license_num IN ('HV0003', 'HV0005')"""


def on_silver(body: str, **extra: str) -> str:
    return with_views(body, "trips", "zones", silver=SILVER, **extra)


def on_trips(body: str) -> str:
    return with_views(body, "trips", "zones")


# --- sources and quality ------------------------------------------------------------------

@query("A01_read_trips", "SELECT COUNT(*) AS n_rows, 24::BIGINT AS n_columns FROM lineitem")
def a01(spark, sf):
    tables.read_contract(spark, f"{sf}/lineitem.parquet", LINE_CONTRACT)
    trips = tables.check_schema(bindings.trips(spark, sf), tables.TRIP_CONTRACT)
    return trips.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(trips.columns)).cast("bigint").alias("n_columns")
    )


@query("A02_read_zones", with_views('SELECT LocationID::BIGINT AS LocationID, Borough, "Zone", service_zone FROM zones', "zones"))
def a02(spark, sf):
    path = tables.write_table(bindings.zones(spark, sf), scratch_path(spark, "zones"), "csv")
    return shown(tables.read_zones(spark, path))


@query("A03_with_row_id", "SELECT COUNT(*) AS n_rows, COUNT(*) AS n_ids, 0::BIGINT AS first_row, COUNT(*) - 1 AS last_row FROM lineitem")
def a03(spark, sf):
    ids = tables.with_row_id(bindings.table(spark, sf, "lineitem"), "lines").select("trip_row_id")
    number = F.split("trip_row_id", ":")[1].cast("bigint")
    per_id = ids.groupBy("trip_row_id").count()
    return per_id.agg(
        F.sum("count").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"),
        F.min(number).alias("first_row"), F.max(number).alias("last_row"),
    )


@query("A04_write_table", sql_shown(on_silver("SELECT pickup_date_local AS day, COUNT(*) AS n, SUM(driver_pay) AS pay FROM silver GROUP BY 1"), {"day": "t", "n": "i", "pay": "r7"}))
def a04(spark, sf):
    kept = silver(spark, sf).select("pickup_date_local", "driver_pay")
    path = tables.write_table(kept, scratch_path(spark, "silver"), partition_by=("pickup_date_local",))
    back = tables.read_table(spark, path, kept.schema)
    daily = back.groupBy(F.col("pickup_date_local").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("driver_pay").alias("pay")
    )
    csv = tables.write_table(daily, scratch_path(spark, "daily"), "csv")
    return shown(tables.read_table(spark, csv, daily.schema, "csv"), 7)


_CORE_NULL = "pickup_datetime IS NULL OR PULocationID IS NULL OR hvfhs_license_num IS NULL"


@query("A05_split_quarantine", on_trips(f"SELECT COUNT(*) FILTER (WHERE NOT ({_CORE_NULL})) AS usable, COUNT(*) FILTER (WHERE {_CORE_NULL}) AS quarantined FROM trips"))
def a05(spark, sf):
    good, bad = quality.split_quarantine(bindings.trips(spark, sf))
    tagged = good.select(F.lit(1).alias("ok")).unionAll(bad.select(F.lit(0).alias("ok")))
    return tagged.agg(F.count_if(F.col("ok") == 1).alias("usable"), F.count_if(F.col("ok") == 0).alias("quarantined"))


@query("A06_scope_filter", sql_shown(on_trips(f"""SELECT PULocationID AS zone_id, hvfhs_license_num AS license, COUNT(*) AS n, MIN(pickup_datetime) AS first_pickup, MAX(pickup_datetime) AS last_pickup
FROM trips WHERE pickup_datetime >= TIMESTAMP '{START}' AND pickup_datetime < TIMESTAMP '{TRAIN_END}' AND PULocationID IN (0, 1, 2, 3, 4)
AND hvfhs_license_num IN ('HV0003', 'HV0005') GROUP BY 1, 2"""), {"zone_id": "i", "license": "", "n": "i", "first_pickup": "t", "last_pickup": "t"}))
def a06(spark, sf):
    scoped = quality.scope_filter(bindings.trips(spark, sf), START, TRAIN_END, ZONES, PLATFORM_CODES)
    return shown(
        scoped.groupBy(F.col("PULocationID").alias("zone_id"), F.col("hvfhs_license_num").alias("license")).agg(
            F.count(F.lit(1)).alias("n"), F.min("pickup_datetime").alias("first_pickup"), F.max("pickup_datetime").alias("last_pickup")
        )
    )


@query("A07_enrich_zones", on_trips("""SELECT DOLocationID::BIGINT AS zone_id, pz.LocationID IS NULL AS unknown_pickup_zone, dz.LocationID IS NULL AS unknown_dropoff_zone, COUNT(*) AS n
FROM trips LEFT JOIN zones pz ON PULocationID = pz.LocationID LEFT JOIN zones dz ON DOLocationID = dz.LocationID GROUP BY 1, 2, 3"""))
def a07(spark, sf):
    flagged = quality.enrich_zones(bindings.trips(spark, sf), bindings.zones(spark, sf))
    keys = [F.col("DOLocationID").cast("bigint").alias("zone_id"), "unknown_pickup_zone", "unknown_dropoff_zone"]
    return flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("A08_normalize_flags", on_trips(f"""SELECT shared_request_flag AS raw, {_yn("shared_request_flag")}, {_yn("shared_match_flag")}, {_yn("wav_match_flag")},
({_UNKNOWN}) AS unknown_flag_value, COUNT(*) AS n FROM trips GROUP BY ALL"""))
def a08(spark, sf):
    flags = quality.normalize_flags(bindings.trips(spark, sf))
    return flags.groupBy(
        F.col("shared_request_flag").alias("raw"), "shared_request_flag_normalized", "shared_match_flag_normalized",
        "wav_match_flag_normalized", "unknown_flag_value",
    ).agg(F.count(F.lit(1)).alias("n"))


_DERIVED = {"platform": "", "pickup_date_local": "t", "slot_start_local": "t", "trip_km": "r", "request_to_pickup_seconds": "r", "computed_trip_seconds": "r"}
_VALID = {c: "" for c in quality.VALIDITY_FLAGS[:8]}


@query("A09_derive_trip", sql_shown(on_silver(f"SELECT {', '.join(_DERIVED)} FROM silver"), _DERIVED))
def a09(spark, sf):
    return shown(silver(spark, sf).select(*_DERIVED))


@query("A10_validity_flags", on_silver(f"SELECT {', '.join(_VALID)}, COUNT(*) AS n FROM silver GROUP BY ALL"))
def a10(spark, sf):
    return silver(spark, sf).groupBy(*_VALID).agg(F.count(F.lit(1)).alias("n"))


@query("A11_finite_sum", sql_shown(on_silver("SELECT PULocationID AS zone_id, COUNT(passenger_components_excluding_tips_usd) AS n_known, SUM(passenger_components_excluding_tips_usd) AS total FROM silver GROUP BY 1"), {"zone_id": "i", "n_known": "i", "total": "r4"}))
def a11(spark, sf):
    c = "passenger_components_excluding_tips_usd"
    return shown(silver(spark, sf).groupBy(F.col("PULocationID").alias("zone_id")).agg(F.count(c).alias("n_known"), F.sum(c).alias("total")), 4)


_REPORT = [f"SELECT 'null:{c}' AS metric, COUNT(*) FILTER (WHERE {c} IS NULL) AS count, COUNT(*) AS denominator FROM silver" for c in tables.TRIP_COLUMNS]
_REPORT += [f"SELECT 'flag:{c}', COUNT(*) FILTER (WHERE {c}), COUNT(*) FROM silver" for c in quality.VALIDITY_FLAGS]


@query("A12_quality_report", on_silver(" UNION ALL ".join(_REPORT)))
def a12(spark, sf):
    return quality.quality_report(silver(spark, sf), tables.TRIP_COLUMNS, quality.VALIDITY_FLAGS)


@query("A13_duplicate_groups", "SELECT COUNT(*) AS duplicate_groups, COALESCE(SUM(n), 0)::BIGINT AS rows_in_groups FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)")
def a13(spark, sf):
    return quality.duplicate_groups(bindings.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("A13_duplicate_trips", on_trips(f"SELECT COUNT(*) AS duplicate_groups, COALESCE(SUM(n), 0)::BIGINT AS rows_in_groups FROM (SELECT COUNT(*) AS n FROM trips GROUP BY {', '.join(tables.TRIP_COLUMNS)} HAVING COUNT(*) > 1)"))
def a13_trips(spark, sf):
    return quality.duplicate_groups(bindings.trips(spark, sf))


@query("A14_assert_unique", "SELECT l_orderkey, l_suppkey, COUNT(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def a14(spark, sf):
    return quality.key_violations(bindings.table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("A15_profile_table", on_trips(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing, {'COUNT(*) FILTER (WHERE ISINF(' + c + '))' if c in tables.FLOAT_COLUMNS else '0::BIGINT'} AS infinite FROM trips" for c in tables.TRIP_COLUMNS)))
def a15(spark, sf):
    return quality.profile_table(bindings.trips(spark, sf))


def _trip_rules():
    return {
        "negative_distance": F.col("trip_miles") < 0,
        "negative_fare": F.col("base_passenger_fare") < 0,
        "pickup_before_request": F.col("pickup_datetime") < F.col("request_datetime"),
        "dropoff_before_pickup": F.col("dropoff_datetime") < F.col("pickup_datetime"),
        "missing_tolls": F.col("tolls").isNull(),
    }


@query("A16_check_contract", on_trips("""SELECT 'negative_distance' AS rule, COUNT(*) FILTER (WHERE trip_miles < 0) AS violations FROM trips
UNION ALL SELECT 'negative_fare', COUNT(*) FILTER (WHERE base_passenger_fare < 0) FROM trips
UNION ALL SELECT 'pickup_before_request', COUNT(*) FILTER (WHERE pickup_datetime < request_datetime) FROM trips
UNION ALL SELECT 'dropoff_before_pickup', COUNT(*) FILTER (WHERE dropoff_datetime < pickup_datetime) FROM trips
UNION ALL SELECT 'missing_tolls', COUNT(*) FILTER (WHERE tolls IS NULL) FROM trips"""))
def a16(spark, sf):
    return quality.check_contract(bindings.trips(spark, sf), _trip_rules())


_DAILY = "SELECT PULocationID AS zone_id, platform, pickup_date_local AS day, COUNT(*) AS n, COUNT(*) FILTER (WHERE valid_wait) AS n_wait FROM silver GROUP BY 1, 2, 3"


def _daily(spark, sf):
    return silver(spark, sf).groupBy(F.col("PULocationID").alias("zone_id"), "platform", F.col("pickup_date_local").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid_wait").alias("n_wait")
    )


@query("A17_table_page", sql_shown(on_silver("SELECT *, COUNT(*) OVER () AS total_rows FROM daily WHERE zone_id = 2 AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY day, platform LIMIT 10 OFFSET 5", daily=_DAILY), {"zone_id": "i", "platform": "", "day": "t", "n": "i", "n_wait": "i", "total_rows": "i"}))
def a17(spark, sf):
    return shown(quality.table_page(_daily(spark, sf), {"zone_id": 2}, ["day", "platform"], 5, 10, "2024-01-05", "2024-01-20"))


@query("A18_filtered_totals", on_silver("SELECT COALESCE(SUM(n), 0)::BIGINT AS n, COALESCE(SUM(n_wait), 0)::BIGINT AS n_wait FROM daily WHERE zone_id = 2 AND platform = 'Uber' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'", daily=_DAILY))
def a18(spark, sf):
    return quality.filtered_totals(_daily(spark, sf), {"zone_id": 2, "platform": "Uber"}, ["n", "n_wait"], "2024-01-05", "2024-01-20")


@query("A19_union_results", sql_shown(on_silver("SELECT 'zone' AS job, PULocationID AS id, COUNT(*) AS n, NULL::DOUBLE AS pay FROM silver GROUP BY 2 UNION ALL SELECT 'day', EXTRACT(DAY FROM pickup_date_local), COUNT(*), SUM(driver_pay) FROM silver GROUP BY 2"), {"job": "", "id": "i", "n": "i", "pay": "r7"}))
def a19(spark, sf):
    base = silver(spark, sf)
    by_zone = base.groupBy(F.col("PULocationID").cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    by_day = base.groupBy(F.day("pickup_date_local").cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("driver_pay").alias("pay"))
    frames = [by_zone.withColumn("job", F.lit("zone")), by_day.withColumn("job", F.lit("day"))]
    return shown(quality.union_results(frames, ["job", "id"]).select("job", "id", "n", "pay"), 7)


# --- slot mart ----------------------------------------------------------------------------

_B_COUNTS = ", ".join(f"COUNT(*) FILTER (WHERE {f}) AS {n}" for n, f in mart.COUNT_FLAGS.items()) + (
    ", COUNT(*) FILTER (WHERE unknown_dropoff_zone OR unknown_flag_value OR duration_difference_warning) AS quality_warning_count"
)
_B_SHARES = ", ".join(
    f"COUNT({n}_flag_normalized) AS n_{n}_known, AVG(CAST({n}_flag_normalized = 'Y' AS DOUBLE)) AS {n}_share"
    for n in ("shared_request", "shared_match")
)
_B_QUANTS = ", ".join(f"QUANTILE_CONT({q.value}, {q.prob}) FILTER (WHERE {q.valid}) AS {q.name}" for q in mart.QUANTILES)
_CELL = "PULocationID AS zone_id, slot_start_local, platform"
_KEY_KINDS = {"zone_id": "i", "slot_start_local": "t", "platform": ""}
_COUNT_KINDS = {**{n: "i" for n in mart.COUNT_FLAGS}, "quality_warning_count": "i"}
_SHARE_KINDS = {"n_shared_request_known": "i", "shared_request_share": "r", "n_shared_match_known": "i", "shared_match_share": "r"}
_QUANT_KINDS = {q.name: "r8" for q in mart.QUANTILES}
_AGG = f"SELECT {_CELL}, {_B_COUNTS}, {_B_SHARES}, {_B_QUANTS} FROM silver GROUP BY 1, 2, 3"
_GRID = f"""SELECT z AS zone_id, s AS slot_start_local, p AS platform FROM (SELECT UNNEST([0, 1, 2, 3, 4]) AS z)
CROSS JOIN (SELECT UNNEST(RANGE(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL '30 minutes')) AS s) CROSS JOIN (SELECT UNNEST(['Uber', 'Lyft']) AS p)"""
_FILLED = "SELECT g.*, " + ", ".join(
    [f"COALESCE(a.{c}, 0) AS {c}" for c in (*mart.COUNT_FLAGS, "quality_warning_count", "n_shared_request_known", "n_shared_match_known")]
    + [f"a.{c}" for c in ("shared_request_share", "shared_match_share", *_QUANT_KINDS)]
) + " FROM grid g LEFT JOIN agg a USING (zone_id, slot_start_local, platform)"
_SHARE_OUT = ", ".join(f"1 - {n} / NULLIF(completed_trip_count, 0)::DOUBLE AS {m}_invalid_or_missing_share" for m, n, _, _ in mart.METRICS)
_MART = (
    "SELECT zone_id, slot_start_local, platform, " + ", ".join([*mart.COUNT_FLAGS, "quality_warning_count", *_SHARE_KINDS]) + f", {_SHARE_OUT}, "
    + ", ".join([f"{n} < {MIN_N} AS {low}" for _, n, low, _ in mart.METRICS] + [f"CASE WHEN {n} >= {MIN_N} THEN {q} END AS {q}" for _, n, _, qs in mart.METRICS for q in qs])
    + " FROM filled"
)
_MART_KINDS = {**_KEY_KINDS, **_COUNT_KINDS, **{c: k.replace("r", "r8") for c, k in _SHARE_KINDS.items()}, **_QUANT_KINDS, **{f"{m}_invalid_or_missing_share": "r8" for m, *_ in mart.METRICS}, **{low: "" for _, _, low, _ in mart.METRICS}}
_MART_CTES = {"grid": _GRID, "agg": _AGG, "filled": _FILLED}


@query("B01_slot_counts", sql_shown(on_silver(f"SELECT {_CELL}, {_B_COUNTS} FROM silver GROUP BY 1, 2, 3"), {**_KEY_KINDS, **_COUNT_KINDS}))
def b01(spark, sf):
    return shown(mart.slot_counts(silver(spark, sf)))


@query("B02_slot_quantiles", sql_shown(on_silver(f"SELECT {_CELL}, {_B_QUANTS} FROM silver GROUP BY 1, 2, 3"), {**_KEY_KINDS, **_QUANT_KINDS}))
def b02(spark, sf):
    return shown(mart.slot_quantiles(silver(spark, sf)), 8)


@query("B02_slot_quantiles_split_groups", sql_shown(on_silver(f"SELECT {_CELL}, {_B_QUANTS} FROM silver GROUP BY 1, 2, 3"), {**_KEY_KINDS, **_QUANT_KINDS}))
def b02_split(spark, sf):
    return shown(mart.slot_quantiles(silver(spark, sf)), 8)


@query("B03_slot_shares", sql_shown(on_silver(f"SELECT {_CELL}, {_B_SHARES} FROM silver GROUP BY 1, 2, 3"), {**_KEY_KINDS, **_SHARE_KINDS}))
def b03(spark, sf):
    return shown(mart.slot_shares(silver(spark, sf)))


def _grid(spark):
    return mart.dense_grid(spark, ZONES, START, END, MINUTES, PLATFORM_CODES)


@query("B04_dense_grid", sql_shown(on_silver("SELECT g.*, COUNT(s.valid_core) AS n FROM grid g LEFT JOIN silver s ON s.PULocationID = g.zone_id AND s.slot_start_local = g.slot_start_local AND s.platform = g.platform GROUP BY ALL", grid=_GRID), {**_KEY_KINDS, "n": "i"}))
def b04(spark, sf):
    counts = mart.slot_counts(silver(spark, sf)).select(*mart.KEYS, F.col("completed_trip_count").alias("n"))
    return shown(_grid(spark).join(counts, mart.KEYS, "left").fillna(0, ["n"]))


@query("B05_fill_grid", sql_shown(on_silver("SELECT * FROM filled", **_MART_CTES), {c: k.replace("r", "r8") if k == "r" else k for c, k in {**_KEY_KINDS, **_COUNT_KINDS, **_SHARE_KINDS, **_QUANT_KINDS}.items()}))
def b05(spark, sf):
    return shown(mart.fill_grid(_grid(spark), mart.slot_aggregates(silver(spark, sf))), 8)


@query("B06_invalid_share", sql_shown(on_silver(f"SELECT zone_id, slot_start_local, platform, {_SHARE_OUT} FROM filled", **_MART_CTES), {**_KEY_KINDS, **{f"{m}_invalid_or_missing_share": "r" for m, *_ in mart.METRICS}}))
def b06(spark, sf):
    filled = mart.fill_grid(_grid(spark), mart.slot_counts(silver(spark, sf)))
    return shown(mart.invalid_share(filled).select(*mart.KEYS, *[f"{m}_invalid_or_missing_share" for m, *_ in mart.METRICS]))


def _build_mart(spark, sf):
    return mart.build_mart(silver(spark, sf), zones=ZONES, start=START, end=END, minutes=MINUTES, platforms=PLATFORM_CODES, min_n=MIN_N)


@query("B07_suppress_low_n", sql_shown(on_silver(_MART, **_MART_CTES), _MART_KINDS))
def b07(spark, sf):
    return shown(_build_mart(spark, sf).drop("source_kind"), 8)


@query("B08_reconcile", on_silver("SELECT (SELECT SUM(completed_trip_count) FROM filled)::BIGINT AS mart_total, COUNT(*) AS silver_total, (SELECT SUM(completed_trip_count) FROM filled) = COUNT(*) AS reconciled FROM silver", **_MART_CTES))
def b08(spark, sf):
    base = silver(spark, sf)
    return mart.reconcile(mart.fill_grid(_grid(spark), mart.slot_counts(base)), base)


# --- context templates --------------------------------------------------------------------

_TRAIN = f"SELECT PULocationID AS zone_id, EXTRACT(HOUR FROM pickup_datetime)::INT AS hour, EXTRACT(ISODOW FROM pickup_datetime) >= 6 AS is_weekend, trip_km, trip_time FROM silver WHERE valid_core AND valid_duration AND valid_distance AND pickup_datetime < TIMESTAMP '{TRAIN_END}'"
_LEVEL_SQL = " UNION ALL ".join(
    f"SELECT {i} AS level, {z} AS zone_id, {h} AS hour, {w} AS is_weekend, COUNT(*) AS sample_count, QUANTILE_CONT(trip_km, 0.5) AS distance_km, QUANTILE_CONT(trip_time, 0.5) AS trip_seconds_p50, QUANTILE_CONT(trip_time, 0.9) AS trip_seconds_p90 FROM train {g}"
    for i, (z, h, w, g) in enumerate(
        [
            ("zone_id", "hour", "is_weekend", "GROUP BY ALL"),
            ("zone_id", "hour", "NULL::BOOLEAN", "GROUP BY ALL"),
            ("zone_id", "NULL::INT", "NULL::BOOLEAN", "GROUP BY ALL"),
            ("NULL::INT", "NULL::INT", "NULL::BOOLEAN", ""),
        ]
    )
)
_LEVEL_KINDS = {"level": "i", "zone_id": "r", "hour": "r", "is_weekend": "r", "sample_count": "i", "distance_km": "r8", "trip_seconds_p50": "r8", "trip_seconds_p90": "r8"}
CONTEXT_MIN = 30


def _levels_shown(levels: DataFrame) -> DataFrame:
    keys = {k: F.col(k).cast("int").cast("double") for k in context.KEYS}
    return shown(levels.withColumns(keys), 8)


_PICKED = f"""SELECT k.zone_id, k.hour, k.is_weekend, l.level AS fallback_level, l.sample_count, l.distance_km, l.trip_seconds_p50, l.trip_seconds_p90,
  'z' || k.zone_id || '-h' || k.hour || '-w' || k.is_weekend::INT AS context_id
FROM (SELECT z AS zone_id, h AS hour, w AS is_weekend FROM (SELECT UNNEST([0, 1, 2, 3, 4]) AS z) CROSS JOIN (SELECT UNNEST(RANGE(24)) AS h) CROSS JOIN (SELECT UNNEST([FALSE, TRUE]) AS w)) k
JOIN levels l ON (l.level = 3 OR l.zone_id = k.zone_id) AND (l.level >= 2 OR l.hour = k.hour) AND (l.level >= 1 OR l.is_weekend = k.is_weekend)
WHERE l.sample_count >= {CONTEXT_MIN} QUALIFY ROW_NUMBER() OVER (PARTITION BY k.zone_id, k.hour, k.is_weekend ORDER BY l.level) = 1"""
_CTX_CTES = {"train": _TRAIN, "levels": _LEVEL_SQL, "picked": _PICKED}
_CTX_KINDS = {"zone_id": "i", "hour": "i", "is_weekend": "", "fallback_level": "i", "sample_count": "i", "distance_km": "r8", "trip_seconds_p50": "r8", "trip_seconds_p90": "r8", "context_id": ""}


@query("C01_train_rows", sql_shown(on_silver("SELECT zone_id, hour, is_weekend, COUNT(*) AS n, SUM(trip_km) AS km, SUM(trip_time) AS seconds FROM train GROUP BY 1, 2, 3", train=_TRAIN), {"zone_id": "i", "hour": "i", "is_weekend": "", "n": "i", "km": "r4", "seconds": "i"}))
def c01(spark, sf):
    train = context.train_rows(silver(spark, sf), TRAIN_END)
    return shown(train.groupBy(*context.KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("trip_km").alias("km"), F.sum("trip_time").alias("seconds")), 4)


@query("C02_context_levels", sql_shown(on_silver("SELECT * FROM levels", train=_TRAIN, levels=_LEVEL_SQL), _LEVEL_KINDS))
def c02(spark, sf):
    return _levels_shown(context.context_levels(context.train_rows(silver(spark, sf), TRAIN_END)))


@query("C02_context_levels_split_groups", sql_shown(on_silver("SELECT * FROM levels", train=_TRAIN, levels=_LEVEL_SQL), _LEVEL_KINDS))
def c02_split(spark, sf):
    return _levels_shown(context.context_levels(context.train_rows(silver(spark, sf), TRAIN_END)))


def _context(spark, sf):
    return context.build_context(silver(spark, sf), zones=ZONES, train_end=TRAIN_END, min_n=CONTEXT_MIN)


@query("C03_hierarchical_fallback", sql_shown(on_silver("SELECT * FROM picked", **_CTX_CTES), _CTX_KINDS))
def c03(spark, sf):
    return shown(_context(spark, sf).drop("distance_scaled"), 8)


@query("C04_minmax_scale", sql_shown(on_silver("SELECT context_id, COALESCE((distance_km - MIN(distance_km) OVER ()) / NULLIF(MAX(distance_km) OVER () - MIN(distance_km) OVER (), 0), 0.5) AS distance_scaled FROM picked", **_CTX_CTES), {"context_id": "", "distance_scaled": "r"}))
def c04(spark, sf):
    return shown(_context(spark, sf).select("context_id", "distance_scaled"))


@query("C05_fallback_histogram", sql_shown(on_silver("SELECT fallback_level, COUNT(*) AS n_contexts, MIN(distance_km) AS min_distance_km, MAX(distance_km) AS max_distance_km FROM picked GROUP BY 1", **_CTX_CTES), {"fallback_level": "i", "n_contexts": "i", "min_distance_km": "r8", "max_distance_km": "r8"}))
def c05(spark, sf):
    return shown(context.fallback_histogram(_context(spark, sf)), 8)
