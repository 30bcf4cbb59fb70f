import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewise.operators import context, mart, quality
from farewise.session import scratch_path
from farewise.sources import tables

START, END = "2024-01-01 00:00:00", "2024-01-03 00:00:00"
KINDS = {"string": T.StringType(), "timestamp": T.TimestampNTZType(), "integer": T.LongType(), "float": T.DoubleType()}
SCHEMA = T.StructType([T.StructField(n, KINDS[k]) for n, k in tables.TRIP_CONTRACT.items()])


def trip(**changes):
    pickup = dt.datetime(2024, 1, 1, 10, 5)
    base = {
        "hvfhs_license_num": "HV0003", "dispatching_base_num": "B1", "originating_base_num": "B1",
        **dict.fromkeys(tables.FLAG_COLUMNS, "N"),
        "request_datetime": pickup - dt.timedelta(minutes=4), "on_scene_datetime": pickup - dt.timedelta(minutes=1),
        "pickup_datetime": pickup, "dropoff_datetime": pickup + dt.timedelta(minutes=15),
        "PULocationID": 1, "DOLocationID": 2, "trip_time": 900,
        "trip_miles": 3.0, "base_passenger_fare": 20.0, "tolls": 1.0, "bcf": 0.5, "sales_tax": 1.5,
        "congestion_surcharge": 2.75, "airport_fee": 0.0, "tips": 2.0, "driver_pay": 15.0,
    }
    base.update(changes)
    return tuple(base[c] for c in tables.TRIP_COLUMNS)


@pytest.fixture(scope="module")
def raw(spark):
    pickup = dt.datetime(2024, 1, 1, 10, 5)
    trips = [
        trip(),
        trip(),
        trip(request_datetime=pickup + dt.timedelta(minutes=1)),
        trip(base_passenger_fare=-3.0, tolls=None),
        trip(trip_time=-1),
        trip(trip_miles=-2.0, hvfhs_license_num="HV0005"),
        trip(DOLocationID=99, shared_request_flag="maybe", shared_match_flag=" n ", pickup_datetime=dt.datetime(2024, 1, 2, 23, 59), dropoff_datetime=dt.datetime(2024, 1, 3, 0, 14), request_datetime=dt.datetime(2024, 1, 2, 23, 50)),
        trip(pickup_datetime=None),
        trip(PULocationID=7),
        trip(pickup_datetime=dt.datetime(2024, 1, 3)),
    ]
    path = scratch_path(spark, "trips")
    spark.createDataFrame(trips, SCHEMA).coalesce(1).write.parquet(path)
    return tables.read_trips(spark, path)


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame([(1, "Q", "one", "z"), (2, "Q", "two", "z")], "LocationID int, Borough string, Zone string, service_zone string")


@pytest.fixture(scope="module")
def silver(raw, zones):
    return quality.build_silver(raw, zones, start=START, end=END, zone_ids=[1, 2], platforms=["HV0003", "HV0005"])


def test_silver_keeps_every_scoped_row_and_counts_each_metric_separately(silver):
    counts = silver.agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in quality.VALIDITY_FLAGS]).first()
    assert counts["n"] == 7
    assert counts["valid_wait"] == counts["valid_duration"] == counts["valid_distance"] == counts["valid_price"] == 6
    assert counts["valid_fare_transaction"] == counts["valid_core"] == 7
    assert counts["unknown_dropoff_zone"] == counts["unknown_flag_value"] == 1
    assert counts["unknown_pickup_zone"] == 0


def test_row_ids_keep_identical_rows_apart(silver):
    assert silver.select("trip_row_id").distinct().count() == 7
    groups = quality.duplicate_groups(silver).first()
    assert (groups["duplicate_groups"], groups["rows_in_groups"]) == (1, 2)


def test_null_core_rows_are_quarantined(raw):
    good, bad = quality.split_quarantine(raw)
    assert (good.count(), bad.count()) == (9, 1)


def test_flags_are_normalized_without_losing_the_raw_value(silver):
    odd = silver.filter("unknown_flag_value").first()
    assert odd["shared_request_flag"] == "maybe" and odd["shared_request_flag_normalized"] is None
    assert odd["shared_match_flag_normalized"] == "N"


def test_missing_component_blanks_the_sum_only(silver):
    assert silver.filter("passenger_components_excluding_tips_usd is null").count() == 1
    assert silver.filter("request_to_pickup_seconds is null").count() == 1


def test_quality_report_counts_nulls_and_flags(silver):
    report = {r["metric"]: r["count"] for r in quality.quality_report(silver, ["tolls", "bcf"], ["valid_wait"]).collect()}
    assert report == {"null:tolls": 1, "null:bcf": 0, "flag:valid_wait": 6}


def test_mart_is_dense_reconciled_and_suppressed(silver):
    args = dict(zones=[1, 2], start=START, end=END, minutes=30, platforms=["HV0003", "HV0005"])
    built = mart.build_mart(silver, min_n=2, **args)
    assert built.count() == 2 * 2 * 48 * 2
    mart.require_reconciled(built, silver)
    cell = built.filter("zone_id = 1 and platform = 'Uber' and slot_start_local = timestamp_ntz'2024-01-01 10:00:00'").first()
    assert cell["completed_trip_count"] == 5 and cell["n_valid_wait"] == 4
    assert cell["trip_seconds_p50"] == 900 and not cell["low_duration_sample"]
    lyft = built.filter("platform = 'Lyft' and completed_trip_count > 0").first()
    assert lyft["low_distance_sample"] and lyft["trip_km_p50"] is None and lyft["n_valid_distance"] == 0
    empty = built.filter("zone_id = 2").first()
    assert empty["completed_trip_count"] == 0 and empty["trip_km_p50"] is None and empty["trip_km_invalid_or_missing_share"] is None


def test_context_falls_back_level_by_level(silver):
    built = context.build_context(silver, zones=[1, 2], train_end=END, min_n=3)
    assert built.count() == 2 * 24 * 2
    level = {(r["zone_id"], r["hour"], r["is_weekend"]): r["fallback_level"] for r in built.collect()}
    assert level[(1, 10, False)] == 0 and level[(1, 10, True)] == 1
    assert level[(1, 3, False)] == 2 and level[(2, 10, False)] == 3
    with pytest.raises(tables.ContractError):
        context.require_root(context.context_levels(context.train_rows(silver, END)), 100)


def test_schema_contract_rejects_other_shapes(spark, raw):
    plain = raw.drop("trip_row_id")
    with pytest.raises(tables.ContractError):
        tables.check_schema(plain.drop("tips"), tables.TRIP_CONTRACT)
    with pytest.raises(tables.ContractError):
        tables.check_schema(plain.withColumn("tips", F.col("tips").cast("string")), tables.TRIP_CONTRACT)


@pytest.mark.parametrize("text", ["LocationID,Borough,Zone,service_zone\n1,a,b,c\n1,a,b,c\n", "LocationID,Borough,Zone,service_zone\n1.5,a,b,c\n", "LocationID,Borough,Zone\n1,a,b\n", "LocationID,Borough,Zone,service_zone\n,a,b,c\n"])
def test_zone_file_is_checked(spark, tmp_path, text):
    (tmp_path / "zones.csv").write_text(text)
    with pytest.raises(tables.ContractError):
        tables.read_zones(spark, str(tmp_path / "zones.csv"))


@pytest.mark.parametrize("fmt", ["parquet", "csv", "tsv", "json"])
def test_sinks_are_replaced_as_a_whole(spark, fmt):
    path = scratch_path(spark, "sink")
    first = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, name string")
    tables.write_table(first, path, fmt)
    tables.write_table(first.filter("id = 2"), path, fmt)
    assert [tuple(r) for r in tables.read_table(spark, path, first.schema, fmt).collect()] == [(2, None)]


def test_partition_overwrite_touches_only_its_partitions(spark):
    path = scratch_path(spark, "days")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "day string, n int")
    tables.write_table(df, path, partition_by=("day",))
    tables.write_table(df.filter("day = 'b'").withColumn("n", F.lit(9)), path, partition_by=("day",))
    assert {tuple(r) for r in spark.read.schema("n int, day string").parquet(path).collect()} == {(1, "a"), (9, "b")}


def test_union_rejects_repeated_keys(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, "x")], "k int, note string")
    with pytest.raises(tables.ContractError):
        quality.union_results([a, b], ["k"])
    out = quality.union_results([a, b.withColumn("k", F.lit(2))], ["k"])
    assert out.count() == 2 and quality.incomplete_cells(out, ["k"], 1).count() == 0


def test_long_membership_list_becomes_a_semi_join(raw):
    assert quality.in_list(raw, "PULocationID", list(range(1, 2000))).count() == raw.count()


def test_profile_counts_missing_and_infinite(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (float("inf"), "b")], "x double, y string")
    assert {tuple(r) for r in quality.profile_table(df).collect()} == {("x", 1, 1), ("y", 1, 0)}


def test_ids_differ_between_folders_and_tables_are_swapped(spark, raw):
    path = scratch_path(spark, "folders")
    rows = raw.drop("trip_row_id")
    for day in ("a", "b"):
        rows.coalesce(1).write.parquet(f"{path}/day={day}")
    files = sorted(spark.read.parquet(path).inputFiles())
    table = tables.with_row_id(spark.read.parquet(*files), "trips", files[0].split("day=a")[0])
    assert table.select("trip_row_id").distinct().count() == table.count() == 2 * rows.count()
    out = scratch_path(spark, "swapped")
    tables.write_table(spark.range(5).toDF("n"), out)
    kept = spark.read.parquet(out)
    tables.write_table(kept.filter("n > 2"), out)
    assert spark.read.parquet(out).count() == 2
    with pytest.raises(Exception):
        tables.write_table(spark.range(3).selectExpr("raise_error('no') as n"), out)
    assert spark.read.parquet(out).count() == 2


def test_too_few_trips_and_stray_cells_fail(silver):
    with pytest.raises(Exception, match="too few valid"):
        context.build_context(silver, zones=[1, 2], train_end=END, min_n=10_000).collect()
    with pytest.raises(Exception, match="outside the mart"):
        mart.build_mart(silver, zones=[2], start=START, end=END, minutes=30, platforms=["HV0003", "HV0005"], min_n=1).collect()
