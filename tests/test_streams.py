import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from farewise.functions.scalars import ntz
from farewise.operators import ops
from farewise.session import scratch_path
from farewise.streaming import streams

DAY = dt.datetime(2024, 1, 1)


def in_files(spark, df, order, name, files=4):
    """Write rows in time order to several files, one micro-batch each."""
    path = scratch_path(spark, name)
    ordered = df.orderBy(*order).collect()
    size = -(-len(ordered) // files)
    for start in range(0, len(ordered), size):
        spark.createDataFrame(ordered[start : start + size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, df.schema, files_per_batch=1)


def closed_before(df, ts):
    """What the watermark has passed at the end of the stream."""
    return F.lit(df.agg(F.max(ts)).first()[0] - dt.timedelta(hours=1)).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def changes(spark):
    rng = np.random.default_rng(4)
    rows = [(int(v), i, DAY + dt.timedelta(minutes=int(m)), str(s)) for i, (v, m, s) in enumerate(zip(rng.integers(0, 6, 300), np.sort(rng.integers(0, 5000, 300)), rng.choice(["idle", "on_trip", "offline"], 300)))]
    return spark.createDataFrame(rows, "vehicle_id bigint, event_id bigint, ts timestamp_ntz, state string")


def test_intervals_survive_batch_boundaries(spark, changes, rows):
    stream = in_files(spark, changes, ["ts", "event_id"], "changes")
    got = streams.run_to_table(streams.stream_state_intervals(stream), "intervals")
    end = "2025-01-01 00:00:00"
    us = lambda c: F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), F.col(c))
    batch = ops.state_intervals(changes, ntz(end)).filter(F.col("end") < closed_before(changes, "ts"))
    assert rows(got) == rows(batch.select("vehicle_id", "state", us("start"), us("end")))


def test_late_and_replayed_changes(spark, rows):
    at = lambda h, m: DAY + dt.timedelta(hours=h, minutes=m)
    parts = [
        [(1, 1, at(8, 0), "idle"), (1, 2, at(8, 30), "on_trip"), (2, 3, at(8, 0), "idle")],
        [(1, 4, at(8, 20), "dispatch"), (1, 5, at(9, 0), "idle"), (1, 2, at(8, 30), "on_trip")],
        [(2, 6, at(12, 0), "on_trip"), (1, 7, at(12, 0), "offline")],
        [(1, 8, at(8, 40), "late"), (2, 9, at(15, 0), "idle")],
    ]
    path = scratch_path(spark, "late-changes")
    schema = "vehicle_id bigint, event_id bigint, ts timestamp_ntz, state string"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = streams.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    intervals, late = streams.stream_intervals_and_late(stream, "late-intervals")
    us = lambda t: int(t.timestamp() * 1_000_000) if t.tzinfo else int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    expected = [(1, "idle", at(8, 0), at(8, 20)), (1, "dispatch", at(8, 20), at(8, 30)), (1, "on_trip", at(8, 30), at(9, 0)), (1, "idle", at(9, 0), at(12, 0)), (2, "idle", at(8, 0), at(12, 0))]
    assert rows(intervals) == {(v, s, us(a), us(b)) for v, s, a, b in expected}
    assert [r.event_id for r in late.collect()] == [8]


@pytest.fixture(scope="module")
def log(spark):
    rows = []
    for r in range(40):
        t = r * 30
        rows += [(r, "X" if r % 2 else "Y", DAY + dt.timedelta(minutes=t), "created", 1, None)]
        if r % 5:
            rows += [(r, "X" if r % 2 else "Y", DAY + dt.timedelta(minutes=t + 20), "on_trip", 4, r % 3)]
            rows += [(r, "X" if r % 2 else "Y", DAY + dt.timedelta(minutes=t + 200), "completed", 5, r % 3)]
    return spark.createDataFrame(rows, "request_id bigint, service_id string, event_ts timestamp_ntz, state string, step int, vehicle_id bigint")


def test_requests_stay_open_between_batches_and_expire_at_the_deadline(spark, log):
    stream = in_files(spark, log, ["event_ts", "request_id", "step"], "log", 5)
    got = streams.run_to_table(streams.stream_request_state(stream, 6 * 3600), "requests").toPandas().set_index("request_id")
    assert got.index.is_unique
    life = ops.request_lifecycle(log).toPandas().set_index("request_id")
    done = life[life.completed_at.notna()]
    passed = done[done.completed_at < pd.to_datetime(log.agg(F.max("event_ts")).first()[0]) - pd.Timedelta("1h")]
    assert set(got.index[got.state == "completed"]) == set(passed.index) and len(passed)
    assert (got.loc[passed.index, "pickup_at"] == passed.pickup_at).all() and (got.loc[passed.index, "ended_at"] == passed.completed_at).all()
    late = got[got.state == "deadline_passed"]
    limit = life.index[life.completed_at.isna() & (life.created_at + pd.Timedelta("6h") < pd.to_datetime(log.agg(F.max("event_ts")).first()[0]) - pd.Timedelta("1h"))]
    assert set(late.index) == set(limit) and len(late)


def test_replayed_and_shuffled_events_change_nothing(spark, log, rows):
    plain = streams.run_to_table(streams.stream_request_state(in_files(spark, log, ["event_ts", "request_id", "step"], "plain", 5), 6 * 3600), "requests")
    shuffled = in_files(spark, log.unionByName(log), [F.date_trunc("hour", "event_ts"), F.xxhash64("request_id", "step")], "shuffled", 7)
    again = streams.run_to_table(streams.stream_request_state(shuffled, 6 * 3600, "2 hours"), "requests")
    kept = rows(again)
    assert len(kept) == again.count() and kept <= rows(plain)


def test_requests_share_calls_and_state_rows(spark, rows):
    minutes = F.col("id") % 3000
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("state"), F.lit(m).alias("after")) for n, m in (("created", 0), ("on_trip", 20), ("completed", 50))])).alias("s")
    whole = spark.range(20_000).withColumns({"request_id": F.when(F.col("id") > 0, F.col("id") + (1 << 53)), "service_id": F.when(F.col("id") % 7 > 0, F.lit("X")), "minutes": minutes}).select(
        "request_id", "service_id", "minutes", steps
    ).filter("s.state != 'completed' or request_id % 5 > 0")
    at = F.timestamp_add("MINUTE", (F.col("minutes") + F.col("s.after")).cast("int"), ntz(str(DAY)))
    log = whole.select("request_id", "service_id", at.alias("event_ts"), F.col("s.state").alias("state"))
    stream = streams.stream_request_state(in_files(spark, log, ["event_ts"], "many", 3), 6 * 3600)
    path = scratch_path(spark, "many-requests")
    query = stream.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").start(path)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= streams.REQUEST_GROUPS
    life = log.groupBy("request_id", "service_id").agg(
        *[F.min(F.when(F.col("state") == s, F.col("event_ts"))).alias(s) for s in ("created", "on_trip", "completed")]
    )
    due = F.col("created") + F.expr("INTERVAL 6 HOURS")
    ended = F.coalesce("completed", due)
    expected = life.select("request_id", "service_id", F.when(F.col("completed").isNull(), "deadline_passed").otherwise("completed").alias("state"), "created", "on_trip", ended.alias("ended"))
    expected = expected.filter(F.col("ended") < closed_before(log, "event_ts"))
    got = spark.read.schema(stream.schema).parquet(path).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "pickup_at", "ended_at")})
    assert rows(got) == rows(expected) and got.count() == expected.count() > 15_000


def test_replayed_completions_are_paid_once(spark, log):
    stream = in_files(spark, log.unionByName(log), ["event_ts", "request_id"], "replays", 6)
    roster = spark.createDataFrame([(v, f"d{v}") for v in range(2)], "vehicle_id bigint, driver_id string")
    fares = spark.createDataFrame([("X", 10.0), ("Y", 8.0)], "service_id string, amount double")
    got = streams.run_to_table(streams.stream_ledger(stream, roster, fares), "ledger")
    assert got.count() == got.select("request_id").distinct().count() == log.filter("state = 'completed'").count()
    unknown = got.filter("terms_status = 'unknown_vehicle'")
    assert unknown.count() == log.filter("state = 'completed' and vehicle_id = 2").count() and unknown.filter("driver_pay is not null").count() == 0


def test_quarantine_takes_null_keys_and_late_rows(spark, log):
    rows = log.withColumn("request_id", F.when(F.col("request_id") != 7, F.col("request_id")))
    late = rows.limit(1).withColumns({"request_id": F.lit(99).cast("bigint"), "event_ts": F.lit(str(DAY)).cast("timestamp_ntz")})
    path = scratch_path(spark, "mixed")
    early = rows.filter(F.col("event_ts") < ntz("2024-01-01 10:00:00"))
    for part in (early, rows.filter(F.col("event_ts") >= ntz("2024-01-01 10:00:00")).unionByName(late)):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = streams.read_stream(spark, path, rows.schema, files_per_batch=1)
    good, bad = streams.stream_quarantine(stream, "mixed", "event_ts", 3600, ("request_id",))
    reasons = {r["quarantine_reason"]: r["count"] for r in bad.groupBy("quarantine_reason").count().collect()}
    missing = log.filter("request_id = 7").count()
    assert reasons.get("missing_core_key") == missing and reasons["too_late"] == 1
    assert good.count() + bad.count() == log.count() + 1
