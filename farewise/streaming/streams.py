"""Structured Streaming twins of the batch tables.

Event times are naive local timestamps in the tables and become instants here, because a
watermark needs one. Every stream reads bounded micro-batches and writes Parquet with its own
checkpoint below the shared folder, so a lost executor or driver resumes from the log.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewise.functions.scalars import any_of
from farewise.operators.mart import count_aggregates
from farewise.operators.quality import CORE_KEYS
from farewise.session import scratch_path

BATCH_BYTES = 1 << 30


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A file stream with bounded micro-batches."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return reader.option("maxBytesPerTrigger", BATCH_BYTES).parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available, then return the sink as a table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{path}-checkpoint").start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def instant(ts: str | Column) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")


def stream_slot_mart(silver: DataFrame, minutes: int = 30, delay: str = "1 hour") -> DataFrame:
    """Slot counts per zone and platform; a slot is emitted once its window has closed."""
    timed = silver.withColumn("_at", instant("pickup_datetime")).withWatermark("_at", delay)
    slot = F.window("_at", f"{minutes} minutes").alias("slot")
    counted = timed.groupBy(slot, F.col("PULocationID").alias("zone_id"), "platform").agg(*count_aggregates())
    start = F.col("slot.start").cast("timestamp_ntz").alias("slot_start_local")
    return counted.select("zone_id", start, "platform", *[c for c in counted.columns if c not in ("slot", "zone_id", "platform")])


_REQUEST_OUT = "request_id bigint, service_id string, state string, created_at timestamp, pickup_at timestamp, ended_at timestamp"
# One list per field, with one place per held request; NEVER stands for a time that has not come.
_REQUEST_STATE = (
    "ids array<bigint>, unnamed array<bigint>, first_us array<bigint>, created_us array<bigint>, pickup_us array<bigint>, "
    "ended_us array<bigint>, ending array<bigint>, closed array<bigint>, until_us array<bigint>, services array<string>"
)
# The states that end a request.
_TERMINAL = ("completed", "canceled", "expired")
_NEVER = (1 << 63) - 1
#: Groups of requests, by hash of the id, that share one call and one state row.
REQUEST_GROUPS = 1024


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def _instants(us: np.ndarray) -> pd.Series:
    known = us != _NEVER
    return pd.Series(np.where(known, us, 0).astype("datetime64[us]")).where(known)


def stream_request_state(
    events: DataFrame, deadline_seconds: int, delay: str = "1 hour", replay_seconds: int = 3600,
    groups: int = REQUEST_GROUPS,
) -> DataFrame:
    """Carry open requests between batches; emit a request once, when it ended or timed out for good.

    State per open request is the earliest creation, pickup and end seen so far, so the order of
    arrival within the delay does not matter. A request is emitted when the watermark passes its
    end, or its creation plus the deadline if that comes first; events replayed within
    `replay_seconds` of that meet a closed marker and change nothing.

    Requests are dealt by hash into `groups` groups. A call and a state row serve a whole group, so the
    number of Python calls does not grow with the requests; a state row holds the group's open requests.
    Events without a time cannot be placed and are left out.
    """
    span = deadline_seconds * 1_000_000
    margin = replay_seconds * 1_000_000

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([],) * 10
        # Columns of `rows`: id, unnamed, first, created, pickup, ended, ending, closed, until; a closed row leads its request.
        parts = [np.array(held[:9], dtype="int64").T.reshape(-1, 9)]
        services = [pd.Series(held[9], dtype=object)]
        for batch in () if state.hasTimedOut else batches:
            us, name = _micros(batch["at"]).to_numpy(), batch["state"]
            at = lambda mask, us=us: np.where(mask, us, _NEVER)
            ending = pd.Categorical(name, categories=_TERMINAL).codes.astype("int64")
            fields = [
                batch["id"].to_numpy("int64"), batch["unnamed"].to_numpy("int64"), us, at(name == "created"), at(name == "on_trip"),
                at(ending >= 0), ending, np.zeros(len(us), "int64"), np.full(len(us), _NEVER),
            ]
            parts.append(np.column_stack(fields))
            services.append(batch["service_id"].astype(object))
        rows = np.concatenate(parts)
        if not len(rows):
            state.remove()
            return
        codes, names = pd.factorize(pd.concat(services, ignore_index=True), sort=True)
        service = np.where(codes < 0, len(names), codes)
        known = len(parts[0])
        order = np.lexsort((rows[:, 6], rows[:, 5], 1 - rows[:, 7], rows[:, 1], rows[:, 0]))
        rows, service, fresh = rows[order], service[order], order >= known
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        lead = rows[starts]
        closed = lead[:, 7] == 1
        least = np.minimum.reduceat(rows[:, 2:5], starts, axis=0)
        first, created, pickup = np.where(closed[:, None], lead[:, 2:5], least).T
        service = np.where(closed, service[starts], np.minimum.reduceat(service, starts))
        touched = np.logical_or.reduceat(fresh, starts)
        ended, ending = lead[:, 5], lead[:, 6]

        now = state.getCurrentWatermarkMs() * 1000
        due = np.where(created == _NEVER, first, created) + span
        at = np.minimum(ended, due)
        out = ~closed & (now > at)
        if out.any():
            in_time = ended[out] <= due[out]
            label = np.array([*_TERMINAL, "deadline_passed"], dtype=object)[np.where(in_time, ending[out], len(_TERMINAL))]
            ids = pd.array(lead[out, 0], dtype="Int64")
            ids[lead[out, 1] == 1] = pd.NA
            yield pd.DataFrame(
                {
                    "request_id": ids, "service_id": np.array([*names, None], dtype=object)[service[out]], "state": label,
                    "created_at": _instants(created[out]), "pickup_at": _instants(pickup[out]), "ended_at": _instants(at[out]),
                }
            )
        until = np.where(out | (closed & touched), np.maximum(at, now) + margin, lead[:, 8])
        closed = closed | out
        kept = ~closed | (until >= now)
        if not kept.any():
            state.remove()
            return
        fields = np.column_stack([lead[:, 0], lead[:, 1], first, created, pickup, ended, ending, closed, until])[kept]
        state.update((*fields.T.tolist(), np.array([*names, None], dtype=object)[service[kept]].tolist()))
        wake = int(np.where(closed, until, at)[kept].min())
        state.setTimeoutTimestamp(max(wake // 1000 + 1, now // 1000 + 1))

    number = F.col("request_id").cast("bigint")
    timed = events.select(
        F.pmod(F.xxhash64(number), F.lit(groups)).alias("group"), F.coalesce(number, F.lit(0)).alias("id"),
        number.isNull().cast("int").alias("unnamed"), "service_id", "state", instant("event_ts").alias("at"),
    ).filter("at is not null")
    return (
        timed.withWatermark("at", delay)
        .groupBy("group")
        .applyInPandasWithState(advance, _REQUEST_OUT, _REQUEST_STATE, "append", "EventTimeTimeout")
    )


def stream_ledger(events: DataFrame, roster: DataFrame, fares: DataFrame, delay: str = "30 days") -> DataFrame:
    """Settle each completion once although the log may be replayed within the delay.

    A completion of an unknown vehicle or service is kept, unpaid and marked in `terms_status`.
    """
    done = events.filter("state = 'completed'").withColumn("at", instant("event_ts"))
    once = done.withWatermark("at", delay).dropDuplicatesWithinWatermark(["request_id"])
    drivers = roster.select("vehicle_id", "driver_id", F.lit(True).alias("_rostered"))
    joined = once.join(fares.select("service_id", "amount"), "service_id", "left").join(drivers, "vehicle_id", "left")
    status = F.when(F.col("_rostered").isNull(), "unknown_vehicle").when(F.col("amount").isNull(), "unknown_service").otherwise("ok")
    return joined.select(
        "request_id", "vehicle_id", "driver_id", "service_id", F.col("event_ts").alias("completed_at"),
        F.when(status == "ok", F.col("amount")).alias("driver_pay"), status.alias("terms_status"),
    )


_INTERVAL_OUT = "vehicle_id bigint, state string, start_us bigint, end_us bigint"
_INTERVAL_STATE = "state string, start_us bigint, waiting_us array<bigint>, waiting_ids array<bigint>, waiting array<string>"


def stream_state_intervals(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Close a vehicle's intervals once the watermark has passed their end.

    Changes wait in the state until no earlier one can arrive, then they are placed in order of time
    and id; state per vehicle is its last placed change and those of the delay. Changes later than
    the delay never reach this operator; `stream_intervals_and_late` keeps them in a side table.
    """

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        name, start, times, ids, names = state.get if state.exists else (None, None, [], [], [])
        times, ids, names = list(times), list(ids), list(names)
        start = None if pd.isna(start) else int(start)
        if not state.hasTimedOut:
            for batch in batches:
                times += _micros(batch["at"]).tolist()
                ids += batch["event_id"].tolist()
                names += batch["state"].tolist()
        now = state.getCurrentWatermarkMs() * 1000
        rows = pd.DataFrame({"us": times, "id": ids, "state": names}).sort_values(["us", "id"])
        ready, waiting = rows[rows["us"] < now], rows[rows["us"] >= now]
        if len(ready):
            us, placed = ready["us"].tolist(), ready["state"].tolist()
            if start is not None:
                us, placed = [start, *us], [name, *placed]
            name, start = placed[-1], us[-1]
            out = pd.DataFrame({"vehicle_id": key[0], "state": placed[:-1], "start_us": us[:-1], "end_us": us[1:]})
            yield out[out["end_us"] > out["start_us"]]
        state.update((name, start, waiting["us"].tolist(), waiting["id"].tolist(), waiting["state"].tolist()))
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting["us"].iloc[0]) // 1000, now // 1000) + 1)

    timed = changes.select("vehicle_id", "event_id", "state", instant("ts").alias("at"))
    return (
        timed.withWatermark("at", delay)
        .groupBy("vehicle_id")
        .applyInPandasWithState(advance, _INTERVAL_OUT, _INTERVAL_STATE, "append", "EventTimeTimeout")
    )


def stream_intervals_and_late(changes: DataFrame, name: str, delay_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(intervals, late): changes too late to be placed go to a table of their own, all others are placed."""
    required = ("vehicle_id", "ts", "state")
    good, late = stream_quarantine(changes, f"{name}-changes", "ts", delay_seconds, required)
    folder = good.inputFiles()[0].rsplit("/batch=", 1)[0] if good.inputFiles() else None
    if folder is None:
        return changes.sparkSession.createDataFrame([], _INTERVAL_OUT), late
    again = read_stream(changes.sparkSession, f"{folder}/batch=*", good.schema, files_per_batch=None)
    return run_to_table(stream_state_intervals(again, f"{delay_seconds} seconds"), name), late


def stream_quarantine(
    stream: DataFrame, name: str, ts: str, lateness_seconds: int, required: tuple[str, ...] = CORE_KEYS
) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined): NULL core keys, or later than the newest earlier batch allows.

    Each batch overwrites its own partition, so a replayed batch changes nothing. The newest
    event time up to each batch is kept as a one-row table next to it; the next batch reads that row alone.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    seen = f"{root}/newest"

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            horizon = None
            if batch_id:
                horizon = batch.sparkSession.read.schema("at timestamp_ntz").parquet(f"{seen}/part={batch_id - 1}").first()[0]
            missing = any_of([F.col(c).isNull() for c in required])
            late = F.lit(False)
            if horizon is not None:
                late = F.coalesce(F.col(ts) < F.lit(horizon).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(lateness_seconds)} SECONDS"), F.lit(False))
            reason = F.when(missing, "missing_core_key").when(late, "too_late")
            marked = batch.withColumn("quarantine_reason", reason)
            marked.filter("quarantine_reason is null").drop("quarantine_reason").write.mode("overwrite").parquet(f"{root}/usable/batch={batch_id}")
            marked.filter("quarantine_reason is not null").write.mode("overwrite").parquet(f"{root}/quarantined/batch={batch_id}")
            newest = batch.agg(F.greatest(F.max(ts), F.lit(horizon).cast("timestamp_ntz")).alias("at"))
            newest.write.mode("overwrite").parquet(f"{seen}/part={batch_id}")
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(split).trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").start()
    query.awaitTermination()
    good = spark.read.schema(stream.schema).parquet(f"{root}/usable")
    bad_schema = T.StructType([*stream.schema.fields, T.StructField("quarantine_reason", T.StringType())])
    return good, spark.read.schema(bad_schema).parquet(f"{root}/quarantined")
