"""The trip build: silver once, then every table that reads it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from farewise.operators.context import build_context
from farewise.operators.mart import build_mart
from farewise.operators.quality import build_silver, write_silver
from farewise.session import scratch_path


@dataclass(frozen=True)
class TripTables:
    silver: DataFrame
    mart: DataFrame
    contexts: DataFrame


def build_trip_tables(
    raw: DataFrame, zones: DataFrame, *, start: str, end: str, train_end: str, zone_ids: Sequence[int],
    platforms: Sequence[str], minutes: int = 30, min_n: int = 30, path: str | None = None,
) -> TripTables:
    """Clean and store the scoped trips, then derive mart and contexts from the stored table.

    The raw scan and its joins run once; the derived tables read only the columns they need.
    """
    lazy = build_silver(
        raw, zones, start=start, end=end, zone_ids=zone_ids, platforms=platforms, slot_minutes=minutes
    )
    silver = write_silver(lazy, path or scratch_path(raw.sparkSession, "silver"))
    return TripTables(
        silver,
        build_mart(silver, zones=zone_ids, start=start, end=end, minutes=minutes, platforms=platforms, min_n=min_n),
        build_context(silver, zones=zone_ids, train_end=train_end, min_n=min_n),
    )
