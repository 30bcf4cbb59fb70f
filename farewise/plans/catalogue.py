"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.functions.scalars import rounded

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def kept(df: DataFrame) -> DataFrame:
    """Persist a small shared table once per session; equal plans find the same cache entry."""
    return df if df.storageLevel != StorageLevel.NONE else df.persist()


def shown(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles and print times as text, so both engines give the same values."""
    out = []
    for field in df.schema:
        kind = field.dataType.typeName()
        c = F.col(f"`{field.name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = rounded(c, places)
        elif kind in ("timestamp_ntz", "timestamp", "date"):
            c = c.cast("string")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def sql_shown(select: str, columns: dict[str, str]) -> str:
    """Wrap an SQL query with the same presentation: kind r<places> rounds, i casts, t prints."""
    parts = []
    for name, kind in columns.items():
        if kind.startswith("r"):
            parts.append(f'ROUND("{name}"::DOUBLE, {kind[1:] or 6}) + 0.0 AS "{name}"')
        elif kind == "i":
            parts.append(f'"{name}"::BIGINT AS "{name}"')
        elif kind == "t":
            parts.append(f'CAST("{name}" AS VARCHAR) AS "{name}"')
        else:
            parts.append(f'"{name}"')
    return f"SELECT {', '.join(parts)} FROM ({select})"
