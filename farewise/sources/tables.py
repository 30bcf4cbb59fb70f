"""Checked readers and replaceable sinks."""

from __future__ import annotations

import os.path
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published 24-column monthly high-volume trip record.
STRING_COLUMNS = (
    "hvfhs_license_num", "dispatching_base_num", "originating_base_num", "shared_request_flag",
    "shared_match_flag", "access_a_ride_flag", "wav_request_flag", "wav_match_flag",
)
TIMESTAMP_COLUMNS = (
    "request_datetime", "on_scene_datetime", "pickup_datetime", "dropoff_datetime",
)
INTEGER_COLUMNS = ("PULocationID", "DOLocationID", "trip_time")
FLOAT_COLUMNS = (
    "trip_miles", "base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge",
    "airport_fee", "tips", "driver_pay",
)
FLAG_COLUMNS = STRING_COLUMNS[3:]
ZONE_COLUMNS = ("LocationID", "Borough", "Zone", "service_zone")

TRIP_CONTRACT = {
    **dict.fromkeys(STRING_COLUMNS, "string"),
    **dict.fromkeys(TIMESTAMP_COLUMNS, "timestamp"),
    **dict.fromkeys(INTEGER_COLUMNS, "integer"),
    **dict.fromkeys(FLOAT_COLUMNS, "float"),
}
TRIP_COLUMNS = tuple(TRIP_CONTRACT)

_CLASSES = {
    "string": (T.StringType,),
    "timestamp": (T.TimestampNTZType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "boolean": (T.BooleanType,),
    "date": (T.DateType,),
}


class ContractError(ValueError):
    """The input does not have the declared shape or breaks a declared rule."""


def check_schema(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Reject missing, unknown or wrongly typed columns; looks at the schema only."""
    found = {f.name: f.dataType for f in df.schema}
    missing, unknown = set(contract) - set(found), set(found) - set(contract)
    if missing or unknown or len(df.schema) != len(contract):
        raise ContractError(f"missing columns {sorted(missing)}, unknown {sorted(unknown)}")
    wrong = [n for n, kind in contract.items() if not isinstance(found[n], _CLASSES[kind])]
    if wrong:
        raise ContractError(f"columns of the wrong type: {sorted(wrong)}")
    return df


def read_contract(spark: SparkSession, path: str, contract: dict[str, str]) -> DataFrame:
    return check_schema(spark.read.parquet(path), contract)


def with_row_id(df: DataFrame, source_id: str, root: str | None = None) -> DataFrame:
    """Technical id `source:row`, so that identical rows stay distinct.

    Reads the file position Spark exposes, so no ordering or shuffle is needed. A source of
    several files names its `root`; the file's path below it then stands inside the id.
    """
    parts = [F.lit(source_id)]
    if root is not None:
        path = F.col("_metadata.file_path")
        parts.append(F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path))
    parts.append(F.col("_metadata.row_index").cast("string"))
    return df.withColumn("trip_row_id", F.concat_ws(":", *parts))


def read_trips(spark: SparkSession, path: str, source_id: str = "trips") -> DataFrame:
    """Trip records checked against the 24-column contract, with a technical row id."""
    trips = read_contract(spark, path, TRIP_CONTRACT)
    files = trips.inputFiles()
    root = os.path.commonprefix(files).rpartition("/")[0] + "/" if len(files) > 1 else None
    return with_row_id(trips, source_id, root)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone dimension from CSV: exact header; integral, non-null, unique `LocationID`."""
    header = spark.read.option("header", True).csv(path)
    if set(header.columns) != set(ZONE_COLUMNS):
        raise ContractError(f"unexpected zone header {header.columns}")
    number = F.expr("try_cast(LocationID as double)")
    bad = header.filter(number.isNull() | (number != F.floor(number)))
    repeated = header.groupBy(number.alias("id")).count().filter("count > 1")
    if bad.limit(1).count() or repeated.limit(1).count():
        raise ContractError("LocationID must be a unique non-null integer")
    return header.withColumn("LocationID", number.cast("int")).select(*ZONE_COLUMNS)


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put a finished table in the place of an older one, which stays until then."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    place, ready, aside = Path(path), Path(new), Path(f"{path}-old-{uuid.uuid4().hex}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(place)
    if had and not files.rename(place, aside):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(ready, place):
        if had:
            files.rename(aside, place)
        raise OSError(f"cannot move {new} to {path}")
    if had:
        files.delete(aside, True)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()
) -> str:
    """Replace a Parquet (ZSTD), CSV, TSV or JSON table.

    The new table is written beside the old one and takes its place only when the job is done, so a
    failed job leaves the old table. With partition columns only the partitions present in `df` are
    replaced, each when the job commits.
    """
    target = path if partition_by else f"{path}-new-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(target)
    elif fmt in ("csv", "tsv"):
        writer.option("header", True).option("sep", "," if fmt == "csv" else "\t").csv(target)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(target)
    else:
        raise ValueError(f"unknown table format {fmt!r}")
    if target != path:
        _swap(df.sparkSession, target, path)
    return path


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read back a table written by `write_table` under a declared schema."""
    reader = spark.read.schema(schema)
    if fmt in ("csv", "tsv"):
        reader = reader.option("header", True).option("sep", "," if fmt == "csv" else "\t")
    return reader.format("csv" if fmt == "tsv" else fmt).load(path)
