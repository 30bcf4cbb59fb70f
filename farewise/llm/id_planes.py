"""Token ids stored as compressed bit or byte planes with a chunk index.

File format. A segment holds the ids of whole documents. Its ids are cut into blocks of a fixed number; a block is
transposed into planes (bit k, or byte k, of every id), each plane that has a set bit is compressed with zstandard, and
the others take no bytes. The block index (place, number of ids, bytes of each plane) and the documents' ids and
lengths stand beside the payload. Segments are rows of a Parquet table without further compression, so that any
store Spark can write holds the files, a lost executor's task leaves nothing behind, and segments are read in
parallel; rows are in ascending doc_id order by (shard, segment).

Defined results: null text is empty and yields the end id alone; null doc_ids come first; rows of equal id stand side
by side in the order of a hash of their text; an empty table gives an empty file table. Ids are those of whole texts; a text longer than a segment is a segment of
its own. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farewise.llm.common import bounded_batches, flat, released, slices, whole
from farewise.llm.tokens import TOKEN_BLOCK, encoder, with_end
from farewise.session import scratch_path

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 18
SEGMENTS = (
    "shard int, segment int, start bigint, n_ids bigint, kind string, doc_ids array<bigint>, lengths array<bigint>, "
    "block_at array<bigint>, block_ids array<bigint>, plane_bytes array<bigint>, payload binary"
)
DOCS = "doc_id bigint, shard int, segment int, start bigint, n_tokens bigint, ids_crc32 bigint"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block, lowest first: 32 bit planes or 4 byte planes. A plane without a set bit is empty."""
    used = int(np.bitwise_or.reduce(ids)) if len(ids) else 0
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, k].tobytes() if used >> 8 * k & 255 else b"" for k in range(4)]
    bits = np.unpackbits(octets[:, : -(-used.bit_length() // 8)], axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() if used >> k & 1 else b"" for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """Inverse of `to_planes`; an empty plane is all zero."""
    if kind == "byte":
        octets = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                octets[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little")[:n]
        octets = np.packbits(bits, axis=1, bitorder="little")
    return octets.reshape(-1).view("<u4").astype(np.uint32)


def pack_segment(ids: np.ndarray, kind: str, level: int = 3) -> tuple[bytes, list[int], list[int], list[int]]:
    """Payload and block index (places, ids per block, bytes per plane) of a segment."""
    press = zstandard.ZstdCompressor(level=level)
    payload, at, counts, sizes = [], [], [], []
    place = 0
    for begin in range(0, len(ids), BLOCK_IDS):
        block = ids[begin : begin + BLOCK_IDS]
        at.append(place)
        counts.append(len(block))
        for plane in to_planes(block, kind):
            packed = press.compress(plane) if plane else b""
            payload.append(packed)
            sizes.append(len(packed))
            place += len(packed)
    return b"".join(payload), at, counts, sizes


def unpack_block(payload: bytes, at: int, n: int, sizes: list[int], kind: str) -> np.ndarray:
    """The ids of one block, found through the index alone."""
    open_ = zstandard.ZstdDecompressor()
    planes = []
    for size in sizes:
        planes.append(open_.decompress(payload[at : at + size]) if size else b"")
        at += size
    return from_planes(planes, n, kind)


def write_ids(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, kind: str = "bit", text: str = "text", doc_id: str = "doc_id"
) -> None:
    """Encode every text, append `end_id` and write the segments in ascending doc_id order.

    Texts are dealt by ranges of doc_id (ties by a hash of the text), sorted within a range and encoded there.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        names, parts, lengths, held = [], [], [], 0
        schema = pa.schema([
            ("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("kind", pa.string()),
            *[(n, pa.list_(pa.int64())) for n in ("doc_ids", "lengths", "block_at", "block_ids", "plane_bytes")], ("payload", pa.binary()),
        ])

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            payload, at, counts, sizes = pack_segment(ids, kind)
            row = [shard, segment, start, len(ids), kind, list(names), list(lengths), at, counts, sizes, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for part in slices(batch, "text", TOKEN_BLOCK):
                ids, offsets = with_end(*encoder(vocabulary).encode(*flat(part.column("text"))), end_id)
                ids_of = part.column("doc_id").to_pylist()
                begin = 0
                while begin < len(ids_of):
                    # As many whole documents as fill the segment.
                    need = offsets[begin] + SEGMENT_IDS - held
                    stop = min(len(ids_of), int(np.searchsorted(offsets, need, side="left")))
                    stop = max(stop, begin + 1)
                    parts.append(ids[offsets[begin] : offsets[stop]])
                    names += ids_of[begin:stop]
                    lengths += np.diff(offsets[begin : stop + 1]).tolist()
                    held += int(offsets[stop] - offsets[begin])
                    begin = stop
                    if held >= SEGMENT_IDS:
                        yield close()
                        segment, start = segment + 1, start + held
                        names, parts, lengths, held = [], [], [], 0
        if held:
            yield close()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(text).alias("text"))
    order = ["doc_id", "tie"]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    out = rows.select("doc_id", "text").mapInArrow(released(run), SEGMENTS)
    out.write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document: place and number of its ids and their crc32, decoded from the files.

    `start` counts within the shard; `document_starts` makes it global.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                each = len(row["plane_bytes"]) // max(1, len(row["block_ids"]))
                ids = np.concatenate([
                    unpack_block(row["payload"], at, n, row["plane_bytes"][i * each : (i + 1) * each], row["kind"])
                    for i, (at, n) in enumerate(zip(row["block_at"], row["block_ids"], strict=True))
                ])
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()),
                        pa.array(starts + row["start"]), pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "shard", "segment", "start", "n_tokens", "ids_crc32"],
                )

    bounded_batches(spark)
    return spark.read.schema(SEGMENTS).parquet(path).mapInArrow(released(run), DOCS)


def document_starts(spark: SparkSession, path: str) -> DataFrame:
    """`read_ids` with `start` counted over all documents before. One row per shard is summed up for it."""
    shards = spark.read.schema(SEGMENTS).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return (
        read_ids(spark, path)
        .join(shards, "shard")
        .select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")
    )


def store_and_read(docs: DataFrame, vocabulary: str, end_id: int, kind: str = "bit") -> DataFrame:
    """Write all documents to a new file table in the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "id-planes")
    write_ids(docs, path, vocabulary, end_id, kind)
    return document_starts(docs.sparkSession, path)
