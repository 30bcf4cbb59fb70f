"""Shared helpers: tables cut into the shared folder, and texts as flat byte arrays.

Inside a task a block of texts is one `uint8` array with document offsets. Words, lines and their
64-bit fingerprints are found with whole-array operations, so the cost per byte stays small and
the memory of a block is bounded (a text longer than a block forms a block of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.session import scratch_path

BLOCK_BYTES = 2 << 20
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
BACK = pow(BASE, -1, 1 << 64)


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: executors may then be lost freely."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables made by `cut` that no later result reads."""
    for table in tables:
        spark: SparkSession = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def whole(column: Column | str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slices(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `limit` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        used = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, used + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offset of each text (nulls are empty)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    if where is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and the first word of each text."""
    return runs(~BLANK[data], offsets)


def runs(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes within each text, and the first run of each text."""
    before = np.zeros_like(ink)
    before[1:] = ink[:-1]
    after = np.zeros_like(ink)
    after[:-1] = ink[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)
_powers: dict[int, np.ndarray] = {}


def times_step(k: int) -> np.uint64:
    """`k` steps, modulo 2 ** 64."""
    return np.uint64(k * int(STEP) % (1 << 64))


def powers(base: int, n: int) -> np.ndarray:
    """`base` to the powers 0 to n - 1, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _powers[base] = np.multiply.accumulate(table)
    return _powers[base][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """64-bit fingerprints of ascending, disjoint byte spans; equal bytes give equal values."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + piece, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        n = high - low
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[low:high]] * powers(BASE, n), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * powers(BACK, n + 1)[s] + (e - s).astype(np.uint64) * STEP
        i = j
    return mixed(out)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of each run of `width` consecutive values (one fewer value per step at the end)."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(powers(BASE, width)):
        out += hashes[k : k + n] * factor
    return mixed(out + times_step(width))


def per_text(first: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Sum of `marks` (one per word or byte) over each text, where `first` has the n + 1 borders."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's way to hand freed memory back to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for `mapInArrow`, handing its memory back when a partition ends: workers stay for later tasks."""

    def whole_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = _trim()
            if trim is not None:
                trim(0)

    return whole_partition


def bounded_batches(spark: SparkSession, limit: int = 16 << 20) -> None:
    """Let Spark hand Python at most about `limit` bytes per Arrow batch, whatever the texts' length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not now or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > limit:
        spark.conf.set(key, str(limit))
