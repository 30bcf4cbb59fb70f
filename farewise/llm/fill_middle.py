"""Fill-in-the-middle by secondary sort: documents as pieces that one sort brings into output order.

A task cuts each text into units (a word with the blanks before it; blanks at the end are a unit of their own) and
emits pieces of up to `PIECE_BYTES` bytes, cut between units where a unit is not longer itself. A piece carries
its document's key and its place in the output, and the first piece of a part the part's mark. One shuffle by key,
sorted within partitions by (key, place), streams every document's pieces in output order, and a digest is updated
piece by piece. The reader of that stream knows a part by its mark alone, and gives each piece the place that it has in
the text; a second sort within the same partitions, without a shuffle, streams the text again and restores it.

Neither pass holds a document: memory is a piece, whatever a text's length, and Spark's sort spills. A document's key is
its place in the input (task and row), so rows with equal or null ids stay apart; the input has to be a table whose
rows a repeated task finds in the same order, as files are.

Defined results: null text is empty; an empty text, and one that holds a mark, stays plain; a null doc_id is drawn
like an empty number; repeated rows have a row each; extra columns are not read; an empty table gives an empty
result. Equal cuts give an empty middle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import bounded_batches, flat, released, slices, whole, words

PIECE_BYTES = 1 << 16
#: The marks of prefix, suffix and middle, and the parts' order in each form.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDER = {"plain": ["text"], "psm": ["prefix", "suffix", "middle"], "spm": ["suffix", "prefix", "middle"]}
#: Per cent of documents that are rearranged, and per cent of those with the suffix first.
REARRANGED, SUFFIX_FIRST, SEED = 50, 80, 42
#: The parts' order in the text, and the room that each part's pieces have there.
TEXT_ORDER = {"text": 0, "prefix": 0, "middle": 1, "suffix": 2}
PART_PLACES = 1 << 40
PIECES = "key bigint, place bigint, doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, mark binary, piece binary"
RESTORING = "key bigint, place bigint, doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, piece binary"
RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def draws(doc_id: Column) -> list[Column]:
    """Four numbers drawn for a document: the first groups of eight digits of a digest of its id."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def _chunks(ends: np.ndarray, begin: int, stop: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most `PIECE_BYTES` from `begin` to `stop`, cut at ends of units where one is near enough."""
    while stop - begin > PIECE_BYTES:
        at = int(np.searchsorted(ends, begin + PIECE_BYTES, side="right")) - 1
        end = int(ends[at]) if at >= 0 and ends[at] > begin else begin + PIECE_BYTES
        yield begin, end
        begin = end
    yield begin, stop


def _emit(rows: Iterator[tuple], names: list[str], types: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches of about `limit` bytes of pieces."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or b"")
        if size > limit:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types.field(n).type) for n, c in zip(names, columns, strict=True)], schema=types)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to pieces in output order."""

    def rows() -> Iterator[tuple]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                starts, ends, first = words(data, offsets)
                letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
                raw = data.tobytes()
                fields = [part.column(k).to_pylist() for k in ("doc_id", "h1", "h2", "h3", "h4")]
                for k, (doc_id, h1, h2, h3, h4) in enumerate(zip(*fields, strict=True)):
                    begin, stop = int(offsets[k]), int(offsets[k + 1])
                    borders = ends[first[k] : first[k + 1]]
                    if stop > begin and (not len(borders) or borders[-1] < stop):
                        borders = np.append(borders, stop)  # blanks at the end
                    n = len(borders)
                    plain = h3 % 100 >= REARRANGED or begin == stop or any(raw.find(m, begin, stop) >= 0 for m in MARKS.values())
                    form = "plain" if plain else "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = (int(borders[c - 1]) if c else begin for c in (low, high))
                    spans = {"text": (begin, stop), "prefix": (begin, a), "middle": (a, b), "suffix": (b, stop)}
                    chars = (None, None) if plain else (int(letters[a] - letters[begin]), int(letters[b] - letters[a]))
                    place = 0
                    for name in ORDER[form]:
                        mark = MARKS.get(name, b"")
                        for x, y in _chunks(borders, *spans[name]):
                            head = (doc_id, n, form, *chars) if place == 0 else (None,) * 5
                            yield key, place, *head, mark, raw[x:y]
                            place, mark = place + 1, b""
                    key += 1

    names = [c.split()[0] for c in PIECES.split(", ")]
    return _emit(rows(), names, _schema(PIECES))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The rows of sorted batches one by one."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        yield from zip(*columns, strict=True)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order to the output's digest, and to pieces placed by the marks met on the way."""
    by_mark = {mark: TEXT_ORDER[name] for name, mark in MARKS.items()}

    def rows() -> Iterator[tuple]:
        now, head, digest, part, count = None, None, None, 0, 0
        for key, _, *fields, mark, piece in _stream(batches):
            if key != now:
                if now is not None:
                    yield now, -1, *head, digest.hexdigest(), None
                now, head, digest, part, count = key, fields, hashlib.sha256(), 0, 0
            digest.update(mark + piece)
            if mark:
                part, count = by_mark[mark], 0
            yield key, part * PART_PLACES + count, *(None,) * 6, piece
            count += 1
        if now is not None:
            yield now, -1, *head, digest.hexdigest(), None

    return _emit(rows(), [c.split()[0] for c in RESTORING.split(", ")], _schema(RESTORING))


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in text order, behind a row with the document's figures, to one row with the text's digest."""

    def rows() -> Iterator[tuple]:
        head, digest = None, None
        for _, place, *fields, piece in _stream(batches):
            if place < 0:
                if head is not None:
                    yield *head, digest.hexdigest()
                head, digest = fields, hashlib.sha256()
            else:
                digest.update(piece)
        if head is not None:
            yield *head, digest.hexdigest()

    return _emit(rows(), [c.split()[0] for c in RESULT.split(", ")], _schema(RESULT))


def output_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents' pieces, each document's within one partition in output order.

    The output of a document is mark and piece of its rows, end to end. The row of place 0 has its doc_id, number of
    units, form and lengths.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(text).alias("text"), *draws(F.col(doc_id)))
    return rows.mapInArrow(released(_cut), PIECES).repartition("key").sortWithinPartitions("key", "place")


def restored_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces in text order, from pieces in output order; each document begins with a row of place -1 of its figures."""
    return pieces.mapInArrow(released(_assemble), RESTORING).sortWithinPartitions("key", "place")


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its form, lengths, and digests of its output and of the text restored from it."""
    return restored_pieces(output_pieces(docs, text, doc_id)).mapInArrow(released(_restore), RESULT)
