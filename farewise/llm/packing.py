"""Vector bin packing of token sequences under several limits at once.

A sequence has room for a number of tokens, of segments and of loss-bearing tokens. An example is a vector of the
same three sizes, each relative to its limit; the next example of the open sequence is the one that fits and has the
largest dot product with the room that is left. Where cutting is allowed, the room that no whole example fits is
filled with the beginning of one, and the rest of it goes back to the examples.

Each task packs the examples of its own partition as they stream by and holds a bounded number of them, so nothing is
shuffled, no key can be hot, and a lost task is simply run again. Only a task's last sequence stays open.

Defined results: a null text is empty (its end id alone); no id is dropped or repeated; an example with more than a
sequence's tokens is cut even where cutting is not asked for, as it fits no sequence. Repeated rows are packed each
for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import bounded_batches, flat, released, slices, whole
from farewise.llm.tokens import TOKEN_BLOCK, encoder, with_end

POOL = 2048
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, loss_tokens bigint"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Packer:
    """Packs examples one pool at a time. An example is (row, start, length, first loss-bearing token).

    `finish` and `feed` return sequences: lists of such examples that share one sequence.
    """

    def __init__(self, limits: Limits, cuts: bool, pool: int = POOL):
        self.limits, self.cuts, self.pool = limits, cuts, pool
        self.items: list[tuple[int, int, int, int]] = []

    def _loss(self, start: int, length: int, first: int) -> int:
        return max(0, start + length - max(start, first))

    def _head(self, start: int, length: int, first: int, room: int, room_loss: int) -> int:
        """The largest beginning of an example that fits the room."""
        free = max(0, min(length, first - start))
        return min(room, length, free + room_loss)

    def feed(self, row: int, length: int, first: int) -> Iterator[list[tuple[int, int, int, int]]]:
        start, lim = 0, self.limits
        while length - start > 0:
            head = self._head(start, length - start, first, lim.tokens, lim.loss)
            if head == length - start and head < lim.tokens:
                break
            yield [(row, start, head, first)]
            start += head
        if length > start:
            self.items.append((row, start, length - start, first))
            if len(self.items) >= self.pool:
                yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[list[tuple[int, int, int, int]]]:
        lim = self.limits
        items = self.items
        size = np.array([(n, 1, self._loss(s, n, f)) for _, s, n, f in items], np.float64).reshape(-1, 3)
        caps = np.array([lim.tokens, lim.segments, lim.loss], np.float64)
        share = size / caps
        live = np.ones(len(items), bool)
        left = len(items)
        keep: list[tuple[int, int, int, int]] = []
        while left:
            room, chosen = caps.copy(), []
            while left and room[1] >= 1:
                fits = live & (size <= room).all(axis=1)
                score = np.where(fits, share @ (room / caps), -1.0)
                best = int(score.argmax())
                if not fits[best]:
                    break
                chosen.append(items[best])
                room -= size[best]
                live[best] = False
                left -= 1
            full = room[0] < 1 or room[1] < 1 or room[2] < 1
            if self.cuts and left and not full:
                # The longest example loses its beginning to the room that is left.
                long = int(np.where(live, size[:, 0], -1).argmax())
                row, start, length, first = items[long]
                head = self._head(start, length, first, int(room[0]), int(room[2]))
                if 0 < head < length:
                    chosen.append((row, start, head, first))
                    items[long] = (row, start + head, length - head, first)
                    size[long] = (length - head, 1, self._loss(start + head, length - head, first))
                    share[long] = size[long] / caps
                    full = True
            if not last and not left and not full:
                keep = chosen  # may still be filled by examples to come
                break
            yield chosen
        self.items = keep

    def finish(self) -> Iterator[list[tuple[int, int, int, int]]]:
        yield from self.pack(last=True)


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, limits: Limits = Limits(), cuts: bool = True,
    text: str = "text", doc_id: str = "doc_id", prompt: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    With `prompt`, that column's ids stand before the text's and bear no loss; without it all ids do.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = Packer(limits, cuts), {}
        number, serial, out = TaskContext.get().partitionId() << 32, 0, []

        def emit(sequences: Iterator[list[tuple[int, int, int, int]]]) -> None:
            nonlocal number
            for sequence in sequences:
                at = 0
                for row, start, length, first in sequence:
                    name, ids, total = held[row][:3]
                    raw = ids[start : start + length].astype("<u4").tobytes()
                    out.append((name, start, length, zlib.crc32(raw), total, number, at, packer._loss(start, length, first)))
                    at += length
                    held[row][3] -= length
                    if not held[row][3]:
                        del held[row]
                number += 1

        def flush() -> pa.RecordBatch:
            names = [c.split()[0] for c in PIECES.split(", ")]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            out.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text", TOKEN_BLOCK):
                ids, offsets = with_end(*encoder(vocabulary).encode(*flat(part.column("text"))), end_id)
                firsts = [0] * part.num_rows
                if prompt:
                    before, borders = encoder(vocabulary).encode(*flat(part.column("prompt")))
                for i, name in enumerate(part.column("doc_id").to_pylist()):
                    own = ids[offsets[i] : offsets[i + 1]]
                    if prompt:
                        own = np.concatenate([before[borders[i] : borders[i + 1]], own])
                        firsts[i] = int(borders[i + 1] - borders[i])
                    held[serial] = [name, own.copy(), len(own), len(own)]
                    emit(packer.feed(serial, len(own), firsts[i]))
                    serial += 1
                if out:
                    yield flush()
        emit(packer.finish())
        if out:
            yield flush()

    columns: list[Column] = [F.col(doc_id).cast("bigint").alias("doc_id"), whole(text).alias("text")]
    if prompt:
        columns.append(whole(prompt).alias("prompt"))
    return docs.select(*columns).mapInArrow(released(run), PIECES)
