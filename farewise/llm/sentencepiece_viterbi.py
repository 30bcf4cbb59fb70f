"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces.

The automaton walks a piece of text once; at each position the output links give every vocabulary piece that ends
there, and a dynamic program over positions relaxes the best way to reach it.

* Unigram models: the best way has the largest sum of scores (Viterbi; of equal sums the earlier start stays).
* BPE models: scores are merge ranks, and adding them up would not give the model's ids. There the way kept at a
  position is the one whose last piece stands next to the piece before it in the merged text: of all pieces ending
  at a position exactly one does, so the same single pass yields the ids that merging gives.

Characters outside the vocabulary become byte pieces (or the unknown id where the model has none). Defined results:
null and empty texts have no ids; decoding returns the text with U+2581 shown as a blank; repeated rows are each
encoded; an empty table gives an empty result. Texts are encoded whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import bounded_batches, flat, released, slices, whole
from farewise.llm.tokens import MEMO_BYTES, TOKEN_BLOCK, PieceMemo

BLANK_SIGN = "▁"
#: Remembered answers whether two pieces may stand side by side.
MEMO_PAIRS = 1_000_000
# Kinds of pieces and of models in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, message[at : at + size]
        at += size


class SentencePieceModel(PieceMemo):
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, kind: int | None = None, memo: int = MEMO_BYTES):
        with open(path, "rb") as file:
            fields = list(_fields(file.read()))
        rows = [dict(_fields(value)) for number, value in fields if number == 1]
        trainer = dict(_fields(next((v for n, v in fields if n == 2), b"")))
        normal = dict(_fields(next((v for n, v in fields if n == 3), b"")))
        if normal.get(2):
            raise ValueError("models with a character map of their own are not supported")
        self.kind = kind or trainer.get(3, UNIGRAM)
        self.prefix = bool(normal.get(3, 1))
        self.pieces = [row[1].decode() for row in rows]
        self.scores = [struct.unpack("<f", row[2])[0] if 2 in row else 0.0 for row in rows]
        self.kinds = [row.get(3, NORMAL) for row in rows]
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - 10
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        # A newline that no piece holds stands alone; likewise nothing reaches over the border before a blank
        # unless a piece has a blank inside.
        self.lone_newline = not any("\n" in p for p in self.ids)
        self.blank_leads = not any(BLANK_SIGN in p.lstrip(BLANK_SIGN) for p in self.ids)
        shown = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN
            else p.replace(BLANK_SIGN, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(b) for b in shown])])
        self.pairs: dict[int, bool] = {}
        self.whole: list[bool | None] = [None] * len(self.pieces)
        super().__init__(memo)

    def borders(self, data: np.ndarray) -> np.ndarray:
        border = np.zeros(len(data) + 1, bool)
        if self.blank_leads:
            border[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
            # U+2581 in the text is a blank too; its last byte hides the border.
            border[1:-1] &= data[:-1] != 0x81
        if self.lone_newline:
            border[1:-1] |= (data[1:] == 10) | (data[:-1] == 10)
        return border

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair again and again, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [
                (self.scores[i], -k)
                for k in range(len(parts) - 1)
                if (i := self.ids.get(parts[k] + parts[k + 1])) is not None
            ]
            if not ranked:
                break
            k = -max(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces ends in exactly these two."""
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            found = self.pairs[key] = self._merged(a + b) == [a, b]
        return found

    def _alone(self, i: int) -> bool:
        """Whether merging the text of a piece ends in the piece itself."""
        found = self.whole[i]
        if found is None:
            found = self.whole[i] = self._merged(self.pieces[i]) == [self.pieces[i]]
        return found

    def _merged_way(self, text: str) -> list[tuple[int, int]]:
        """The way of a BPE model; the automaton gives the pieces of a position longest first."""
        own, begin = [-1] * (len(text) + 1), list(range(-1, len(text)))
        known = self.pairs.get
        for last, (i, length) in self.automaton.iter(text):
            if own[last + 1] >= 0:
                continue
            start = last + 1 - length
            before = own[start]
            if start and before >= 0:
                fits = known(before << 20 | i)
                if fits is None:
                    fits = self._adjacent(before, i)
            else:
                fits = self._alone(i)
            if fits:
                own[last + 1], begin[last + 1] = i, start
        return list(zip(begin, own, strict=True))

    def _way(self, text: str) -> list[tuple[int, int]]:
        """(start, id or -1 for an unknown character) of the piece that ends at each position."""
        if self.kind == BPE:
            return self._merged_way(text)
        n = len(text)
        ways: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for last, (i, length) in self.automaton.iter(text):
            ends[last + 1].append((last + 1 - length, i))
        best = [0.0] + [float("-inf")] * n
        for end in range(1, n + 1):
            known = False
            for start, i in sorted(ends[end]):
                known = known or start == end - 1
                score = best[start] + self.scores[i]
                if score > best[end]:
                    best[end], ways[end] = score, (start, i)
            if not known and best[end - 1] + self.unknown_score > best[end]:
                best[end], ways[end] = best[end - 1] + self.unknown_score, (end - 1, -1)
        return ways

    def encode_piece(self, piece: str) -> list[int]:
        text = piece.replace(" ", BLANK_SIGN)
        ways, end, out = self._way(text), len(text), []
        while end:
            start, i = ways[end]
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[start:end].encode())]
            else:
                out.append(self.unknown)
            end = start
        return out[::-1]

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and their offsets; the leading blank a model asks for is put in first."""
        if self.prefix and len(data):
            filled = np.flatnonzero(np.diff(offsets))
            data = np.insert(data, offsets[filled], 32)
            offsets = offsets + np.searchsorted(filled, np.arange(len(offsets)))
        return self.encode(data, offsets)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the id sequences that the offsets mark off."""
        each = np.diff(self.shown_at)[ids]
        ends = np.concatenate([[0], np.cumsum(each)])
        raw = self.shown[np.arange(ends[-1]) + np.repeat(self.shown_at[ids] - ends[:-1], each)].tobytes()
        borders = ends[offsets].tolist()
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(borders, borders[1:], strict=False)]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=2)
def model(path: str) -> SentencePieceModel:
    return SentencePieceModel(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, ids_crc32, and whether decoding the ids gives the text back."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for part in slices(batch, "text", TOKEN_BLOCK):
                ids, offsets = own.encode_texts(*flat(part.column("text")))
                texts = own.decode(ids, offsets)
                same = [a == b.replace(BLANK_SIGN, " ") for a, b in zip(texts, part.column("text").to_pylist(), strict=True)]
                raw = memoryview(ids.astype("<u4").tobytes())
                borders = offsets.tolist()
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(borders, borders[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), lists, pa.array(sums, pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(text).alias("text"))
    return rows.mapInArrow(released(run), "doc_id bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint, round_trip boolean")


def decode_documents(tokens: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and text of a table of id lists (a null list gives an empty text)."""
    bounded_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            joined = np.fromiter((i for x in lists for i in x), np.int64, int(offsets[-1]))
            texts = pa.array(own.decode(joined, offsets), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    empty = F.coalesce(F.col(ids).cast("array<int>"), F.expr("cast(array() as array<int>)"))
    return tokens.select(F.col(doc_id).cast("bigint").alias("doc_id"), empty.alias("ids")).mapInArrow(released(run), "doc_id bigint, text string")
