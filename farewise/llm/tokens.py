"""Whole-text token ids at the cost of a dictionary look-up per word.

The vocabularies used here never merge across the border before a blank that follows a visible character, so a text
is cut there, the distinct pieces of a block are encoded once by the tokenizers library, and the ids are gathered
back. Pieces that a block has more than once are remembered for the next ones, within a bounded number of bytes. A
vocabulary file that declares other rules than the two known kinds is given whole texts. `check_pieces` in the tests
holds the result against the library's own encoding of the whole text.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from farewise.llm.common import BLANK

#: Bytes that remembered pieces may take, about, counting `PIECE_COST` bytes for each besides its text and ids.
MEMO_BYTES = 32 << 20
PIECE_COST = 160
MEMO_PARTS = 50_000
TOKEN_BLOCK = 4 << 20
# The word patterns that the two vocabularies declare.
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Scripts for which the pattern classes are stable; pieces with other characters go to the library whole.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*\Z")
MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[]^_`{|}~")
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = True
# The first two bytes of the three-byte blanks (and of some visible characters, which are not cut after).
BLANK_LEADS = [(0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def gather(pool: np.ndarray, first: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the pool end to end, and where each ends (with a leading zero)."""
    ends = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=ends[1:])
    kind = np.int32 if max(ends[-1], len(pool)) < 1 << 31 else np.int64
    take = np.repeat((first - ends[:-1]).astype(kind), each)
    take += np.arange(ends[-1], dtype=kind)
    return pool[take], ends


class PieceMemo:
    """Cuts texts into pieces that encode independently, and encodes each distinct piece of a block once.

    Memory between blocks is bounded: it starts over when its pieces take more than `memo` bytes.
    """

    def __init__(self, memo: int = MEMO_BYTES):
        self.memo_bytes = memo
        self._forget()

    def _forget(self) -> None:
        """Start over with an empty memory: piece -> number, and the numbered pieces' ids end to end."""
        self.number: dict[bytes, int] = {}
        self.pool, self.first, self.each = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def encode_piece(self, piece: str) -> list[int]:
        raise NotImplementedError

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return list(map(self.encode_piece, pieces))

    def borders(self, data: np.ndarray) -> np.ndarray:
        """Marks of the bytes before which a text may be cut; the last mark stands for the end."""
        raise NotImplementedError

    def _remember(self, keys: list[bytes], ids: np.ndarray, each: np.ndarray) -> None:
        cost = sum(map(len, keys)) + PIECE_COST * len(keys) + 4 * len(ids)
        if self.held + cost > self.memo_bytes:
            self._forget()
        if cost > self.memo_bytes:
            return
        self.held += cost
        self.number.update(zip(keys, range(len(self.first), len(self.first) + len(keys)), strict=True))
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(each) - each])
        self.each = np.concatenate([self.each, each])
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32), and the offset of each text's ids."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        border = self.borders(data)
        border[offsets] = True
        at = np.flatnonzero(border)
        coded = pa.Array.from_buffers(
            pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        keys, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(known < 0)
        lists = self.encode_pieces([keys[i].decode() for i in new.tolist()])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        fresh = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        pool = np.concatenate([self.pool, fresh])
        first, each = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        old = known >= 0
        first[old], each[old] = self.first[known[old]], self.each[known[old]]
        first[new], each[new] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
        # What a block has but once is likely rare, and not remembered.
        again = new[np.bincount(of, minlength=len(keys))[new] > 1]
        if len(again):
            self._remember([keys[i] for i in again.tolist()], gather(pool, first[again], each[again])[0], each[again])
        del keys, lists
        ids, ends = gather(pool, first[of], each[of])
        return ids, ends[np.searchsorted(at, offsets)]


def known_rules(declared: dict) -> str | None:
    """"byte" or "word" for a vocabulary file whose rules are the ones written here, else nothing."""
    normalizer, cutter = declared.get("normalizer"), declared.get("pre_tokenizer") or {}
    if declared["model"].get("type") != "BPE" or declared["model"].get("ignore_merges") or declared["model"].get("dropout"):
        return None
    if normalizer is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space"):
        return "byte"
    steps = [n.get("type") for n in (normalizer or {}).get("normalizers", [])]
    cuts = cutter.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]:
        same = cuts[0]["pattern"].get("Regex", "").replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}") == WORD_PATTERN.pattern
        blanks = normalizer["normalizers"][1]
        dropped = cuts[0].get("invert") and cuts[0].get("behavior") == "Removed" and not cuts[1].get("use_regex") and not cuts[1].get("add_prefix_space")
        if same and dropped and blanks["pattern"].get("Regex") == r"\s+" and blanks["content"] == " ":
            return "word"
    return None


class PieceEncoder(PieceMemo):
    """Encodes pieces with one of the library's vocabularies and remembers a bounded number of them."""

    def __init__(self, path: str, memo: int = MEMO_BYTES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            self.rules = known_rules(json.load(file))
        self.lowers = self.rules == "word"
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.parts: dict[str, list[int]] = {}
        super().__init__(memo)

    def _part(self, part: str) -> list[int]:
        found = self.parts.get(part)
        if found is None:
            if part.isascii():
                letters = part.replace(" ", "Ġ").replace("\n", "Ċ").replace("\t", "ĉ").replace("\r", "č")
            else:
                letters = "".join(map(self.letters.__getitem__, part.encode()))
            if len(self.parts) >= MEMO_PARTS:
                self.parts.clear()
            found = [t.id for t in self.model.tokenize(letters)]
            if len(part) < 64:
                self.parts[part] = found
        return found

    def _word(self, word: str) -> list[int]:
        """Ids of letters of plain scripts, in "byte" vocabularies with the blank before them."""
        if self.lowers:
            word = word.lower() if word.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", word)])
        shown = word.replace(" ", "Ġ") if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(shown)]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Plain words, with one mark behind them or none, go straight to the model; all else takes the longer way."""
        if self.rules is None:
            return [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        out, lowers = [], self.lowers
        for piece in pieces:
            bare = piece[1:] if piece[0] == " " else piece
            if bare.isalpha() and (bare.isascii() or PLAIN.match(bare) and "İ" not in bare):  # its small letter is two
                out.append(self._word(bare if lowers else piece))
            elif bare.isascii() and bare[-1:] in MARKS and bare[:-1].isalpha():
                out.append(self._word(bare[:-1] if lowers else piece[:-1]) + self._part(bare[-1]))
            else:
                out.append(self.encode_piece(piece))
        return out

    def encode_piece(self, piece: str) -> list[int]:
        bare = piece.lstrip(" \n\t\r")
        if piece.isascii() and bare.isprintable() or PLAIN.match(piece):
            if self.lowers:
                if not piece.isascii():
                    bare = "".join([c.lower() for c in unicodedata.normalize("NFC", bare)])
                    return [i for part in WORD_PATTERN.findall(bare) for i in self._part(part)]
                bare = bare.lower()
                if bare.isalpha():
                    return self._part(bare)
                return [i for part in WORD_PATTERN.findall(bare) for i in self._part(part)]
            if piece.isascii() and bare.isalpha() and len(piece) - len(bare) == (piece[0] == " "):
                return self._part(piece)
            return [i for part in BYTE_PATTERN.findall(piece) for i in self._part(part)]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def borders(self, data: np.ndarray) -> np.ndarray:
        border = np.zeros(len(data) + 1, bool)
        if self.rules is None:
            return border
        at = np.flatnonzero(BLANK[data[1:]]) + 1
        one, two, three, four = (data[np.maximum(at - k, 0)] for k in (1, 2, 3, 4))
        visible = VISIBLE[one]
        # The character before the blank may have two bytes (not C2, which leads blanks), three (not those of a blank) or four.
        tail = (one & 0xC0) == 0x80
        visible |= tail & (two >= 0xC3) & (two < 0xE0)
        tail &= (two & 0xC0) == 0x80
        wide = tail & (three >= 0xE0) & (three < 0xF0)
        for first, second in BLANK_LEADS:
            wide &= (three != first) | (two != second)
        visible |= wide | (tail & ((three & 0xC0) == 0x80) & (four >= 0xF0))
        border[at[visible]] = True
        return border


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder per vocabulary and Python worker; its memory of pieces serves later tasks too."""
    return PieceEncoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The id `end` added to each text."""
    counts = np.diff(offsets)
    borders = offsets + np.arange(len(offsets))
    out = np.full(borders[-1], end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, borders
