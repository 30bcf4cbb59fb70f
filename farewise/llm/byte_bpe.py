"""Byte-level BPE by Spark's higher-order functions: ranked merges folded over the bytes of distinct words.

Every piece of a vocabulary has a letter: U+0000 to U+00FF are the bytes themselves, the letters after them the longer
pieces in order of rank. A word is then a string whose letters are its parts, at first its bytes. The rank map, a
literal of the plan, gives for two letters the number of the piece they merge into; it is an array of small maps dealt
by a hash of their keys, so that a look-up reads one map of an entry or two. `aggregate` merges, step by step, the
leftmost pair of lowest rank until no pair has a rank.

A piece can only ever be made of the two parts that it falls into when it is encoded by itself: before it forms, the
merges inside its span are those of the piece alone. So the map holds one pair a piece.

Texts are cut into words by the vocabulary's pattern in the JVM. Words repeat, so a task gathers documents into
blocks of `BLOCK_WORDS` words, numbers the distinct words of a block, folds each of them once and gathers the ids
back: one row per block between two Arrow steps, nothing is shuffled, and a lost task repeats its own files only.
Decoding looks every id up in a literal table of binary pieces and joins them.

A step of the fold reads all pairs of a word, so words of more than `LONG_WORD` bytes go to the tiktoken library's
merge of a single piece instead, whose time grows almost in proportion; both give the same ids.

Defined results: null text is empty and has no ids; an empty text decodes to no bytes; null and repeated doc_ids and
rows keep a row each; extra columns are not read; an empty table gives an empty result. Ties of rank are merged from
the left. A block ends with a batch, so a very long text is
in one block with what stands before it.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import bounded_batches, released, whole

#: Words of a block, repeats included, and bytes of the batches that it is gathered from.
BLOCK_WORDS = 7_000_000
BATCH_BYTES = 4 << 20
LONG_WORD = 256
BUCKETS = 1 << 16
#: Merges applied to all words of a block at once.
HEAD_MERGES = 48
#: Places of a word fit below this factor, so that rank and place sort as one number.
PLACES = 1 << 10
BYTES = "ISO-8859-1"

# White space, and the letters and numbers assigned in Unicode 14 to 16, which an older Java may not
# know and the vocabulary's library does.
WHITE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NEW_LETTERS = """
870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3
A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC
105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075
1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02
11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF
1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD
1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D
31350-323AF
"""
NEW_NUMBERS = """
10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3
1E4F0-1E4F9 1E5F1-1E5FA
"""


def _ranges(codes: str) -> str:
    """A character class of the listed code points; one comparison turns all older characters away."""
    parts = ["-".join(f"\\x{{{c}}}" for c in item.split("-")) for item in codes.split()]
    return r"[\x{870}-\x{10FFFF}&&[" + "".join(parts) + "]]"


_LETTER, _NUMBER = r"\p{L}" + _ranges(NEW_LETTERS), r"\p{N}" + _ranges(NEW_NUMBERS)
#: `public_tokenizers.PATTERN` in Java's notation.
WORD = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{WHITE}{_LETTER}{_NUMBER}]+"
    rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """The pieces of a rank file and their ids; every single byte must be a piece."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} has no piece for {len(missing)} of the 256 bytes")
    return ranks


class Pieces:
    """A vocabulary's pieces with their letters, and the pair of parts that each longer piece is made of."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        longer = sorted((rank, piece) for piece, rank in ranks.items() if len(piece) > 1)
        self.pieces = [bytes([b]) for b in range(256)] + [piece for _, piece in longer]
        self.ids = np.array([ranks[piece] for piece in self.pieces], np.int32)
        self.numbers = {piece: n for n, piece in enumerate(self.pieces)}
        split = {n: [self.numbers[p] for p in self.parts(self.pieces[n])] for n in range(256, len(self.pieces))}
        self.pairs = {n: parts for n, parts in split.items() if len(parts) == 2}
        #: Pieces that no merge reaches, by the ids that they fall into: they stand for a word that equals them.
        self.whole = {tuple(self.ids[parts].tolist()): int(self.ids[n]) for n, parts in split.items() if len(parts) > 2}
        #: Whether every piece comes after its parts, so that merges may be applied rank by rank.
        self.in_order = all(n > max(parts) for n, parts in self.pairs.items())

    @staticmethod
    def letter(number: int) -> str:
        return chr(number if number < 0xD800 else number + 0x800)

    def parts(self, piece: bytes) -> list[bytes]:
        """What a piece falls into when its last merge is withheld."""
        parts, none = [piece[i : i + 1] for i in range(len(piece))], len(self.pieces)
        while len(parts) > 2:
            found = [self.numbers.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(found)
            if low == none:
                break
            at = found.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merges(self) -> list[tuple[str, int]]:
        """Two letters and the number of the piece they merge into, in order of rank."""
        return [("".join(map(self.letter, pair)), number) for number, pair in self.pairs.items()]

    def first_merges(self) -> list[tuple[str, str]]:
        """The merges applied to a whole block: two letters and the letter of the piece they merge into."""
        return [(pair, self.letter(n)) for pair, n in self.merges()[: HEAD_MERGES if self.in_order else 0]]


def _ids_of(folded: pa.Array, ids_by_number: np.ndarray, whole_words: dict[tuple, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words given in letters, end to end, and how many each word has (nulls have none)."""
    counts = pc.fill_null(pc.utf8_length(folded), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(folded)], pa.int32()), pc.fill_null(folded, "")), "")[0]
    codes = np.frombuffer((text.as_py() or "").encode("utf-32-le"), np.uint32).astype(np.int64)
    ids = ids_by_number[codes - 0x800 * (codes >= 0xE000)]
    if whole_words:
        ends = np.cumsum(counts)
        for k, (start, end) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
            own = whole_words.get(tuple(ids[start:end].tolist()))
            if own is not None:
                ids[start:end], counts[k] = -1, 1
                ids[start] = own
        ids = ids[ids >= 0]
    return ids, counts


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def hashed_table(entries: list[tuple[str, int]]) -> Column:
    """A literal map: maps of a few entries each, at the low bits of their keys' hash."""
    table: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for key, value in entries:
        table[xxhash.xxh64_intdigest(key.encode(), seed=42) & (BUCKETS - 1)][key] = value
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def string_table(strings: list[str | None]) -> Column:
    """A literal array of strings."""
    return F.from_json(F.lit(json.dumps(strings)), "array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def look_up(table: Column, key: Column) -> Column:
    """The value of a `hashed_table`, or null."""
    return F.element_at(F.get(table, F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), key)


def merge_word(merges: Column, letters: Column, word: Column) -> Column:
    """The parts of one word, given and returned in letters."""

    def merge(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.char_length(parts) - 1), lambda at: F.substr(parts, at, F.lit(2)))
        ranked = F.transform(pairs, lambda pair, before: look_up(merges, pair) * PLACES + before)

        def join(low: Column) -> Column:
            at = low.bitwiseAND(F.lit(PLACES - 1)) + 1
            piece = F.get(letters, F.shiftright(low, PLACES.bit_length() - 1))
            return F.when(low.isNull(), parts).otherwise(F.concat(F.substr(parts, F.lit(1), at - 1), piece, F.substr(parts, at + 2)))

        return F.when(F.char_length(parts) > 1, let(F.array_min(ranked), join)).otherwise(parts)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(word)), word, lambda parts, _: merge(parts))


def in_letters(text: Column) -> Column:
    """The UTF-8 bytes of a string, as letters."""
    return F.decode(F.encode(text, "UTF-8"), BYTES)


def _gather_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, words) gathered into one row per block: ids, word counts, distinct words and their numbers.

    The numbers are compressed, as they only pass through the JVM.
    """
    names, counts, coded, size = [], [], [], 0

    def block() -> pa.RecordBatch:
        chunks = pa.chunked_array(coded).unify_dictionaries().chunks
        numbers = np.concatenate([c.indices.to_numpy() for c in chunks])
        packed = zstandard.compress(numbers.astype("<i4").tobytes(), 1)
        row = [pa.chunked_array(names).combine_chunks(), pa.chunked_array(counts).combine_chunks(), chunks[-1].dictionary]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in row]
        for held in (names, counts, coded):
            held.clear()
        return pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.binary())], names=["doc_ids", "counts", "words", "numbers"])

    for batch in batches:
        coded.append(batch.column("words").flatten().dictionary_encode())
        names.append(batch.column("doc_id"))
        counts.append(batch.column("words").value_lengths().cast(pa.int32()))
        size += len(coded[-1]) + len(batch)
        if size > BLOCK_WORDS:
            yield block()
            size = 0
    if names:
        yield block()


def _spread(batches: Iterator[pa.RecordBatch], path: str, ids_by_number: np.ndarray, whole_words: dict, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Blocks of folded words back to documents and their ids, some `rows` words at a time."""
    library = None
    for block in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
        doc_ids, counts, folded, long_words = (block.column(k)[0].values for k in range(4))
        numbers = np.frombuffer(zstandard.decompress(block.column("numbers")[0].as_py()), "<i4")
        pool, each = _ids_of(folded, ids_by_number, whole_words)
        first = np.cumsum(each) - each
        if len(long_words):
            library = library or tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
            more = [np.array(library._encode_single_piece(w.encode()), np.int32) for w in long_words.to_pylist()]
            places = np.flatnonzero(folded.is_null().to_numpy(zero_copy_only=False))
            each[places] = [len(m) for m in more]
            first[places] = len(pool) + np.cumsum(each[places]) - each[places]
            pool = np.concatenate([pool, *more])
        ends = np.concatenate([[0], np.cumsum(counts.to_numpy(), dtype=np.int64)])
        begin = 0
        while begin < len(doc_ids):
            stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + rows, side="right")) - 1)
            of = numbers[ends[begin] : ends[stop]]
            upto = np.concatenate([[0], np.cumsum(each[of])])
            ids = pool[np.repeat(first[of] - upto[:-1], each[of]) + np.arange(upto[-1])]
            borders = upto[ends[begin : stop + 1] - ends[begin]]
            packed = [None, pa.py_buffer((4 * borders).astype(np.int32)), pa.py_buffer(ids.astype("<i4"))]
            columns = [
                doc_ids.slice(begin, stop - begin), pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids, pa.int32())),
                pa.Array.from_buffers(pa.binary(), stop - begin, packed),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "packed"])
            begin = stop


def fold_words(words: Column | str, own: Pieces) -> Column:
    """The parts of each word of an array, in letters; null for words of more than `LONG_WORD` bytes.

    All words, joined, first undergo the `HEAD_MERGES` merges of lowest rank one after the other, which for
    these most frequent pairs is cheaper than to look them up word by word.
    """
    merges, letters = hashed_table(own.merges()), string_table([own.letter(n) for n in range(len(own.pieces))])
    gap = own.letter(len(own.pieces))
    short = F.transform(words, lambda w: F.when(F.octet_length(w) <= LONG_WORD, in_letters(w)).otherwise(""))
    joined = F.array_join(short, gap)
    first = own.first_merges()
    if first:
        table = F.from_json(F.lit(json.dumps(first)), "array<array<string>>")
        joined = F.aggregate(table, joined, lambda s, pair: F.replace(s, F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))
    # No word is empty but those left out.
    return let(
        merges,
        lambda m: let(letters, lambda s: F.transform(F.split(joined, gap), lambda w: F.when(w != "", merge_word(m, s, w)))),
    )


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document by the ranks in the file `path`: doc_id, ids (array<int>), and the same ids `packed` as
    little-endian unsigned 32-bit integers.
    """
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    own = pieces_of(path)
    words = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0)).alias("words")
    )
    blocks = words.mapInArrow(released(_gather_blocks), "doc_ids array<bigint>, counts array<int>, words array<string>, numbers binary")
    long_words = F.filter("words", lambda w: F.octet_length(w) > LONG_WORD)
    blocks = blocks.select("doc_ids", "counts", fold_words("words", own).alias("folded"), long_words.alias("long_words"), "numbers")
    ids, whole_words = own.ids, own.whole
    return blocks.mapInArrow(released(lambda batches: _spread(batches, path, ids, whole_words)), "doc_id bigint, ids array<int>, packed binary")


def decode_ids(ids: Column | str, path: str) -> Column:
    """The bytes that ids stand for: their pieces from a literal table, joined."""
    own = {rank: piece.decode(BYTES) for piece, rank in read_ranks(path).items()}
    table = string_table([own.get(i) for i in range(max(own) + 1)])
    return F.encode(let(table, lambda pieces: F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), BYTES)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    return encode_documents(docs, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(decode_ids("ids", path), 256).alias("decoded_sha256"),
    )
