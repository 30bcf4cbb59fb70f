import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from farewise.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LETTERS = ["abcdefgh", "aab", "etaoin srhld'", "0123456789", "é日本語ñß ", " \n\t  x", "'st've !?.,#", "\U0001f600‍€𐖀", "thein "]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def texts_at_random(n):
    draw = random.Random(3)
    return ["".join(draw.choice(draw.choice(LETTERS)) for _ in range(draw.randrange(90))) for _ in range(n)] + [
        "".join(draw.choice(letters) for _ in range(300)) for letters in LETTERS
    ]


def check(rows, texts, library):
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids), texts[row.doc_id][:80]
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()


def test_ids_are_the_librarys(make, odd_texts, library):
    texts = [*odd_texts, *texts_at_random(400), "<|endoftext|>", "\x00\x7f\x85", "don't you'LL", "\r\n \r\n x  "]
    check(byte_bpe.round_trip(make(texts), PATH).collect(), texts, library)


def test_every_character_is_cut_like_the_library(make, library):
    # Letters, numbers and blanks of all planes: the class of a character decides where a word ends.
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)} " for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    check(byte_bpe.round_trip(make(texts), PATH).collect(), texts, library)


def test_long_words_and_blocks(make, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 1000)
    monkeypatch.setattr(byte_bpe, "BATCH_BYTES", 100_000)
    draw = random.Random(4)
    long = ["a" * 300_000, "".join(draw.choice("etaoinsr") for _ in range(100_000)), " " * 70_000, "word " * 50_000, "9" * 1000]
    near = ["".join(draw.choice("abe") for _ in range(n)) for n in (255, 256, 257, 258)]
    texts = [*long, *near, "", None, *[f"x{k} yz" * 200 for k in range(30)]]
    docs = make(texts)
    check(byte_bpe.round_trip(docs.coalesce(1), PATH).collect(), texts, library)
    check(byte_bpe.round_trip(docs.repartition(3), PATH).collect(), texts, library)


def test_pieces_without_a_pair(tmp_path, make):
    # "abc" can only be made from "ab" and "c" or "a" and "bc", which are no pieces: it stands for the whole word alone.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"xy": 301, b"xyz": 302}
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(piece) + b" %d" % rank for piece, rank in ranks.items()))
    texts = ["abc", "abcabc", " abc", "xyz xyxyz abc", "abc."]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in byte_bpe.encode_documents(make(texts), str(path)).collect()}
    assert got == {k: own.encode_ordinary(t) for k, t in enumerate(texts)}
    (tmp_path / "none.tiktoken").write_bytes(base64.b64encode(b"ab") + b" 0")
    with pytest.raises(ValueError, match="256 bytes"):
        byte_bpe.read_ranks(str(tmp_path / "none.tiktoken"))


def test_tables_and_decoding(odd, odd_texts, empty, spark):
    rows = byte_bpe.round_trip(odd, PATH)
    assert rows.count() == len(odd_texts) and byte_bpe.round_trip(empty, PATH).count() == 0
    assert rows.filter(F.col("doc_id").isNull()).count() == 2
    ids = spark.createDataFrame([([0, 256, 50255],), ([],), (None,)], "ids array<int>")
    own = {v: k for k, v in byte_bpe.read_ranks(PATH).items()}
    got = [r[0] for r in ids.select(byte_bpe.decode_ids("ids", PATH)).collect()]
    assert [g if g is None else bytes(g) for g in got] == [own[0] + own[256] + own[50255], b"", None]
