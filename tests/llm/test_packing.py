import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from farewise.llm import packing
from tests.llm.conftest import passage

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def sequences(limits, cuts, lengths, firsts, pool=64):
    packer = packing.Packer(limits, cuts, pool)
    out = [s for row, (n, f) in enumerate(zip(lengths, firsts, strict=True)) for s in packer.feed(row, n, f)]
    return packer, [*out, *packer.finish()]


@pytest.mark.parametrize("cuts", [True, False])
@pytest.mark.parametrize("limits", [packing.Limits(100, 6, 100), packing.Limits(100, 6, 40), packing.Limits(100, 2, 70)])
def test_limits_hold_and_nothing_is_lost(limits, cuts):
    draw = random.Random(9)
    lengths = [draw.choice([1, 3, draw.randrange(1, 90), draw.randrange(1, 350)]) for _ in range(700)]
    firsts = [draw.choice([0, n, draw.randrange(n + 1)]) for n in lengths]
    packer, got = sequences(limits, cuts, lengths, firsts)
    seen = {}
    for sequence in got:
        assert sum(n for _, _, n, _ in sequence) <= limits.tokens
        assert len(sequence) <= limits.segments
        assert sum(packer._loss(s, n, f) for _, s, n, f in sequence) <= limits.loss
        for row, start, n, _ in sequence:
            assert n > 0
            seen.setdefault(row, []).append((start, n))
    for row, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[row]):
            assert start == at
            at += length
        assert at == n
        if not cuts and n <= limits.tokens and max(0, n - firsts[row]) <= limits.loss:
            assert len(seen[row]) == 1


def test_cutting_leaves_hardly_any_room():
    draw = random.Random(4)
    lengths = [draw.randrange(1, 3000) for _ in range(3000)]
    _, got = sequences(packing.Limits(), True, lengths, [0] * len(lengths), pool=512)
    assert sum(lengths) / (2048 * len(got)) > 0.998


def test_pieces_of_documents(make):
    texts = [passage(k, 1 + 37 * k % 900) for k in range(120)] + ["", None]
    rows = packing.pack(make(texts).coalesce(2), BYTE, 1).collect()
    own = Tokenizer.from_file(BYTE)
    ids = [[*own.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(map(len, ids))


def test_prompts_bear_no_loss(spark):
    rows = [(k, passage(k, 5 + k % 40), passage(k + 50, 3 + k % 20)) for k in range(150)]
    table = spark.createDataFrame(rows, "doc_id bigint, prompt string, text string")
    limits = packing.Limits(256, 4, 90)
    got = packing.pack(table, BYTE, 1, limits, cuts=False, prompt="prompt").collect()
    sums = {}
    for r in got:
        n, k, loss = sums.get(r.sequence_id, (0, 0, 0))
        sums[r.sequence_id] = (n + r.length, k + 1, loss + r.loss_tokens)
    assert all(n <= 256 and k <= 4 and loss <= 90 for n, k, loss in sums.values())
    own = Tokenizer.from_file(BYTE)
    answer = {k: len(own.encode(t, add_special_tokens=False).ids) + 1 for k, _, t in rows}
    for k in answer:
        assert sum(r.loss_tokens for r in got if r.doc_id == k) == answer[k]


def test_packing_tables(odd, odd_texts, empty):
    own = Tokenizer.from_file(BYTE)
    own.encode_special_tokens = True
    rows = packing.pack(odd, BYTE, 1).collect()
    assert sum(r.length for r in rows) == sum(len(own.encode(t or "", add_special_tokens=False).ids) + 1 for t in odd_texts)
    assert packing.pack(empty, BYTE, 1).count() == 0
