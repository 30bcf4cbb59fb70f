import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from farewise.llm import id_planes, section_counts, sentencepiece_viterbi, tokens
from farewise.llm.common import flat

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library_ids(path, texts):
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return [e.ids for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def noise():
    draw = np.random.default_rng(3)
    letters = list("aAbe .,!\n\t'sé½ß9-_日 |$ ")
    return ["".join(draw.choice(letters, draw.integers(0, 60))) for _ in range(400)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_encode_as_the_library_does(path, odd_texts, noise):
    check_pieces(path, [*odd_texts, *noise], memo=2000)


def check_pieces(path, texts, memo):
    """A few texts at a time, so that later blocks meet remembered pieces."""
    own, expected = tokens.PieceEncoder(path, memo=memo), library_ids(path, texts)
    for k in range(0, len(texts), 7):
        ids, offsets = own.encode(*flat(pa.array(texts[k : k + 7], pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == expected[k : k + 7], texts[k : k + 7]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_all_scripts_are_cut_safely(path):
    draw = np.random.default_rng(8)
    scripts = ["привет мир, Ёж", "ΣΑΣ ΣΆΣ ς", "日本語 テスト", "مرحبا بالعالم", "e\u0301 \u0301a", "a\u00a0b", "x\u3000y", "\u2003 z", "q\u0085 r", "\u1680 k",
               "\U0001f600 \U00010400x", "İI ıi", "½ ²x", "\u202f7", "it's DON'T", "  \n x", "straße STRASSE", "\x1c a"]
    texts = [" ".join(draw.choice(scripts, draw.integers(1, 6))) for _ in range(150)] + ["".join(draw.choice(scripts, 5)) for _ in range(150)]
    check_pieces(path, texts, memo=4000)
    check_pieces(path, texts, memo=1 << 25)


def test_memory_is_bounded_and_rare_pieces_are_left(noise):
    own = tokens.PieceEncoder(BYTE, memo=20_000)
    for k in range(40):
        own.encode(*flat(pa.array([f" w{k}x{i} w{k}x{i} once{k}{i}" for i in range(30)])))
        assert own.held <= 20_000 and not any(p.startswith(b" once") for p in own.number)
    assert own.number


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_other_rules_get_whole_texts(path, tmp_path, odd_texts):
    declared = json.loads(open(path, encoding="utf-8").read())
    assert tokens.known_rules(declared) == ("byte" if path == BYTE else "word")
    if path == BYTE:
        declared["pre_tokenizer"]["add_prefix_space"] = True
    else:
        declared["normalizer"]["normalizers"].pop()
    other = tmp_path / "other.json"
    other.write_text(json.dumps(declared))
    assert tokens.known_rules(declared) is None
    check_pieces(str(other), odd_texts, memo=1 << 20)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_texts_longer_than_a_block(path):
    texts = ["x" * 200_000 + "é" * 100_000, "word " * 1_000_000, "", "яблоко " * 1000]
    check_pieces(path, texts, memo=1 << 25)


def test_sentencepiece_ids_are_the_librarys(odd_texts, noise):
    texts = [t or "" for t in [*odd_texts, *noise]]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = sentencepiece_viterbi.SentencePieceModel(PIECES)
    ids, offsets = own.encode_texts(*flat(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == library.encode(texts)
    assert own.decode(ids, offsets) == [t.replace("▁", " ") for t in texts]


def as_unigram(raw: bytes) -> bytes:
    """The model file with its kind set to unigram."""
    at = raw.rindex(b"tok_v0") + len(b"tok_v0")
    assert raw[at : at + 2] == bytes([3 << 3, 2])
    return raw[: at + 1] + b"\x01" + raw[at + 2 :]


def test_unigram_viterbi_has_the_librarys_score(odd_texts):
    with open(PIECES, "rb") as file:
        library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(file.read()))
    own = sentencepiece_viterbi.SentencePieceModel(PIECES, kind=sentencepiece_viterbi.UNIGRAM)
    texts = [t for t in odd_texts if t and "  " not in t and t.isascii() and len(t) < 500]
    ids, offsets = own.encode_texts(*flat(pa.array(texts)))
    for k, expected in enumerate(library.encode(texts)):
        mine = ids[offsets[k] : offsets[k + 1]].tolist()
        assert sum(own.scores[i] for i in mine) == pytest.approx(sum(own.scores[i] for i in expected))


def test_encode_and_decode_documents(odd, odd_texts, empty):
    table = sentencepiece_viterbi.encode_documents(odd, PIECES)
    assert table.filter("not round_trip").count() == 0 and table.count() == len(odd_texts)
    back = sentencepiece_viterbi.decode_documents(table, PIECES)
    assert sorted(r.text for r in back.collect()) == sorted((t or "").replace("▁", " ") for t in odd_texts)
    assert sentencepiece_viterbi.encode_documents(empty, PIECES).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 8, 65_537])
def test_planes_give_the_ids_back(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n).astype(np.uint32)
    assert (id_planes.from_planes(id_planes.to_planes(ids, kind), n, kind) == ids).all()
    small = ids % 50_000
    payload, at, counts, sizes = id_planes.pack_segment(small, kind)
    each = len(sizes) // len(at)
    blocks = [id_planes.unpack_block(payload, a, c, sizes[i * each : (i + 1) * each], kind) for i, (a, c) in enumerate(zip(at, counts, strict=True))]
    assert (np.concatenate(blocks) == small).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_files_hold_all_ids_in_order(kind, make, noise, monkeypatch):
    monkeypatch.setattr(id_planes, "SEGMENT_IDS", 300)
    ids = np.random.default_rng(1).permutation(len(noise)).tolist()
    table = id_planes.store_and_read(make(noise, ids), WORD, 2, kind).orderBy("doc_id").collect()
    texts = [noise[ids.index(i)] for i in range(len(noise))]
    start = 0
    for row, expected in zip(table, library_ids(WORD, texts), strict=True):
        expected = [*expected, 2]
        assert (row.start, row.n_tokens) == (start, len(expected))
        assert row.ids_crc32 == zlib.crc32(np.array(expected, "<u4").tobytes())
        start += len(expected)


def test_files_of_odd_and_empty_tables(odd, odd_texts, empty):
    assert id_planes.store_and_read(empty, WORD, 2).count() == 0
    rows = id_planes.store_and_read(odd, WORD, 2).orderBy("start").collect()
    assert len(rows) == len(odd_texts)
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda i: -1 if i is None else i)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()


def brute_sections(text):
    """Tokens per line by the library's own offsets."""
    own = Tokenizer.from_file(BYTE)
    own.encode_special_tokens = True
    spans, at = [], 0
    for line in text.split("\n"):
        spans.append((at, at + len(line) + 1))
        at += len(line) + 1
    spans[-1] = (spans[-1][0], len(text))
    spans = spans[:-1] if text.endswith("\n") else spans
    counts = [0] * len(spans)
    raw, at = text.encode(), 0
    starts = [i for i, b in enumerate(raw) if (b & 0xC0) != 0x80]
    names = {i: n for n, i in own.get_vocab().items()}
    for i in own.encode(text, add_special_tokens=False).ids:
        end = at + len(names[i])
        first = sum(s <= at for s in starts) - 1
        last = sum(s < end for s in starts)
        share = [min(b, last) - max(a, first) for a, b in spans]
        counts[max(range(len(spans)), key=lambda k: (share[k], -k))] += 1
        at = end
    return counts


def test_counts_per_line(make, odd_texts, noise):
    texts = [t or "" for t in odd_texts if len(t or "") < 300] + noise[:60]
    got = section_counts.count_tokens(make(texts), BYTE).collect()
    for k, text in enumerate(texts):
        mine = [r.n_tokens for r in sorted((r for r in got if r.doc_id == k), key=lambda r: r.section)]
        assert mine == brute_sections(text), repr(text)


def test_counts_of_fields_add_up(odd, odd_texts, empty):
    text, sections = section_counts.field_sections(["lang", "text", "source"])
    rows = odd.select("doc_id", text.alias("joined"), sections.alias("spans"))
    got = section_counts.count_tokens(rows, BYTE, text="joined", sections=F.col("spans"))
    total = got.agg(F.sum("n_tokens")).first()[0]
    joined = [r.joined for r in rows.collect()]
    assert total == sum(map(len, library_ids(BYTE, joined)))
    assert {r.name for r in got.collect()} == {"lang", "text", "source", None}
    assert section_counts.count_tokens(empty, BYTE).count() == 0
    assert section_counts.count_tokens(odd, BYTE).agg(F.sum("n_tokens")).first()[0] == sum(map(len, library_ids(BYTE, odd_texts)))


def test_a_crossing_token_goes_to_the_larger_share():
    section, crossing = section_counts.allot(np.array([0, 3, 8]), np.array([3, 8, 9]), np.array([0, 4]), np.array([4, 8]))
    assert section.tolist() == [0, 1, -1] and crossing.tolist() == [False, True, False]
    section, _ = section_counts.allot(np.array([2]), np.array([6]), np.array([0, 4]), np.array([4, 8]))
    assert section.tolist() == [0]
