import collections
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from farewise.llm import fill_middle, queries
from tests.llm.conftest import passage

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def check(docs):
    want = collections.Counter(brute(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = fill_middle.fill_in_middle(docs)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    return {row[2] for row in want}


def test_against_brute_force(odd, odd_texts, empty, make):
    check(odd)
    check(empty)
    texts = [*odd_texts, "a <P> b", "<S>", "x<M>", "\x0b\x0c x y z ", *[passage(k, k % 50) + " " * (k % 3) for k in range(200)]]
    assert check(make(texts)) == {"plain", "spm", "psm"}
    check(make(texts * 2, ids=[k % 20 for k in range(2 * len(texts))]).repartition(5))


@pytest.mark.parametrize("size", [1, 7, 100])
def test_documents_of_many_pieces(make, monkeypatch, size):
    monkeypatch.setattr(fill_middle, "PIECE_BYTES", size)
    assert check(make(["é" * 30 + " word" * 9, "日本 語x  y\n" * 5, "", "ab", *["one two  three " * 5] * 40]).coalesce(2)) == {"plain", "spm", "psm"}


def test_very_long_texts(make):
    check(make(["x" * 20_000_000, "é " * 1_000_000, "word " * 1_000_000, " " * 100_000], ids=[11, 12, 14, 15]))


def test_pieces_are_sorted_and_small(make):
    docs = make(["word " * 40_000] * 12)
    pieces = fill_middle.output_pieces(docs)
    assert pieces.select(F.max(F.octet_length("piece"))).first()[0] <= fill_middle.PIECE_BYTES
    plan = fill_middle.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [key") == 2


def test_sql(spark, make, tmp_path, odd_texts):
    make([*odd_texts, *[passage(k, 30 + k) for k in range(40)]]).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(queries.ORACLE["op13_fill_middle"]).fetchall()
    got = [tuple(r) for r in queries.QUERIES["op13_fill_middle"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
