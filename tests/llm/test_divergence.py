import collections
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from farewise.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, term string, vector string, n bigint"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """Every (text, lang, source) by dictionaries and whole numbers."""
    docs = [(TERM.findall(lower(t or "")), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        spread = collections.Counter(t for terms, _, _ in own for t in set(terms))
        kept = [t for t, n in spread.items() if n >= 10]
        every = collections.Counter(t for terms, _, _ in own for t in terms)
        groups = {s: collections.Counter(t for terms, _, x in own if x == s for t in terms) for s in {d[2] for d in own}}

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: shares(c) for s, c in groups.items()}, shares(every)
        for s, counts in groups.items():
            pair = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in groups if x != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if counts[t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pair, None), ("term", term, 10)):
                ranked = sorted(values, key=lambda v: (-v[1], v[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def rows_of(k):
    """Documents with null and empty fields, a language without kept terms and sources without terms."""
    texts = [f"The {'ab' * (i % 3)} É{i % 5}é ñandú x{i % 11}y word Word WORD{chr(97 + i % 7)} [z]" for i in range(k)]
    langs, sources = ["en", "de", None, "en"], ["s1", "s2", None, "É", "z\0a"]
    rows = [(t, langs[i % 4], sources[i % 5]) for i, t in enumerate(texts)]
    rows += [(None, "en", "nothing"), ("", "fr", None), ("12 ?", "fr", "s1"), ("rare", "it", "s"), ("rare", "it", "r"), *rows[:3] * 4]
    return [*rows, ("the " * 30_000 + "x" * 200_000, "en", "long")]


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(1, *row, "x", None, 7) for row in rows], SCHEMA)


@pytest.mark.parametrize("limits", [{}, {"MODEL_TERMS": 5, "CHUNK_ROWS": 7, "GROUP_SOURCES": 2, "SALTS": 3}])
def test_against_brute_force(table, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    rows = rows_of(150)
    got = sorted(tuple(r) for r in divergence.divergence(table(rows).repartition(4)).collect())
    assert got == brute(rows)


def test_no_kept_terms_and_no_rows(table):
    rows = [("a b", "en", "s"), ("c", "en", None)]
    assert sorted(tuple(r) for r in divergence.divergence(table(rows)).collect()) == brute(rows)
    assert divergence.divergence(table(rows).limit(0)).count() == 0


def test_vectors_meet_within_a_task():
    kind = pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    vectors = pa.array([{"indices": [k % 3, 7], "values": [1.0, 2.0**40]} for k in range(40)], kind)
    pairs = [pa.array(["en"] * 40), pa.array([f"s{k % 2}" for k in range(40)])]
    batch = pa.RecordBatch.from_arrays([*pairs, vectors], names=["lang", "source", "vector"])
    for limit in (10, 60, 10_000):
        sums = collections.Counter()
        for out in divergence._sum_vectors(iter([batch, batch]), limit):
            for row in out.to_pylist():
                sums[row["source"], row["index"]] += row["n"]
        assert sums["s0", 7] == sums["s1", 7] == 40 * 2**40 and sum(n for (_, i), n in sums.items() if i < 3) == 80


def test_shares_are_exact_at_large_counts(spark):
    draw = np.random.default_rng(1)
    rows = [(int(n), int(n) + int(m), int(v)) for n, m, v in zip(draw.integers(0, 2**46, 300), draw.integers(0, 2**46, 300), draw.integers(1, 2**30, 300), strict=True)]
    rows += [(0, 0, 1), (2**47, 2**47, 1), (5, 5, 2**30)]
    frame = spark.createDataFrame(rows, "n bigint, total bigint, terms bigint")
    got = frame.select("*", divergence.share(frame.n, frame.total, frame.terms).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 2) // (r.total + 2 * r.terms) for r in got)


def test_sql(spark, table, tmp_path):
    table(rows_of(90)).select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(queries.ORACLE["op12_divergence"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in queries.QUERIES["op12_divergence"](spark, str(tmp_path)).collect())
