import pathlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from farewise.llm import quality_net
from tests.llm.conftest import passage

DATA = pathlib.Path("/root/testdata/sf0.01")


def test_context_sums_equal_a_plain_loop():
    texts = pa.array(["the cat sat on the mat", "", "a", "the cat!!", None])
    own, first = quality_net.word_buckets(texts)
    index = quality_net.index_vectors()
    sums, seen = np.zeros((quality_net.BUCKETS, quality_net.DIMS), np.int64), np.zeros(quality_net.BUCKETS, np.int64)
    quality_net.add_contexts(sums, seen, own, first, index)
    plain = np.zeros_like(sums)
    for a, b in zip(first, first[1:], strict=False):
        for i in range(a, b):
            for j in range(a, b):
                if 0 < abs(i - j) <= quality_net.REACH:
                    plain[own[i]] += index[own[j]]
    assert (sums == plain).all() and seen.sum() == len(own) == 10


def test_unlike_texts_are_told_apart(make, spark):
    good = [passage(k, 60) for k in range(200)]
    bad = [" ".join(w.upper() + "!!" for w in passage(k, 60).split()) for k in range(200)]
    docs = make(good + bad)
    labels = spark.createDataFrame([(k, int(k < 200), 0) for k in range(400)], "doc_id bigint, quality int, toxic int")
    rows = quality_net.score_documents(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == int(r.doc_id < 200) for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not present")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{n}.parquet")) for n in ("documents", "labels"))
    scored = quality_net.score_documents(docs, labels)
    held = scored.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_odd_tables(odd, odd_texts, empty, spark):
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, None), (99, 1), (4, 1)], "doc_id bigint, quality int")
    rows = quality_net.score_documents(odd, labels).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    assert quality_net.score_documents(empty, labels).count() == 0
    none = quality_net.score_documents(odd, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}


def test_temperature_lowers_the_loss():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, quality_net.FEATURES)).astype(np.float32)
    y = (x[:, 0] + draw.normal(size=3000) > 0).astype(int)
    part = np.arange(3000) % 5 == 0
    net = quality_net.train(x, y, part)
    own = quality_net._loss(net.logits(x[part]) / net.temperature, y[part])
    assert own <= quality_net._loss(net.logits(x[part]), y[part]) + 1e-9


def plain_scores(texts, ids, labels):
    """The whole query for a small table by plain loops over words."""
    words = [quality_net.word_buckets(pa.array([t], pa.string()))[0].tolist() for t in texts]
    index = quality_net.index_vectors().astype(float)
    sums, seen = {}, {}
    for own in words:
        for i, w in enumerate(own):
            seen[w] = seen.get(w, 0) + 1
            near = [own[j] for j in range(max(0, i - quality_net.REACH), min(len(own), i + quality_net.REACH + 1)) if j != i]
            sums[w] = sums.get(w, 0) + sum((index[v] for v in near), np.zeros(quality_net.DIMS))
    centre = sum(sums.values()) / sum(seen.values())
    vectors = {w: sums[w] / seen[w] - centre for w in seen}
    vectors = {w: v / (np.linalg.norm(v) or 1.0) for w, v in vectors.items()}
    rows = []
    for own in words:
        row = np.zeros(quality_net.FEATURES)
        row[-1] = np.log1p(len(own))
        if own:
            own_vectors = np.array([vectors[w] for w in own])
            row[: quality_net.DIMS], row[quality_net.DIMS : 2 * quality_net.DIMS] = own_vectors.mean(axis=0), own_vectors.std(axis=0)
            for gap in range(1, quality_net.REACH + 1):
                row[2 * quality_net.DIMS + gap - 1] = sum(own_vectors[i] @ own_vectors[i + gap] for i in range(len(own) - gap)) / len(own)
        rows.append(row)
    crc = lambda t: zlib.crc32(t.encode()) % 5 == 0
    learned = [k for k, i in enumerate(ids) if i in labels and not crc(str(i))]
    order = {r: n for n, r in enumerate(ids)}
    return np.array(rows), sorted(learned, key=lambda k: order[ids[k]]), [crc(f"calibrate{ids[k]}") for k in learned]


def test_scores_equal_a_plain_pass(make, spark, monkeypatch):
    texts = [passage(k, 30 + k % 9) if k % 2 else " ".join(w.upper() + "!" for w in passage(k, 25).split()) for k in range(120)] + ["", None]
    ids = list(range(len(texts)))
    labels = {k: k % 2 for k in range(110)}
    taken = {}
    train = quality_net.train

    def kept(x, y, calibration):
        taken.update(x=x, y=y, c=calibration, net=train(x, y, calibration))
        return taken["net"]

    monkeypatch.setattr(quality_net, "train", kept)
    table = spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int")
    scored = {r.doc_id: r.score for r in quality_net.score_documents(make(texts), table).collect()}
    rows, learned, calibrate = plain_scores(texts, ids, labels)
    want = sorted([*rows[k].round(3).tolist(), labels[ids[k]], c] for k, c in zip(learned, calibrate, strict=True))
    got = sorted([*x.astype(float).round(3).tolist(), int(y), bool(c)] for x, y, c in zip(taken["x"], taken["y"], taken["c"], strict=True))
    assert np.allclose(np.array(want, float), np.array(got, float), atol=2e-3)
    assert np.allclose([scored[i] for i in ids], taken["net"].scores(rows), atol=1e-3)


def test_the_sample_is_the_least_hashes(spark):
    known = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as y").repartition(7)
    features = known.selectExpr("doc_id", "cast(cast(doc_id as string) as binary) as features")
    order = known.orderBy(quality_net.F.xxhash64("doc_id", quality_net.F.lit("sample"))).select("doc_id")
    want = [r.doc_id for r in order.collect()]
    for sample in (1, 40, 2999, 3000, 5000):
        assert [r.doc_id for r in quality_net.least_picked(known, features, sample).collect()] == want[:sample]
