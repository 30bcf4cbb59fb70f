"""Quality scores from random-indexing word vectors and a two-layer network.

* Every word owns a sparse random index vector, fixed by its fingerprint's bucket. A word's context vector is the sum
  of the index vectors of its neighbours over the whole corpus; tasks add up their own words and the partial sums are
  added by bucket, so only a table of fixed size (BUCKETS x DIMS) ever reaches the driver and the tasks.
* A document is its words' centred unit vectors pooled: mean, spread and likeness of neighbouring words.
* A network with one hidden layer, trained with numpy on a bounded sample of labelled documents, gives a score; a
  temperature fitted on documents it was not trained on makes it a calibrated probability.

Only the text is an input of a score. Defined results: null and empty texts have a zero vector and a score like any
other; repeated rows score alike; documents labelled twice with different labels count once each way; without
labels of both kinds the score is the share of good labels (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import bounded_batches, cut, flat, released, slices, span_hashes, whole

BUCKETS = 1 << 14
DIMS = 48
NONZERO = 6
REACH = 2
PARTS = 64
BLOCK = 1 << 20
#: Labelled documents the network may be trained on; beyond that those of the smallest hash are taken.
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 40
THRESHOLD = 0.3
FEATURES = 2 * DIMS + REACH + 1

# Kinds of bytes: blank 0, letters (and all of non-ASCII) 1, digits 2, other signs 3.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def index_vectors() -> np.ndarray:
    """The buckets' sparse index vectors: NONZERO places hold +1 or -1."""
    draw = np.random.default_rng(20240501)
    out = np.zeros((BUCKETS, DIMS), np.int8)
    places = draw.permuted(np.tile(np.arange(DIMS, dtype=np.int8), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places.astype(np.int64), draw.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO)), axis=1)
    return out


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word (run of letters, digits or signs, case kept) and the first word of each text."""
    data, offsets = flat(texts)
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    ink = kind[starts] > 0
    starts, ends = starts[ink], ends[ink]
    buckets = (span_hashes(data, starts, ends) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
    return buckets.astype(np.uint16), np.searchsorted(starts, offsets)


def _neighbours(n: int, first: np.ndarray, gap: int) -> np.ndarray:
    """Marks of the words that have a word `gap` later in the same text."""
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return text_of[: n - gap] == text_of[gap:] if n > gap else np.zeros(0, bool)


def add_contexts(sums: np.ndarray, seen: np.ndarray, own: np.ndarray, first: np.ndarray, index: np.ndarray) -> None:
    """Add to each bucket's row of `sums` the index vectors around its words."""
    n = len(own)
    if not n:
        return
    around = np.zeros((n, DIMS), np.int8)
    vectors = index[own]
    for gap in range(1, REACH + 1):
        pair = _neighbours(n, first, gap)
        around[: n - gap][pair] += vectors[gap:][pair]
        around[gap:][pair] += vectors[: n - gap][pair]
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sums[ranked[begin]] += np.add.reduceat(around[order].astype(np.int32), begin, axis=0)
    seen += np.bincount(own, minlength=BUCKETS)


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vector of each bucket, from all texts. Of fixed size, so it may come to the driver."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = BUCKETS // PARTS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums, seen = index_vectors(), np.zeros((BUCKETS, DIMS), np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                add_contexts(sums, seen, *word_buckets(part.column("text")), index)
        both = np.column_stack([seen, sums]).astype("<i8")
        if seen.any():
            rows = [both[p * size : (p + 1) * size].tobytes() for p in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(rows, pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                value = np.frombuffer(raw, "<i8")
                totals[part] = totals[part] + value if part in totals else value
        rows = [v.tobytes() for v in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(rows, pa.binary())], names=["part", "sums"])

    partial = docs.select(whole(text).alias("text")).mapInArrow(released(gather), "part int, sums binary")
    table = np.zeros((BUCKETS, DIMS + 1))
    for row in partial.repartition(PARTS, "part").mapInArrow(released(add), "part int, sums binary").collect():
        at = row["part"] * size
        table[at : at + size] += np.frombuffer(row["sums"], "<i8").reshape(size, DIMS + 1)
    seen, sums = table[:, :1], table[:, 1:]
    mean = sums.sum(axis=0) / max(1.0, seen.sum())
    vectors = np.where(seen > 0, sums / np.maximum(seen, 1) - mean, 0.0)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Feature vector of each text."""
    own, first = word_buckets(texts)
    n, k = len(own), len(first) - 1
    out = np.zeros((k, FEATURES), np.float32)
    counts = np.diff(first)
    out[:, -1] = np.log1p(counts)
    filled = counts > 0
    if not n:
        return out
    at, many = first[:-1][filled], counts[filled][:, None]
    words = vectors[own]
    mean = np.add.reduceat(words, at, axis=0) / many
    out[filled, :DIMS] = mean
    out[filled, DIMS : 2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(words * words, at, axis=0) / many - mean * mean, 0))
    for gap in range(1, REACH + 1):
        like = np.zeros(n, np.float32)
        pair = _neighbours(n, first, gap)
        like[: n - gap][pair] = np.einsum("ij,ij->i", words[gap:][pair], words[: n - gap][pair])
        out[filled, 2 * DIMS + gap - 1] = np.add.reduceat(like, at) / many[:, 0]
    return out


@dataclass
class Network:
    """Two layers and a temperature; `scores` gives probabilities of label 1."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -logits, logits)))) if len(y) else 0.0


def train(x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> Network:
    """Fit on the rows outside `calibration`, then the temperature on those inside."""
    x = x.astype(np.float64)
    fit = ~calibration
    d = x.shape[1] if x.ndim == 2 else FEATURES
    if len(set(y[fit].tolist())) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    shift, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    draw = np.random.default_rng(7)
    net = Network(shift, scale, draw.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z, target = (x[fit] - shift) / scale, y[fit].astype(np.float64)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(z))
        for begin in range(0, len(order), 128):
            rows = order[begin : begin + 128]
            hidden = np.tanh(z[rows] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30))) - target[rows]) / len(rows)
            back = np.outer(error, net.w2) * (1 - hidden * hidden)
            slopes = [z[rows].T @ back + 1e-4 * net.w1, back.sum(axis=0), hidden.T @ error + 1e-4 * net.w2, np.array([error.sum()])]
            step += 1
            moves = []
            for slope, (m, v) in zip(slopes, state, strict=True):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                moves.append(3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2]
            net.b2 -= float(moves[3][0])
    if calibration.any():
        logits, labels = net.logits(x[calibration]), y[calibration]
        net.temperature = min((float(t) for t in np.geomspace(0.25, 8, 61)), key=lambda t: _loss(logits / t, labels))
    return net


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def least_picked(known: DataFrame, features: DataFrame, sample: int) -> DataFrame:
    """The `sample` labelled documents of the smallest hashed ids, with their features.

    Only hashes of ids are counted to find a bound that lets slightly more than `sample` rows pass; features are
    joined to those alone, and the few rows too many are cut exactly.
    """
    picked = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    ids = known.join(features.select("doc_id"), "doc_id").select(picked.alias("picked"))
    many, share = ids.count(), 0.0
    if many > sample:
        share = (sample + 5 * sample**0.5) / many
        while share < 1 and ids.filter(F.col("picked") <= _bound(share)).count() < sample:
            share *= 1.5
        if share < 1:
            known = known.filter(picked <= _bound(share))
    return known.join(features, "doc_id").orderBy(picked, "doc_id", "y", "features").limit(sample)


def _bound(share: float) -> int:
    """The hash below which a share of all hashes lies."""
    return int(share * 2**64) - 2**63


def score_documents(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(context_vectors(docs, text))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                rows = pooled(part.column("text"), shared.value).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "features"]
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(text).alias("text"))
    features = cut(rows.mapInArrow(released(pool), "doc_id bigint, features binary"), "quality-features")
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).distinct()
    known = known.filter(~held_out(F.col("doc_id")))
    chosen = least_picked(known, features, sample)
    table = chosen.select("y", "features", (F.crc32(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0).alias("c")).toArrow()
    x = np.frombuffer(b"".join(table.column("features").to_pylist()), "<f4").reshape(-1, FEATURES)
    net = train(x, table.column("y").to_numpy(), table.column("c").to_numpy().astype(bool))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("features").to_pylist()), "<f4").reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.scores(x))], names=["doc_id", "score"])

    scored = features.mapInArrow(released(score), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
