"""Near duplicates by SuperMinHash signatures, banding, verification on full sets and union-find grouping.

1. One pass over the texts gives each document its distinct word shingles' SuperMinHash: every shingle ranks the
   signature's places by a pseudo-random permutation, and places are filled rank by rank over a whole block of texts
   until none of a text can improve. Documents with the same words are one class from here on.
2. Classes that agree on a band meet in a bucket. Each is compared with its bucket's smallest class: an estimate from
   the signatures drops the hopeless, the full sets confirm the rest, and confirmed links are grouped.
3. What this leaves open are buckets of three or more classes whose members are still in different groups. They are
   cut into blocks; each pair of blocks finds the pairs that share their first band there, and checks them on full
   sets, passing over those whose groups have met meanwhile. No bucket is ever one task and no pair is left out.
4. Links are grouped by union-find within partitions and by joining the partial forests until they agree.

A link is missed only if no band agrees (5e-9 for a similarity of 0.85, 5e-6 for 0.8) or if the estimate is too low
by more than MARGIN. Defined results: documents without words are linked with nothing; equal shingle sets are
linked, whatever their ids; null ids are passed over when the smallest id is sought; repeated rows get equal values;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import (
    LOWER, STEP, bounded_batches, cut, drop_tables, flat, mixed, powers, released, slices, span_hashes, times_step, unused, whole, window_hashes, words,
)

WIDTH = 5
BANDS, ROWS = 40, 6
PLACES = BANDS * ROWS
#: Pairs estimated below the threshold by more than this are not checked further.
MARGIN = 0.13
BLOCK_CLASSES = 512
LAZY_RANKS = 8
EMPTY = np.uint64(2**64 - 1)
SIGNED = "doc_id bigint, text_key bigint, digest binary, n_shingles bigint, bands array<bigint>, sketch binary"


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles of all texts end to end, the offset of each text's, and a digest of each text's words."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    runs = window_hashes(hashes, WIDTH)
    found, digests = [], []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = high - low
        if n >= WIDTH:
            found.append(np.unique(runs[low : high - WIDTH + 1]))
        else:
            found.append(window_hashes(hashes[low:high], n) if n else hashes[:0])
        digests.append(hashlib.blake2b(hashes[low:high].tobytes(), digest_size=16).digest())
    sizes = np.array([len(f) for f in found], np.int64)
    borders = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), borders, digests


def super_minhash(values: np.ndarray, borders: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures (texts x places): at each place the least rank-and-fraction that any value gives it.

    A value's permutation of the places is dealt by Fisher-Yates from its own random stream. A text is done when all
    its places hold ranks that later ranks cannot undercut.
    """
    n = len(borders) - 1
    best = np.full(n * places, EMPTY, np.uint64)
    text_of = np.repeat(np.arange(n), np.diff(borders))
    values = mixed(values)
    history: list[np.ndarray] = []
    deals: np.ndarray | None = None
    for rank in range(places):
        if not len(values):
            break
        stream = mixed(values + times_step(rank + 1))
        pick = (rank + (((stream & np.uint64(0xFFFFFFFF)) * np.uint64(places - rank)) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        if deals is None and rank >= LAZY_RANKS:
            # Few texts are left: keep their permutations as they stand from here on.
            deals = np.tile(np.arange(places, dtype=np.int16), (len(values), 1))
            rows = np.arange(len(values))
            for t, old in enumerate(history):
                deals[rows, old], deals[:, t] = deals[:, t].copy(), deals[rows, old].copy()
        if deals is None:
            place = pick.copy()
            for t in range(rank - 1, -1, -1):
                old = history[t]
                place = np.where(place == t, old, np.where(place == old, np.int16(t), place))
            history.append(pick)
        else:
            rows = np.arange(len(values))
            place = deals[rows, pick]
            deals[rows, pick] = deals[:, rank]
            deals[:, rank] = place
        np.minimum.at(best, text_of * places + place, (np.uint64(rank) << np.uint64(32)) | (stream >> np.uint64(32)))
        done = best.reshape(n, places).max(axis=1, initial=0) < np.uint64((rank + 1) << 32)
        live = ~done[text_of]
        if not live.all():
            values, text_of = values[live], text_of[live]
            history = [h[live] for h in history]
            deals = deals[live] if deals is not None else None
    return best.reshape(n, places)


def _banded(sums: np.ndarray) -> np.ndarray:
    """Band keys whose lowest bits are the number of the band."""
    return (mixed(sums + np.arange(1, BANDS + 1, dtype=np.uint64) * STEP) & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)


def sign(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_key, digest of the words, number of shingles, band keys and sketch of each document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = powers(0x9FB21C651E98DF25, ROWS)
        for batch in batches:
            for part in slices(batch, "text"):
                values, borders, digests = shingles(part.column("text"))
                signature = super_minhash(values, borders)
                own = mixed(signature)
                keys = _banded((own.reshape(-1, BANDS, ROWS) * lane).sum(axis=2))
                sketch = (own & np.uint64(0xFF)).astype(np.uint8)
                n = len(borders) - 1
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text_key"), pa.array(digests, pa.binary()), pa.array(np.diff(borders)), bands,
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "digest", "n_shingles", "bands", "sketch"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(whole(text)).alias("text_key"), whole(text).alias("text"))
    return rows.mapInArrow(released(run), SIGNED)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(cid, text) -> (cid, sorted shingles as array<bigint>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, borders, _ = shingles(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("cid"), lists], names=["cid", "shingles"])

    return texts.mapInArrow(released(run), "cid bigint, shingles array<bigint>")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def likely_pairs(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity leaves the threshold in reach."""
    left = sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    right = sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    fits = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
    joined = pairs.join(left, "a").join(right, "b").filter(fits).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("sa", "sb"))
                keep = pa.array(_alike(a, b) >= threshold - MARGIN)
                yield batch.select(["a", "b"]).filter(keep)

    return joined.mapInArrow(released(run), "a bigint, b bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach `percent` per cent of similarity."""
    a = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("xa"))
    b = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("xb"))
    common = F.size(F.array_intersect("xa", "xb"))
    enough = F.lit(100) * common >= F.lit(percent) * (F.size("xa") + F.size("xb") - common)
    return pairs.join(a, "a").join(b, "b").filter(enough).select("a", "b")


class Forest:
    """Union-find over numbers; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (over := self.up.get(top, top)) != top:
            top = over
        while (over := self.up.get(x, x)) != top and over != x:
            self.up[x], x = top, over
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


#: Links a task's forest takes in before it hands its trees on; bounds its memory.
FOREST_LINKS = 500_000


def _forests(links: DataFrame) -> DataFrame:
    """Each partition's links (a, b) as trees: (a, b) with b the root of a's tree in that partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, taken = Forest(), 0

        def trees() -> pa.RecordBatch:
            rows = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
            a, b = zip(*rows, strict=True) if rows else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            taken += batch.num_rows
            if taken >= FOREST_LINKS:
                yield trees()
                forest, taken = Forest(), 0
        yield trees()

    return links.select("a", "b").mapInArrow(released(run), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(cid, root) of every member of a link; root is the smallest member reachable.

    Trees are dealt by their members, so that a member of several trees brings their roots together; rounds go on
    until every member has one root that is no member itself. A round's trees are written to the shared folder.
    """
    trees = cut(_forests(links), "forest")
    while True:
        best = cut(trees.groupBy("a").agg(F.min("b").alias("b")), "forest-roots")
        # A root that has itself been given a root, or a member with a second root, is not settled.
        others = trees.alias("t").join(best.alias("r"), "a").filter("t.b != r.b").select(F.col("t.b").alias("a"), F.col("r.b").alias("b"))
        above = best.alias("m").join(best.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        moved = cut(above, "forest-moved")
        open_links = cut(others.distinct(), "forest-open")
        if moved.isEmpty() and open_links.isEmpty():
            drop_tables(trees, moved, open_links)
            return best.select(F.col("a").alias("cid"), F.col("b").alias("root"))
        settled = best.join(moved.select("a", F.col("b").alias("c")), "a", "left").select("a", F.coalesce("c", "b").alias("b"))
        again = cut(_forests(settled.unionByName(open_links).repartition("a")), "forest")
        drop_tables(trees, moved, open_links)
        trees = again


def _block_pairs(threshold: float):
    """Per pair of blocks: the classes that have a likely partner in another group whose first common band this is."""

    def run(group: pa.Table) -> pa.Table:
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, PLACES)
        keys = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        cid, root, size = (group.column(c).to_numpy() for c in ("cid", "root", "n_shingles"))
        band, side = int(group.column("band")[0].as_py()), group.column("side").to_numpy()
        same_block = bool((side == side[0]).all())
        found: list[tuple[int, int]] = []
        for i in range(len(cid)):
            later = np.arange(len(cid)) > i
            other = later & (root != root[i])
            if not same_block:
                other &= side != side[i]
            other &= np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i])
            at = np.flatnonzero(other)
            if not len(at):
                continue
            likely = _alike(sketch[at], sketch[i]) >= threshold - MARGIN
            # The pair belongs to the first band in which the two share a bucket.
            first = (keys[at] == keys[i]).argmax(axis=1) == band
            found += [(i, int(j)) for j in at[likely & first]]
        members = sorted({x for pair in found for x in pair})
        partners: dict[int, list[int]] = {i: [] for i in members}
        for i, j in found:
            partners[i].append(int(cid[j]))
        key = group.column("key").slice(0, 1).to_pylist()[0]
        return pa.table({
            "key": pa.array([key] * len(members), pa.string()), "cid": pa.array(cid[members], pa.int64()),
            "root": pa.array(root[members], pa.int64()), "partners": pa.array([partners[i] for i in members], pa.list_(pa.int64())),
        })

    return run


def _check_block(percent: int):
    """Links among the listed partners of one pair of blocks, skipping pairs whose groups have met."""

    def run(group: pa.Table) -> pa.Table:
        cids, roots = group.column("cid").to_pylist(), dict(zip(group.column("cid").to_pylist(), group.column("root").to_pylist(), strict=True))
        sets = {c: np.asarray(x, np.int64) for c, x in zip(cids, group.column("shingles").to_pylist(), strict=True)}
        forest, out = Forest(), []
        for a, partners in zip(cids, group.column("partners").to_pylist(), strict=True):
            for b in partners:
                if forest.root(roots[a]) == forest.root(roots[b]):
                    continue
                both = np.sort(np.concatenate([sets[a], sets[b]]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    forest.join(roots[a], roots[b])
                    out.append((max(a, b), min(a, b)))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _open_buckets(met: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (key, cid, root, n) of the buckets of three or more whose members are in different groups."""
    members = met.join(groups, "cid", "left").select("key", "cid", "n", F.coalesce("root", "cid").alias("root"))
    members = cut(members, "near-members")
    open_ = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return members.join(cut(open_.select("key"), "near-mixed"), "key")


#: Bits of the map that keeps texts nobody asks for out of the shuffle, and its parts.
MAP_BITS, MAP_PARTS = 1 << 26, 128


def key_map(keys: DataFrame, column: str) -> np.ndarray:
    """A bit map of fixed size with the keys' bits set, gathered part by part."""
    size = MAP_BITS // MAP_PARTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            for part in np.unique(bit // size).tolist():
                parts.setdefault(part, np.zeros(size, bool))[bit[bit // size == part] % size] = True
        rows = [np.packbits(v).tobytes() for v in parts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(rows, pa.binary())], names=["part", "bits"])

    bits = keys.select(F.pmod(F.col(column), F.lit(MAP_BITS)).alias("bit")).distinct()
    bits = bits.repartition(MAP_PARTS, F.floor(F.col("bit") / size))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for row in bits.mapInArrow(released(mark), "part int, bits binary").collect():
        out[row["part"] * size // 8 : (row["part"] + 1) * size // 8] |= np.frombuffer(row["bits"], np.uint8)
    return out


def asked_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) rows of `docs` that may be among `wanted`.

    The map lets through every key that is wanted and, while it is not crowded, few others; what passes is matched
    exactly afterwards, so a crowded map costs traffic and nothing else.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key_map(wanted, "_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.mod(batch.column("text_key").to_numpy(), MAP_BITS)
            keep = shared.value[bit // 8] & (128 >> (bit % 8)) > 0
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(released(run), docs.schema)


def link_documents(
    docs: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, kept.

    Documents are linked when 100 * common >= percent * all of their shingles; kept is doc_id = component_id.
    """
    threshold = percent / 100
    spark = docs.sparkSession
    signed = cut(sign(docs, text, doc_id), "near-signed")
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("pick")
    # Documents with the same words have the same shingles, hence one signature: any of the group's will do.
    classes = signed.filter("n_shingles > 0").groupBy("digest").agg(
        pick, F.max("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")
    )
    classes = classes.select("digest", "pick.doc_id", "pick.text_key", "n_shingles", "bands", "sketch")
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    first = classes.select("cid", "n_shingles", "bands", "sketch")
    bands = classes.select("cid", F.explode("bands").alias("key"))
    # A bucket of two is a pair as it stands; only larger ones gather their members.
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("least"), F.max("cid").alias("most"))
    buckets = cut(buckets.filter("n > 1"), "near-buckets")
    met = cut(bands.join(buckets.filter("n > 2").select("key", "n", "least"), "key"), "near-met")
    star = buckets.filter("n = 2").select(F.col("most").alias("a"), F.col("least").alias("b"))
    star = star.unionByName(met.filter("cid != least").select(F.col("cid").alias("a"), F.col("least").alias("b"))).distinct()
    star = cut(likely_pairs(star, first, threshold), "near-star")
    # Full sets are rebuilt for the classes that may be compared.
    asked = star.select(F.col("a").alias("cid")).unionByName(star.select(F.col("b").alias("cid"))).unionByName(met.select("cid"))
    wanted = classes.join(asked.distinct(), "cid").select("cid", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    wanted = cut(wanted, "near-wanted")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(whole(text)).alias("text_key"), whole(text).alias("text"))
    same = (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    # Rows equal in id and text are one row from here on, so repeated rows do not multiply the comparisons.
    texts = asked_texts(texts, wanted).dropDuplicates(["text_key", "doc_id"])
    texts = texts.join(wanted, same).select("cid", "text")
    sets = cut(shingle_sets(texts), "near-sets")
    links = cut(confirmed(star, sets, percent), "near-links")
    groups = components(links)
    open_ = cut(_open_buckets(met, groups), "near-open")
    if not open_.isEmpty():
        blocks = F.ceil(F.col("n") / BLOCK_CLASSES).cast("int")
        mine = F.pmod(F.xxhash64("cid", "key"), blocks).cast("int")
        spread = open_.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        spread = spread.select(
            F.concat_ws(":", "key", low, high).alias("key"), F.col("key").bitwiseAND(63).alias("band"), "cid", "root",
            F.when(F.col("mine") == low, 0).otherwise(1).alias("side"),
        )
        spread = spread.join(first, "cid")
        pairs = spread.groupBy("key").applyInArrow(_block_pairs(threshold), "key string, cid bigint, root bigint, partners array<bigint>")
        pairs = cut(pairs, "near-block-pairs")
        more = pairs.join(sets, "cid").groupBy("key").applyInArrow(_check_block(percent), "a bigint, b bigint")
        every = cut(links.unionByName(more), "near-links")
        groups = components(every)
    smallest = classes.select("cid", "doc_id", "digest").join(groups, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = cut(smallest, "near-grouped")
    heads = cut(smallest.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-heads")
    named = cut(smallest.join(heads, "root").select("digest", "component_id"), "near-named")
    out = signed.select("doc_id", "text_key", "digest", "n_shingles").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    drop_tables(buckets, met, sets, star)
    return out


def keep_one_of_each(docs: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay: of each group the one of the smallest id, with all its columns."""
    id_, key = unused(docs, "_kept_id"), unused(docs, "_kept_key")
    kept = link_documents(docs, percent, text, doc_id).filter("kept")
    kept = kept.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    same = (F.xxhash64(whole(text)) == F.col(key)) & F.col(doc_id).eqNullSafe(F.col(id_))
    return docs.join(kept, same, "left_semi")
