"""How far the sources of a language stand apart in their words, in exact integers.

Spark ML's `CountVectorizer` with `minDF` and the largest `vocabSize` gives each language its vocabulary: terms
carry their language, so one fit serves all languages and a term's document count is its count in that language.
The fitted model turns each document into an exact sparse vector; sums of these vectors by (language, source) are
taken sparsely, within tasks first, and everything after reads the table of (language, source, term, count).

A fitted vocabulary is held by the driver and by each executor. Terms are therefore dealt by hash into as many fits as
keep a vocabulary near `MODEL_TERMS`, from a count of distinct terms; each fit reads the texts again. Totals are taken
over all fits, so the results don't depend on their number.

Pairs of sources are compared in chunks of terms. A chunk holds the terms of two groups of sources that meet;
each term that a source has is compared with all sources of both groups at once, and terms that neither source
of a pair has are not visited: all have the same value, which is multiplied by their number. Chunks leave one sum a pair.

Defined results: null text, language and source are empty strings; an empty table gives an empty result. Every
(language, source) found is a group, with or without terms. Values of equal size are ranked by their item's bytes.
Repeated rows count as often as they occur; extra columns are not read. Numbers of occurrences up to 2 ** 47 and sums
up to 2 ** 63 are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewise.llm.common import LOWER, bounded_batches, cut, flat, mixed, released, runs, slices, span_hashes, whole
from farewise.session import scratch_path

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 10**9
#: Factors of `SCALE`, so that its product with a count fits a long at each step of a division.
SCALE_PARTS = (31250, 32000)
#: Fixed value: bytes of terms, all but ASCII without its letters.
TERM_BYTE = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
#: Hashes kept to estimate the number of distinct terms, within about 3 %.
SKETCH = 4096
#: Distinct terms of one fit, kept or not, about 100 bytes each in the driver and the executors.
MODEL_TERMS = 4_000_000
#: (language, source, term) rows of one chunk, sources of one group and salts of a language's pairs.
CHUNK_ROWS = 50_000
GROUP_SOURCES = 128
SALTS = 16
SLICE_BYTES = 1 << 18
TAGGED = "lang string, source string, terms array<string>"
COUNTS = "lang string, source string, index int, n bigint"
SUMS = "lang string, a string, b string, value bigint, shared bigint"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of documents with their lower-cased bytes, starts and ends of terms, and the first term of each text."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            data, offsets = flat(part.column("text"))
            data = LOWER[data]
            starts, ends, first = runs(TERM_BYTE[data], offsets)
            yield part, data, starts, ends, first


def _tagged(batches: Iterator[pa.RecordBatch], once: bool = False) -> Iterator[pa.RecordBatch]:
    """The terms of each text, each behind its language and a byte that no term has.

    `once` leaves out repetitions within a text and all columns but the terms.
    """
    for part, data, starts, ends, first in _terms(batches):
        tags, upto = flat(part.column("lang"))
        gap = len(upto) - 1
        # The output's bytes come from all tags with their ends, then the text; tag and term take turns.
        tags = np.insert(tags, upto[1:], 0)
        upto = upto + np.arange(gap + 1)
        text_of = np.repeat(np.arange(gap), np.diff(first))
        sizes = np.empty(2 * len(starts), np.int64)
        sizes[0::2], sizes[1::2] = np.diff(upto)[text_of], ends - starts
        places = np.concatenate([[0], np.cumsum(sizes)])
        # Places of bytes need eight bytes each only where a text is very long.
        kind = np.int32 if max(places[-1], len(tags) + len(data)) < 2**31 else np.int64
        shift = np.empty(len(sizes), kind)
        shift[0::2], shift[1::2] = upto[text_of] - places[:-1:2], starts + len(tags) - places[1::2]
        take = np.repeat(shift, sizes)
        take += np.arange(places[-1], dtype=kind)
        values = pa.Array.from_buffers(
            pa.large_string(), len(starts), [None, pa.py_buffer(places[::2].copy()), pa.py_buffer(np.concatenate([tags, data])[take])]
        )
        del take, shift
        if once:
            coded = values.dictionary_encode()
            # First occurrences keep their order, so the pairs stay grouped by text.
            pairs = pa.array(text_of << 32 | coded.indices.to_numpy()).unique().to_numpy()
            terms = coded.dictionary.take(pa.array(pairs & 0xFFFFFFFF)).cast(pa.string())
            first = np.searchsorted(pairs >> 32, np.arange(gap + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(first, pa.int32()), terms)], names=["terms"])
            continue
        terms = pa.ListArray.from_arrays(pa.array(first, pa.int32()), values.cast(pa.string()))
        yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("source"), terms], names=["lang", "source", "terms"])


def _least_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The `SKETCH` smallest hashes of a task's (language, term) pairs."""
    least = np.zeros(0, np.uint64)
    for part, data, starts, ends, first in _terms(batches):
        tags, upto = flat(part.column("lang"))
        own = np.array([xxhash.xxh64_intdigest(tags[a:b].tobytes()) for a, b in zip(upto[:-1], upto[1:], strict=True)], np.uint64)
        hashes = np.unique(mixed(span_hashes(data, starts, ends) ^ np.repeat(own, np.diff(first))))
        least = np.unique(np.concatenate([least, hashes[:SKETCH]]))[:SKETCH]
    yield pa.RecordBatch.from_arrays([pa.array((least >> np.uint64(1)).astype(np.int64))], names=["hash"])


def distinct_terms(docs: DataFrame) -> int:
    """About how many distinct (language, term) pairs there are, from the smallest hashes of all."""
    least = docs.mapInArrow(released(_least_hashes), "hash bigint").distinct().orderBy("hash").limit(SKETCH)
    n, most = least.agg(F.count(F.lit(1)), F.max("hash")).first()
    return n if n < SKETCH else int((SKETCH - 1) * 2.0**63 / most)


def _sum_vectors(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Sums of sparse vectors by (language, source), over about `limit` entries of a task at a time."""
    groups: dict[tuple[str, str], int] = {}
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def total() -> pa.RecordBatch:
        nonlocal keys, counts, held
        order, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(order), np.int64)
        np.add.at(sums, place, np.concatenate(counts))
        names = list(groups)
        of = (order >> 32).tolist()
        langs, sources = pa.array([names[g][0] for g in of], pa.string()), pa.array([names[g][1] for g in of], pa.string())
        keys, counts, held = [order], [sums], len(order)
        index = pa.array((order & 0xFFFFFFFF).astype(np.int32))
        return pa.RecordBatch.from_arrays([langs, sources, index, pa.array(sums)], names=["lang", "source", "index", "n"])

    for batch in batches:
        vectors = batch.column("vector")
        indices, values = vectors.field("indices"), vectors.field("values")
        own = [groups.setdefault(pair, len(groups)) for pair in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)]
        sizes = indices.value_lengths().to_numpy(zero_copy_only=False)
        keys.append(np.repeat(np.array(own, np.int64) << 32, sizes) | indices.flatten().to_numpy().astype(np.int64))
        counts.append(values.flatten().to_numpy().astype(np.int64))
        held += int(sizes.sum())
        if held > limit:
            done = total()
            if held > limit // 2:  # hardly anything met: pass on what there is
                yield done
                keys, counts, held = [], [], 0
                groups = {}
    if held:
        yield total()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences of each kept term in each group that has it.

    `docs` has lang, source and text without nulls.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 4 << 20)
    tagged = docs.mapInArrow(released(_tagged), TAGGED)
    # A vocabulary depends on document counts alone, so it is fitted to each document's distinct terms.
    presence = docs.mapInArrow(released(lambda batches: _tagged(batches, once=True)), "terms array<string>")
    fits = max(1, -(-distinct_terms(docs.select("lang", "text")) // MODEL_TERMS))
    tables = []
    for k in range(fits):
        own = F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(fits)) == k) if fits > 1 else F.col("terms")
        vectorizer = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(LEAST_DOCS), vocabSize=2**31 - 1)
        try:
            model = vectorizer.fit(presence.select(own.alias("terms")))
        except IllegalArgumentException as error:
            if "vocabulary size should be > 0" not in str(error):
                raise
            continue  # no term is in enough documents
        path = scratch_path(spark, "vocabulary")
        model.write().save(path)
        names = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("index", "tag"))
        sums = model.transform(tagged.withColumn("terms", own)).select("lang", "source", "vector").mapInArrow(released(_sum_vectors), COUNTS)
        sums = sums.groupBy("lang", "source", "index").agg(F.sum("n").alias("n"))
        term = F.substring_index("tag", "\0", -1).alias("term")
        tables.append(cut(sums.join(names, "index").select("lang", "source", term, "n"), "term-counts"))
    if not tables:
        return spark.createDataFrame([], "lang string, source string, term string, n bigint")
    counts = tables[0]
    for table in tables[1:]:
        counts = counts.unionByName(table)
    return counts


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), without leaving the range of a long."""
    first, second = SCALE_PARTS
    whole_ = total + 2 * terms
    scaled = (count + 2) * first
    return 1 + _div(scaled, whole_) * second + _div((scaled % whole_) * second, whole_)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _coded(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """Distinct strings and the place of each row's string among them."""
    coded = column.combine_chunks().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _compare(key: tuple, chunk: pa.Table) -> pa.Table:
    """Sums over one chunk of terms for the pairs of sources of two groups.

    For a pair (a, b), a before b: the values of all terms that a or b has, and the number of terms that both have.
    """
    lang, group_a, group_b = (k.as_py() for k in key[:3])
    names, who = _coded(chunk.column("source"))
    group, base = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    group[who], base[who] = chunk.column("source_group").to_numpy(), chunk.column("base").to_numpy()
    real = chunk.column("term").is_valid().to_numpy()
    terms, term = _coded(chunk.column("term").filter(pa.array(real)))
    shares = np.zeros((len(names), len(terms)), np.int64)
    shares[who[real], term] = chunk.column("share").to_numpy()[real]
    values = np.zeros((len(names), len(names)), np.int64)  # over the terms of the first source
    lacking = np.zeros_like(values)  # over those of them that the second lacks
    shared = np.zeros_like(values)
    for a in range(len(names)):
        own = np.flatnonzero(shares[a])
        others = shares[:, own]
        has = others > 0
        others = np.where(has, others, base[:, None])
        gap = shares[a, own] - others
        found = gap * gap // (shares[a, own] + others)
        values[a], shared[a] = found.sum(axis=1), has.sum(axis=1)
        lacking[a] = np.where(has, 0, found).sum(axis=1)
    total = values + lacking.T
    rank = np.argsort(np.argsort(np.array([n.encode() for n in names], object)))
    meet = np.minimum(group[:, None], group[None, :]) == group_a
    meet &= np.maximum(group[:, None], group[None, :]) == group_b
    first, second = np.nonzero(meet & (rank[:, None] < rank[None, :]))
    return pa.table({
        "lang": pa.array([lang] * len(first), pa.string()),
        "a": pa.array([names[k] for k in first], pa.string()), "b": pa.array([names[k] for k in second], pa.string()),
        "value": pa.array(total[first, second]), "shared": pa.array(shared[first, second]),
    })


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of lang, source, part, item, value and rank.

    Part "pair" has each other source of the language with the summed distance over all kept terms, part "term" the
    `TOP_TERMS` terms that the source uses more than its language and that stand farthest apart.
    """
    clean = docs.select(whole(text).alias("text"), whole(lang).alias("lang"), whole(source).alias("source"))
    counts = term_counts(clean)
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_terms"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    by_lang = by_term.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    groups = clean.select("lang", "source").distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0)
    base = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    width = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / GROUP_SOURCES).cast("int").alias("groups"))
    groups = groups.withColumn("base", base).join(width, "lang")
    groups = groups.withColumn("source_group", F.pmod(F.xxhash64("source"), "groups").cast("int"))
    groups = cut(groups, "divergence-groups")
    counts = counts.join(groups.drop("own_terms"), ["lang", "source"])
    counts = counts.withColumn("share", share(F.col("n"), F.col("total"), F.col("terms")))
    rows = _pairs(counts, groups).unionByName(_top_terms(counts))
    return rows.select("lang", "source", "part", "item", "value", "rank")


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """The part "pair": each source with every other source of its language."""
    chunks = max(1, -(-counts.count() // CHUNK_ROWS))
    other = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other")
    place = F.pmod(F.xxhash64("term"), F.lit(chunks)).alias("chunk")
    met = counts.select("lang", "source", "source_group", "base", "groups", "share", "term", place)
    # A row without a term brings every source to every chunk, where others' terms meet what it has of none.
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))).alias("chunk")
    bare = groups.filter("terms > 0").select(
        "lang", "source", "source_group", "base", "groups", F.lit(0).cast("bigint").alias("share"), F.lit(None).cast("string").alias("term"), every
    )
    met = met.unionByName(bare).select("*", other)
    group_a, group_b = F.least("source_group", "other").alias("group_a"), F.greatest("source_group", "other").alias("group_b")
    met = met.select("lang", group_a, group_b, "chunk", "source", "source_group", "base", "share", "term")
    sums = met.groupBy("lang", "group_a", "group_b", "chunk").applyInArrow(_compare, SUMS)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("shared").alias("shared"))
    # Every ordered pair of a language is a row of the result; salts spread a language of many sources.
    mine = groups.select("lang", "source", "own_terms", "base", "terms", F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("salt"))
    theirs = groups.select(
        "lang", F.col("source").alias("item"), F.col("own_terms").alias("item_terms"), F.col("base").alias("item_base"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"),
    )
    pairs = mine.join(theirs, ["lang", "salt"]).filter("source <> item")
    pairs = pairs.withColumn("a", F.least("source", "item")).withColumn("b", F.greatest("source", "item"))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").fillna(0, ["value", "shared"])
    absent = F.col("terms") - F.col("own_terms") - F.col("item_terms") + F.col("shared")
    value = F.when(F.col("terms") > 0, F.col("value") + absent * distance(F.col("base"), F.col("item_base"))).otherwise(0)
    return _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))


def _top_terms(counts: DataFrame) -> DataFrame:
    """The part "term"."""
    every = F.sum("n").over(Window.partitionBy("lang", "term"))
    rows = counts.withColumn("lang_share", share(every, F.col("lang_total"), F.col("terms"))).filter("share > lang_share")
    value = distance(F.col("share"), F.col("lang_share")).alias("value")
    return _ranked(rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value)).filter(F.col("rank") <= TOP_TERMS)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
