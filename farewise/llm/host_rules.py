"""Document quality rules with verdicts per host.

Each text is measured once (words, symbols, repeated lines, repeated word windows). Failures are counted per host by
partial aggregation; the hosts' failure rates are shrunk towards the corpus by a beta prior fitted to all hosts by
moments; a host whose shrunk rate passes the limit fails with all its documents.

Defined results: a null or blank text has no words and fails; a document without host is judged on its own measures;
lines and word windows are compared by 64-bit fingerprints; repeated rows are each judged; an empty table gives an
empty result. Where all hosts fail alike (no spread to fit), the prior keeps its largest weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import bounded_batches, cut, flat, mixed, per_text, released, slices, span_hashes, unused, whole, window_hashes, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
#: A host fails when its shrunk failure rate is above this.
HOST_LIMIT = 0.5
#: Default bounds of the prior's weight, in documents.
PRIOR_WEIGHT: tuple[float | None, float | None] = (2.0, 200.0)
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Marks of the values that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The five measures of each text."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    text_of = np.repeat(np.arange(n), np.diff(first))
    salt = mixed(np.arange(1, n + 1, dtype=np.uint64))
    # A byte that continues a character is not counted.
    inked = np.zeros(len(data) + 1, np.int32)
    inked[starts] += 1
    np.subtract.at(inked, ends, 1)
    inside = np.cumsum(inked)[:-1] > 0 if len(data) else np.zeros(0, bool)
    chars = per_text(offsets, inside & ((data & 0xC0) != 0x80))
    symbols = per_text(offsets, SYMBOLS[data])
    # Lines: borders are newlines and the texts' own ends.
    breaks = np.flatnonzero(data == 10)
    line_at = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_to = np.sort(np.concatenate([offsets[1:], breaks]))
    filled = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_at)
    line_at, line_to = line_at[filled], line_to[filled]
    owner = np.searchsorted(offsets, line_at, side="right") - 1
    lines = mixed(span_hashes(data, line_at, line_to) ^ salt[owner]) if len(line_at) else np.zeros(0, np.uint64)
    firsts = np.zeros(len(lines), bool)
    firsts[np.unique(lines, return_index=True)[1]] = True
    dup_lines = np.bincount(owner[~firsts], minlength=n)
    # Windows of words within one text; a word counts once however many repeated windows cover it.
    covered = np.zeros(len(starts) + 1, np.int32)
    if len(starts) >= WINDOW:
        windows = window_hashes(span_hashes(data, starts, ends), WINDOW)
        at = np.flatnonzero(text_of[: len(windows)] == text_of[WINDOW - 1 :])
        at = at[_repeats(mixed(windows[at] ^ salt[text_of[at]]))]
        covered[at] += 1
        np.subtract.at(covered, at + WINDOW, 1)
    repeated = per_text(first, np.cumsum(covered)[:-1] > 0)
    return dict(zip(MEASURES, (np.diff(first), chars, symbols, dup_lines, repeated), strict=True))


def measured(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """`columns` (whose types Arrow keeps) with the five measures of the text."""
    kept = docs.select(*columns, whole(text).alias("_text"))
    names = kept.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")
    schema += "".join(f", {m} bigint" for m in MEASURES)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = measure(part.column("_text"))
                arrays = [part.column(c) for c in names] + [pa.array(v.astype(np.int64)) for v in found.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *found])

    return kept.mapInArrow(released(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def host_verdicts(
    judged: DataFrame, host: str = "host", failed: str = "base_failed", bounds: tuple[float | None, float | None] = PRIOR_WEIGHT
) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate and whether the host fails.

    The prior's mean is the corpus rate; its weight follows from the spread of the hosts' rates beyond what
    sampling alone gives (moments). `bounds` are the least and the largest weight, in documents; None leaves the
    fitted weight as it is (above 0). Where nothing can be fitted, the weight is the upper bound, or without one the
    number of documents.
    """
    hosts = judged.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad")
    )
    hosts = cut(hosts, "host-counts")
    rate = F.col("bad") / F.col("n")
    prior = hosts.agg(
        F.sum("bad").cast("double").alias("b"), F.sum("n").cast("double").alias("d"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * rate * rate).alias("s2"), F.sum(F.col("n") * F.col("n").cast("double")).alias("n2"),
    ).first()
    low, high = bounds[0] or 0.0, float("inf") if bounds[1] is None else bounds[1]
    mean, weight = 0.0, min(high, prior["d"] or 0.0) if bounds[1] is None else high
    if prior["d"]:
        mean = prior["b"] / prior["d"]
        noise = mean * (1 - mean)
        # Weighted spread of the rates less its sampling part, per unit of weight between hosts.
        between = prior["s2"] - prior["d"] * mean * mean - (prior["k"] - 1) * noise
        unit = prior["d"] - prior["n2"] / prior["d"]
        if between > 0 and unit > 0:
            weight = min(high, max(low, noise * unit / between - 1))
    shrunk = (F.col("bad") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select("host", "n", "bad", shrunk.alias("host_rate"), (shrunk > HOST_LIMIT).alias("host_failed"))


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, host, measures, base_failed, host_rate, host_failed, kept."""
    rows = measured(docs, text, F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"))
    rows = cut(rows.withColumn("base_failed", base_failed()), "quality-measures")
    joined = rows.join(host_verdicts(rows).drop("n", "bad"), "host", "left")
    failed = F.coalesce("host_failed", F.lit(False))
    return joined.select(
        "doc_id", "host", *MEASURES, "base_failed", "host_rate", failed.alias("host_failed"), (~F.col("base_failed") & ~failed).alias("kept")
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that stay, with all their columns. Each text is measured once, into a stored table."""
    failed, bad = unused(docs, "_failed"), unused(docs, "_failed_host")
    rows = cut(_with_failure(docs, text, failed), "quality-measured")
    judged = rows.select(F.col(host).cast("string").alias("host"), F.col(failed).alias("base_failed"))
    bad_hosts = host_verdicts(judged).filter("host_failed").select(F.col("host").alias(bad))
    good = rows.filter(~F.col(failed)).drop(failed)
    return good.join(bad_hosts, F.col(host).cast("string") == F.col(bad), "left_anti")


def _with_failure(docs: DataFrame, text: str, failed: str) -> DataFrame:
    """All columns, and whether a row's own measures fail."""
    bounded_batches(docs.sparkSession)
    value = unused(docs, "_text")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, value):
                m = measure(part.column(value))
                poor = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(poor)], names=[*names, failed])

    return docs.withColumn(value, whole(text)).mapInArrow(released(run), docs.withColumn(failed, F.lit(True)).schema)
