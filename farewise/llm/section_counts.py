"""Token counts per section of whole encoded documents.

A document is encoded once and whole; the byte length of each id gives the token's span, the spans are joined with the
sorted sections by binary search, and each token is allotted to one section, so the counts add up to the document's.

Rule for a token that crosses a border: it belongs to the section that holds most of its characters, of equal shares
to the earlier one; a token without a character in any section is counted under section -1.

Defined results: sections are the lines of the text (each with its newline, so a newline at the end opens no further line) unless a column of sections is given; those
must be sorted and disjoint, in code points, and empty ones count nothing; a null or empty text has one empty line; a
null list of sections counts as none; repeated rows are each counted; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import bounded_batches, flat, released, slices, whole
from farewise.llm.tokens import TOKEN_BLOCK, encoder

COUNTS = "doc_id bigint, section bigint, name string, start bigint, end bigint, n_tokens bigint, n_crossing bigint"


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str) -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary stands for."""
    names = encoder(vocabulary).tokenizer.get_vocab()
    out = np.zeros(max(names.values()) + 1, np.int64)
    for name, i in names.items():
        out[i] = len(name)
    return out


def allot(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each span by the rule above, and whether the span crosses a section's border."""
    if not len(lows):
        return np.full(len(starts), -1), np.zeros(len(starts), bool)
    # Sections that a span meets: from the first that ends after its start to the last that begins before its end.
    first = np.searchsorted(highs, starts, side="right")
    last = np.searchsorted(lows, ends, side="left") - 1
    met = last >= first
    section = np.where(met, first, -1)
    inner = met & (first == last)
    at = np.where(inner, first, 0)
    crossing = met & ~(inner & (lows[at] <= starts) & (highs[at] >= ends))
    for i in np.flatnonzero(met & (first < last)):
        span = np.arange(first[i], last[i] + 1)
        share = np.minimum(highs[span], ends[i]) - np.maximum(lows[span], starts[i])
        section[i] = span[share.argmax()] if share.max() > 0 else -1
    return section, crossing


def field_sections(fields: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """The fields joined as one text, and the sections column that names each field's span."""
    values = [whole(F.col(f).cast("string")) for f in fields]
    spans, at = [], F.lit(0)
    for name, value in zip(fields, values, strict=True):
        end = at + F.char_length(value)
        spans.append(F.struct(F.lit(name).alias("name"), at.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        at = end + len(separator)
    return F.array_join(F.array(*values), separator), F.array(*spans)


def count_tokens(
    docs: DataFrame, vocabulary: str, text: str | Column = "text", doc_id: str = "doc_id", sections: Column | None = None
) -> DataFrame:
    """One row per document and section: its place, name, span, tokens allotted, and how many of them cross a border.

    `sections` is a column array<struct<name, start, end>>; without it the lines are the sections.
    """
    bounded_batches(docs.sparkSession)
    listed_sections = sections is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = encoder(vocabulary), token_bytes(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", TOKEN_BLOCK):
                data, offsets = flat(part.column("text"))
                ids, borders = own.encode(data, offsets)
                ends = np.cumsum(sizes[ids])
                begins = ends - sizes[ids]
                # Characters up to and with each byte; a token inside a character covers that character.
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                breaks = np.flatnonzero(data == 10) + 1
                given = part.column("sections").to_pylist() if listed_sections else None
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                names: list[str | None] = []
                for k, name in enumerate(part.column("doc_id").to_pylist()):
                    low, high = offsets[k], offsets[k + 1]
                    t = slice(borders[k], borders[k + 1])
                    base = chars[low]
                    starts = chars[begins[t] + 1] - 1 - base
                    stops = chars[ends[t]] - base
                    if given is None:
                        cuts = breaks[np.searchsorted(breaks, low, side="right") : np.searchsorted(breaks, high, side="left")]
                        edges = chars[np.concatenate([[low], cuts, [high]])] - base
                        lows, highs = edges[:-1], edges[1:]
                        names += [None] * len(lows)
                    else:
                        listed = given[k] or []
                        lows = np.array([s["start"] for s in listed], np.int64)
                        highs = np.array([s["end"] for s in listed], np.int64)
                        names += [s["name"] for s in listed]
                    section, crossing = allot(starts, stops, lows, highs)
                    counts = np.bincount(section + 1, minlength=len(lows) + 1)
                    crossed = np.bincount(section[crossing] + 1, minlength=len(lows) + 1)
                    numbers = np.arange(len(lows))
                    if counts[0]:
                        lows, highs, numbers = np.append(lows, 0), np.append(highs, 0), np.append(numbers, -1)
                        names.append(None)
                        counts, crossed = np.append(counts[1:], counts[0]), np.append(crossed[1:], crossed[0])
                    else:
                        counts, crossed = counts[1:], crossed[1:]
                    owner = np.ma.masked_all(len(lows), np.int64) if name is None else np.full(len(lows), name)
                    for column, value in zip(columns, (owner, numbers, lows, highs, counts, crossed), strict=True):
                        column.append(value)
                doc, number, low_, high_, n, c = (np.ma.concatenate(x) for x in columns)
                arrays = [pa.array(np.ma.getdata(x).astype(np.int64), mask=np.ma.getmaskarray(x)) for x in (doc, number, low_, high_, n, c)]
                arrays.insert(2, pa.array(names, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in COUNTS.split(", ")])

    value = whole(text)
    columns = [F.col(doc_id).cast("bigint").alias("doc_id"), value.alias("text")]
    if sections is not None:
        columns.append(sections.cast("array<struct<name:string,start:bigint,end:bigint>>").alias("sections"))
    return docs.select(*columns).mapInArrow(released(run), COUNTS)
