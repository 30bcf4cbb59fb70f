"""From raw documents to packed training sequences: five stages over one table.

Each stage reads all that its predecessor kept, and its decisions take effect; all but the last return the columns
of `documents`. Between stages the table is written to the shared folder and read again, so a lost executor never
repeats more than the stage at work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from farewise.llm import exact_dedup, host_rules, near_dedup, packing, pii
from farewise.llm.common import cut, drop_tables

#: Near duplicates share this many per cent of their five-word shingles.
NEAR_PERCENT = 80
END_ID = 1
#: Packing and near duplicates are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host fails as a whole, go."""
    return host_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    index = exact_dedup.fresh_index(docs)
    kept = exact_dedup.keep_first_copies(docs, index)
    index.drop()
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return near_dedup.keep_one_of_each(docs, NEAR_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    return pii.redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document and its place in a training sequence."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("personal data", personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        result = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            drop_tables(before)
        before = docs = result
    return docs
