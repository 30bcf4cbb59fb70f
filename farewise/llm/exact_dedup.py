"""Exact duplicates by a persistent digest index (DataFrame functions only).

The index is a Parquet table bucketed and sorted by the SHA-256 of the text. A batch of documents is reduced to
one row per digest (partial aggregation, so a group of copies of any size meets as a few partial rows), compared
with the index by a sort-merge anti-join that leaves the index where it is, and its new digests are appended. Of a digest
that the index knows only the number of further copies is appended, so group sizes add up over batches.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays (null ids come
last; of rows equal in id and text exactly one stays); texts already in the index keep the document recorded there.
An empty table gives an empty result. Extra columns are ignored by `deduplicate` and kept by `keep_first_copies`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from farewise.llm.common import cut, drop_tables, unused, whole

#: Digests per bucket at which an index is laid out: about 50 MB, one task each.
BUCKET_ROWS = 500_000
LEAST_BUCKETS = 8
#: A digest with more than 1 / HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
INDEX_SCHEMA = "digest binary, keep_id bigint, keep_row bigint, copies bigint, first boolean"


def text_digest(text: Column | str) -> Column:
    return F.unhex(F.sha2(whole(text), 256))


class DigestIndex:
    """Digests seen so far, in a table of the warehouse or, where `location` is given, at that path."""

    def __init__(self, spark: SparkSession, name: str, buckets: int, location: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
            + (f" LOCATION '{location}'" if location else "")
        )

    def table(self) -> DataFrame:
        try:
            return self.spark.table(self.name)
        except AnalysisException as error:
            raise ValueError(f"no digest index {self.name}") from error

    def totals(self) -> DataFrame:
        """One row per digest: the document recorded first and all copies so far. Buckets are not shuffled."""
        entry = F.max(F.struct("first", "keep_id", "keep_row")).alias("entry")
        rows = self.table().groupBy("digest").agg(entry, F.sum("copies").alias("copies"))
        return rows.select("digest", "entry.keep_id", "entry.keep_row", "copies")

    def unseen(self, digests: DataFrame) -> DataFrame:
        """Rows of `digests` whose digest the index lacks."""
        return digests.hint("merge").join(self.table(), "digest", "left_anti")

    def append(self, digests: DataFrame) -> None:
        """Add rows; each bucket is written by one task as one sorted file."""
        rows = digests.select("digest", "keep_id", "keep_row", "copies", "first").repartition(self.buckets, "digest")
        writer = rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        writer.format("parquet").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def text_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, row) of every document, stored: what batches and verdicts are made from."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest"))
    return cut(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def add_batch(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Record a batch of `text_rows`: new digests with the row that stays, known ones with their further copies.

    Gives back the batch's digests that the index knew before, stored.
    """
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "doc_id", "row"))
    batch = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), best.alias("best"))
    batch = cut(batch.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "copies"), "digest-groups")
    new = cut(index.unseen(batch), "digests-new")
    none = F.lit(None).cast("bigint")
    more = batch.join(new.select("digest"), "digest", "left_anti").select("digest", none.alias("keep_id"), none.alias("keep_row"), "copies")
    more = cut(more, "digests-known")
    index.append(new.withColumn("first", F.lit(True)).unionByName(more.withColumn("first", F.lit(False))))
    drop_tables(batch, new)
    return more.select("digest")


def verdicts_of(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document of `text_rows` that the index has: doc_id, keep_id, group_size, kept, text_sha256.

    Digests with more than 1 / HOT_SHARE of all rows are fewer than HOT_SHARE, so their entries travel to the rows; all
    others meet by digest.
    """
    known = index.totals()
    limit = rows.count() / HOT_SHARE
    hot = F.broadcast(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("digest"))
    hot = cut(known.join(hot, "digest", "left_semi"), "digests-hot")
    marked = rows.join(F.broadcast(hot.select("digest", F.struct("keep_id", "keep_row", "copies").alias("hot"))), "digest", "left")
    mild = marked.filter("hot is null").join(known, "digest").select("doc_id", "digest", "row", "keep_id", "keep_row", "copies")
    bulk = marked.filter("hot is not null").select("doc_id", "digest", "row", "hot.*")
    return mild.unionByName(bulk).select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Appends the new digests to `index`.

    group_size counts the equal texts of this batch and of all batches before. Rows are numbered within a batch, so
    the rows of former batches are none of this one's.
    """
    rows = text_rows(docs, text, doc_id)
    known = add_batch(rows, index)
    # A digest recorded by an earlier batch keeps none of these rows.
    old = known.select(F.lower(F.hex("digest")).alias("text_sha256"), F.lit(True).alias("_old"))
    out = verdicts_of(rows, index).join(old, "text_sha256", "left").withColumn("kept", F.col("kept") & F.col("_old").isNull())
    out = cut(out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"), "digest-verdicts")
    drop_tables(rows, known)
    return out


def deduplicate_in_batches(docs: DataFrame, index: DigestIndex, batches: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`deduplicate` of one table by ranges of doc_id, the largest first, so that each batch meets what stays of the ones before.

    The verdicts are drawn from the index when it has all batches, and equal those of a single batch.
    """
    rows = text_rows(docs, text, doc_id)
    least, most = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = 0 if least is None else -(-(most - least + 1) // batches)
    for k in reversed(range(batches)):
        low = F.lit(True) if k == 0 else F.col("doc_id") >= (least or 0) + k * width
        high = F.lit(True) if k == batches - 1 else F.col("doc_id") < (least or 0) + (k + 1) * width
        none = F.col("doc_id").isNull() if k == 0 else F.lit(False)
        add_batch(rows.filter(none | (F.col("doc_id").isNotNull() & low & high)), index)
    return cut(verdicts_of(rows, index), "digest-verdicts")


def fresh_index(docs: DataFrame) -> DigestIndex:
    """An empty index under a name of its own, laid out for the number of `docs`."""
    buckets = max(LEAST_BUCKETS, -(-docs.count() // BUCKET_ROWS))
    return DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}", buckets)


def keep_first_copies(docs: DataFrame, index: DigestIndex, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns.

    The kept (doc_id, digest) pairs are joined back; that key is spread evenly however large a group of copies is.
    """
    verdicts = deduplicate(docs, index, text, doc_id)
    own, id_, digest = unused(docs, "_own"), unused(docs, "_id"), unused(docs, "_digest")
    kept = verdicts.filter("kept").select(F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(digest))
    same = (F.col(own) == F.col(digest)) & F.col(doc_id).eqNullSafe(F.col(id_))
    joined = docs.withColumn(own, text_digest(text)).join(kept, same, "left_semi")
    # Rows equal in both id and text pass the join together; one of them is the document that stays.
    repeated = verdicts.groupBy("doc_id", "text_sha256").count().filter("count > 1")
    repeated = cut(repeated.select(F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(digest)), "digest-repeats")
    if repeated.isEmpty():
        return joined.drop(own)
    single = joined.join(repeated, same, "left_anti")
    several = joined.join(repeated, same, "left_semi").dropDuplicates([doc_id, own])
    return single.unionByName(several).drop(own)
