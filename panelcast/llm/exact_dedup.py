"""Exact dedup against a persistent digest index.

The index is a table of (digest, keep_id), bucketed and sorted by digest in the shared folder. New documents are
reduced to one row per digest (partial aggregation before the shuffle, so a digest held by a third of all rows is
one row per task), deduplicated against the index by a sort-merge anti-join that does not move the index, and the
digests that were not there are appended.

Null text counts as empty. Texts are equal if they are identical after each run of ASCII white space has become one
space. Rows without doc_id take part; they stay only if no row of their text has one. Rows that repeat both doc_id
and text are one document and get the same decision. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, shared_folder, shuffle_width, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """An index at `path`; the same path and number of buckets attach to it again in a later session."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.name = spark, f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        self.buckets = buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, docs: DataFrame) -> DataFrame:
        """Decide on new documents (doc_id, text) and add their digests: one row per document with doc_id, keep_id,
        group_size (rows of that text among the new ones), kept and text_sha256. A row whose doc_id and text the index
        holds already is the document that it keeps: a batch that is appended again, after a crash at any point, gets
        the decisions of its first run."""
        digests = written(docs.select(F.col("doc_id").cast("long"), digest_of(F.col("text")).alias("digest")), "digests")
        groups = written(digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "digest-groups")
        known = self.rows()
        # Before the append: what the index already holds of these digests.
        old = written(groups.hint("merge").join(known, "digest").select("digest", "keep_id", F.lit(True).alias("older")), "known-digests")
        fresh = groups.hint("merge").join(known, "digest", "left_anti")
        (
            fresh.select("digest", F.col("first_id").alias("keep_id"))
            .repartition(self.buckets, "digest")
            .write.insertInto(self.name)
        )
        # A text of one new row that the index did not hold needs no partner; the others are looked up. Both sides
        # are dealt by digest, so a hot digest is split by the adaptive skew join.
        shared = (
            groups.join(old, "digest", "left")
            .where((F.col("group_size") > 1) | F.col("older"))
            .select("digest", F.when(F.col("older"), F.col("keep_id")).otherwise(F.col("first_id")).alias("kept_id"), "group_size")
        )
        found = digests.join(shared, "digest", "left")
        alone = F.col("group_size").isNull()
        keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("kept_id"))
        return found.select(
            "doc_id",
            keep_id.alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def exact_duplicates(docs: DataFrame, index_path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Decisions on docs against the index at index_path (a new one by default), which is extended by them."""
    spark = docs.sparkSession
    path = index_path or f"{shared_folder(spark)}/digest-index-{uuid.uuid4().hex}"
    return DigestIndex(spark, path, buckets or shuffle_width(spark)).append(docs)


def drop_duplicates(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat doc_id and text, one."""
    kept = exact_duplicates(docs, index_path).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    whole = docs.withColumn("__sha", digest_of(F.col("text")))
    both = whole.join(kept, whole["doc_id"].eqNullSafe(kept["__id"]) & (whole["__sha"] == kept["__sha"]), "left_semi")
    repeats = docs.groupBy("doc_id").count().where("count > 1").limit(1)
    if not repeats.isEmpty():
        both = both.dropDuplicates(["doc_id", "__sha"])
    return both.select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
