"""Exact deduplication against a persistent index of text digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.llm.common import ascii_lower, join_groups, partitions
from cleargrain.session import stage, staged_path


class DigestIndex:
    """Table (digest, keep_id) bucketed and sorted by digest, one row per distinct text seen so far.

    The table lives at ``path``, so a later session opens it again by the same path and number of buckets. A batch is
    reduced to one row per digest, anti-joined with the index by sort-merge (the index side is not shuffled) and what is
    new is appended. Texts of earlier batches therefore win over equal texts of later ones.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or partitions(spark)
        self.path = path or staged_path(spark, "digest-index")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.name} (digest binary, keep_id bigint) using parquet "
            f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, hashed: DataFrame) -> DataFrame:
        """(digest, keep_id) of the digests that the index lacks; the largest doc_id of the batch stays."""
        latest = hashed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        return latest.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, hashed: DataFrame) -> None:
        """Append the new digests of a batch (doc_id, digest)."""
        fresh = self.unseen(hashed).select("digest", "keep_id")
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forget the table's name; its files stay at ``path``."""
        self.spark.sql(f"drop table if exists {self.name}")


def hash_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, row): SHA-256 of each text after lower-casing A-Z; null counts as the empty text."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(F.encode(ascii_lower(F.col("text")), "UTF-8"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def exact_classes(hashed: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of a stored batch that the index has taken in.

    Columns doc_id, keep_id, group_size (rows of the batch with that text), kept, text_sha256. Null ids are smaller than
    any other. Of rows that repeat both text and doc_id one is kept. A text that came with an earlier batch keeps the
    doc_id from there, and none of this batch's rows. An empty batch gives an empty result; other columns are not read.
    """
    groups = hashed.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("last")
    )
    facts = groups.join(index.rows(), "digest").select(
        "digest", "group_size", "keep_id",
        F.when(F.col("last.doc_id").eqNullSafe(F.col("keep_id")), F.col("last.row")).alias("keep_row"),
    )
    return join_groups(hashed, stage(facts, "digest-groups"), "digest", "group_size").select(
        "doc_id", "keep_id", "group_size",
        F.col("row").eqNullSafe(F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Deduplicate a batch of documents against ``index`` (default: a new one) and add it; see exact_classes."""
    hashed = stage(hash_rows(docs), "digests")
    index = index or DigestIndex(docs.sparkSession)
    index.add(hashed)
    return exact_classes(hashed, index)


def exact_dedup_in_two(docs: DataFrame) -> DataFrame:
    """Exact classes of a whole table that arrives as two batches, the upper half of its ids first.

    So the largest doc_id of equal texts stays, and the second batch meets an index that is already filled.
    """
    hashed = stage(hash_rows(docs), "digests")
    low, high = hashed.agg(F.min("doc_id"), F.max("doc_id")).first()
    upper = F.coalesce(F.col("doc_id") >= F.lit(((low or 0) + (high or 0)) // 2), F.lit(False))
    index = DigestIndex(docs.sparkSession)
    index.add(hashed.filter(upper))
    index.add(hashed.filter(~upper))
    return exact_classes(hashed, index)
