"""Incremental update: what changed between the current documents and the indexed ones, by id and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, n) of ids that occur more than once."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")


def diff(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(doc_id, content_hash, status): added, changed, unchanged or deleted, over (doc_id, content_hash) tables."""
    old = indexed.select("doc_id", F.col("content_hash").alias("old_hash"))
    both = current.select("doc_id", F.col("content_hash").alias("new_hash")).join(old, "doc_id", "full_outer")
    status = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    )
    return both.select("doc_id", F.coalesce("new_hash", "old_hash").alias("content_hash"), status.alias("status"))


def stats(changes: DataFrame) -> DataFrame:
    """One row (added, changed, deleted, unchanged)."""
    return changes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "deleted", "unchanged")])


def to_embed(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Current documents that are new or changed."""
    return current.join(changes.filter(F.col("status").isin("added", "changed")).select("doc_id"), "doc_id", "left_semi")


def kept_chunks(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Indexed chunk rows whose document is unchanged."""
    return chunks.join(changes.filter("status = 'unchanged'").select("doc_id"), "doc_id", "left_semi")


def deleted_ids(changes: DataFrame) -> DataFrame:
    return changes.filter("status = 'deleted'").select("doc_id")
