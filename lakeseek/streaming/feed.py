"""An index kept current from a stream of documents' changes.

Each micro-batch of (doc_id, text, op, seq) rows is reduced to the last row per document, then diffed against these documents' hashes in the index and
committed as one delta, so a batch writes what it changed and not the index; a batch that arrives again changes nothing. op is "upsert" or "delete".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.functions.text import content_hash, file_kind, language
from lakeseek.operators import update as upd
from lakeseek.plans import index as plans
from lakeseek.plans import store

CHANGES = "doc_id string, text string, op string, seq bigint"


def last_changes(batch: DataFrame) -> DataFrame:
    """The last row, by seq, of each document; an aggregation, so partial before the shuffle."""
    return batch.groupBy("doc_id").agg(F.max_by(F.struct("text", "op"), "seq").alias("last")).select("doc_id", "last.text", "last.op")


def as_documents(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "text", F.col("doc_id").alias("source_path"), language(F.col("doc_id")).alias("language"), content_hash(F.col("text")).alias("content_hash"), file_kind(F.col("doc_id")).alias("kind"))


def apply_changes(spark: SparkSession, batch: DataFrame, root: str, chunking: plans.Chunking, encoder) -> dict:
    """Apply one batch to the index in ``root`` (made if there is none); the manifest."""
    source = {"kind": "stream"}
    if store.manifest_of(spark, root) is None:
        fresh = as_documents(last_changes(batch).filter("op = 'upsert'"))
        return store.save(spark, root, plans.build(fresh, chunking, encoder), encoder.fingerprint(), chunking.config, source)
    manifest, tables = store.load(spark, root, encoder.fingerprint(), chunking.config, verify=False)
    last = last_changes(batch).persist()  # one micro-batch, and the rows of its documents
    known = tables["documents"].select("doc_id", "content_hash", F.size("chunk_ids").alias("held")).join(last.select("doc_id"), "doc_id", "left_semi").persist()
    try:
        fresh = as_documents(last.filter("op = 'upsert'"))
        changes = upd.diff(fresh, known)
        touched = changes.filter("status <> 'unchanged'")
        gone = touched.join(known.select("doc_id", "held"), "doc_id").agg(F.count("*"), F.sum("held")).first()
        if touched.isEmpty():
            return manifest
        docs = upd.to_embed(fresh, changes)
        chunks = plans.embed_chunks(chunking(docs), encoder).drop("text", "header")
        return store.save_delta(spark, root, manifest, touched, chunks, lambda written: plans.with_chunk_ids(docs, written), {"documents": gone[0], "chunks": gone[1] or 0})
    finally:
        known.unpersist()
        last.unpersist()


def follow(changes: DataFrame, root: str, checkpoint: str, chunking: plans.Chunking, encoder, **trigger):
    """Start the stream ``changes``; the running query."""

    def batch(df: DataFrame, _: int) -> None:
        apply_changes(df.sparkSession, df, root, chunking, encoder)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


class Reader:
    """Serves the newest committed generation; keeps the old one if the new can't be loaded."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.generation = spark, root, None
        self.manifest, self.tables = store.load(spark, root)
        self.generation = self.manifest["generation"]

    def refresh(self) -> bool:
        try:
            seen = store.manifest_of(self.spark, self.root)
            if seen is None or seen["generation"] == self.generation:
                return False
            self.manifest, self.tables = store.load(self.spark, self.root)
        except Exception:  # noqa: BLE001  an index being replaced: the one in memory goes on serving
            return False
        self.generation = self.manifest["generation"]
        return True


__all__ = ["CHANGES", "Reader", "apply_changes", "as_documents", "follow", "last_changes", "upd"]
