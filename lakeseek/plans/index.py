"""Building and updating an index: chunk, embed, diff. Tables in, tables out; ``store`` keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.functions.vectors import encode
from lakeseek.operators import update as upd
from lakeseek.operators import versions as ver
from lakeseek.operators.chunking import CHUNK_COLUMNS, WordTokenizer, chunk

_CHUNKS = [c.split()[0] for c in CHUNK_COLUMNS.split(", ")]


class Chunking:
    """Settings of a chunker, as kept with an index."""

    def __init__(self, name: str = "windows", max_length: int = 1024, overlap: int = 128, header: bool = True, tokenizer=None):
        from lakeseek.operators.chunking import chunking_config

        self.name, self.max_length, self.overlap, self.header = name, max_length, overlap, header and name != "none"
        self.tokenizer = tokenizer or WordTokenizer()
        self.config = chunking_config(name, max_length, overlap, self.header)

    def __call__(self, docs: DataFrame, path_col: str = "doc_id") -> DataFrame:
        return chunk(docs, self.name, self.tokenizer, self.max_length, self.overlap, self.header, path_col)


def refuse_duplicates(docs: DataFrame) -> None:
    twice = [r[0] for r in upd.duplicate_ids(docs).limit(5).collect()]
    if twice:
        raise ValueError(f"documents' ids must be unique; repeated: {', '.join(map(str, twice))}")


def embed_chunks(chunks: DataFrame, encoder) -> DataFrame:
    """Chunks with their embedding; what is embedded is header and text together."""
    return encode(chunks.withColumn("embed_text", F.concat("header", "text")), "embed_text", encoder).drop("embed_text")


def with_chunk_ids(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    listed = chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    return docs.drop("chunk_ids").join(listed, "doc_id", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def build(docs: DataFrame, chunking: Chunking, encoder) -> dict[str, DataFrame]:
    """{documents, chunks} of documents (doc_id, text, content_hash, ...). The chunk table has positions and vectors; texts stay with the documents."""
    refuse_duplicates(docs)
    chunks = embed_chunks(chunking(docs), encoder).drop("text", "header")
    return {"documents": with_chunk_ids(docs, chunks), "chunks": chunks}


def update(docs: DataFrame, indexed: dict[str, DataFrame], chunking: Chunking, encoder) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, one-row stats) of the current documents, complete; only new and changed ones are chunked and embedded."""
    refuse_duplicates(docs)
    changes = upd.diff(docs, indexed["documents"])
    fresh = embed_chunks(chunking(upd.to_embed(docs, changes)), encoder).drop("text", "header")
    chunks = upd.kept_chunks(indexed["chunks"], changes).unionByName(fresh)
    stats = upd.stats(changes).crossJoin(fresh.agg(F.count("*").alias("chunks_embedded")))  # one row each
    return {"documents": with_chunk_ids(docs, chunks), "chunks": chunks}, stats


def build_versions(snapshots: DataFrame, commits: DataFrame, chunking: Chunking, encoder, existing: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, per-commit stats) of an index over snapshots (sha, path, text, language, kind), added to ``existing``.

    Tables: documents (one per revision), chunks (doc_id is the revision's id), bridge (revision_id, sha), commits.
    """
    new = commits if existing is None else ver.wanted(commits, existing["commits"])
    snaps = snapshots.join(new.select("sha"), "sha", "left_semi")
    found, bridge = ver.revisions(snaps)
    extra = snaps.withColumn("revision_id", ver.revision_id(F.col("path"), F.sha2("text", 256))).groupBy("revision_id").agg(F.first("language").alias("language"), F.first("kind").alias("kind"))
    known_revisions = known = None
    fresh = found
    if existing is not None:
        known_revisions = existing["documents"].select(F.col("doc_id").alias("revision_id"))
        known = existing["chunks"].select("text_key", "embedding")
        fresh = found.join(known_revisions, "revision_id", "left_anti")
    docs = fresh.join(extra, "revision_id").select(F.col("revision_id").alias("doc_id"), "text", F.col("path").alias("source_path"), "language", "content_hash", "kind")
    chunks = ver.keyed_chunks(chunking(docs, "source_path"))
    empty = chunks.sparkSession.createDataFrame([], "text_key string, embedding array<double>")
    both, unseen = ver.reuse_vectors(chunks, empty if known is None else known)
    embedded = embed_chunks(unseen, encoder).select("text_key", F.col("embedding").alias("fresh"))
    both = both.join(embedded, "text_key", "left").withColumn("embedding", F.coalesce("embedding", "fresh")).drop("fresh", "text", "header")
    all_commits = ver.ordered((new if existing is None else existing["commits"].unionByName(new, allowMissingColumns=True)).drop("ordinal"))
    stats = ver.commit_stats(bridge, both.withColumnRenamed("doc_id", "revision_id"), all_commits, known, known_revisions)
    documents = with_chunk_ids(docs, both)
    if existing is not None:
        documents = existing["documents"].unionByName(documents)
        both = existing["chunks"].unionByName(both)
        bridge = existing["bridge"].unionByName(bridge)
    return {"documents": documents, "chunks": both, "bridge": bridge, "commits": all_commits}, stats


def tables_of(spark: SparkSession, root: str, **options):
    from lakeseek.plans.store import load

    return load(spark, root, **options)
