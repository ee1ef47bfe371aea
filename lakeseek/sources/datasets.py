"""Dataset tables: corpus, queries with labels, vectors, span questions, zip archives."""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.functions.text import content_hash, document_text


def corpus(raw: DataFrame) -> DataFrame:
    """Documents from (_id, title, text, language, partition)."""
    text = document_text(F.col("title"), F.col("text"))
    return raw.select(
        F.col("_id").alias("doc_id"), text.alias("text"), F.col("_id").alias("source_path"), F.lower("language").alias("language"), content_hash(text).alias("content_hash"), F.col("partition")
    )


def queries_and_labels(queries: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query_id, text) of the labelled queries, (query_id, doc_id, relevance)) from (_id, text) and (query-id, corpus-id, score)."""
    qrels = labels.select(F.col("`query-id`").alias("query_id"), F.col("`corpus-id`").alias("doc_id"), F.col("score").cast("int").alias("relevance"))
    known = queries.select(F.col("_id").alias("query_id"), "text")
    return known.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), qrels


def first_queries(queries: DataFrame, n: int, ordinal: str = "query_id") -> DataFrame:
    if n < 1:
        raise ValueError("the limit must be at least 1")
    return queries.orderBy(ordinal).limit(n)


def span_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, q, path, first_line, last_line) from a JSON list of {q, correct: [[path, first, last]], related}."""
    raw = spark.read.option("multiLine", True).schema("q string, correct array<array<string>>, related array<string>").json(path)
    each = raw.select(F.md5("q").alias("query_id"), "q", F.explode("correct").alias("c"))
    return each.select("query_id", "q", F.col("c")[0].alias("path"), F.col("c")[1].cast("int").alias("first_line"), F.col("c")[2].cast("int").alias("last_line"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, embedding) written before."""
    return spark.read.parquet(path)


def unpack_zip(archive: str, target: str) -> str:
    """Unpack beside ``target``, then swap it in. Entries that would leave it raise; one folder around everything goes."""
    parent = os.path.dirname(os.path.abspath(target))
    os.makedirs(parent, exist_ok=True)
    fresh = tempfile.mkdtemp(prefix=".unpack-", dir=parent)
    try:
        with zipfile.ZipFile(archive) as z:
            root = os.path.realpath(fresh)
            for name in z.namelist():
                if os.path.commonpath([root, os.path.realpath(os.path.join(root, name))]) != root:
                    raise ValueError(f"the archive's entry {name!r} leads out of the target")
            z.extractall(fresh)
        top = os.listdir(fresh)
        inner = os.path.join(fresh, top[0]) if len(top) == 1 and os.path.isdir(os.path.join(fresh, top[0])) else fresh
        if os.path.exists(target):
            shutil.rmtree(target)
        os.replace(inner, target)
    finally:
        shutil.rmtree(fresh, ignore_errors=True)
    return target
