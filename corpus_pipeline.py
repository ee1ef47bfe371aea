"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm.common import P, drop_table, materialise, named, table
from lakeseek.llm.decontaminate import decontaminate
from lakeseek.llm.language import keep_identified
from lakeseek.llm.line_dedup import line_dedup
from lakeseek.llm.mixing import mix_sources
from lakeseek.llm.simhash import near_dedup


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no identified language go: null texts, texts without letters, and of longer texts even scores and codes far longer than the language's.

    Each row is judged by its own text, repeated rows alike; very long texts are scored whole. With no language to learn all go. An empty table stays empty.
    """
    return keep_identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go from the texts; a document that loses all its lines goes, n_chars is of the new text.

    The first occurrence, by (doc_id, hash of the text, line), stays; fully equal rows share it and stay both. Null texts and texts of fewer lines stay as they are. An empty table stays empty.
    """
    kept = line_dedup(docs).filter((F.col(P + "n_removed_lines") == 0) | (F.col(P + "n_removed_lines") < F.col(P + "n_lines")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*[named(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays, of equal ids that of the smallest hash of the text; of fully equal rows one.

    Rows are told apart by id and text. Texts without words (null, empty) are one group. An empty table stays empty.
    """
    return near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, told by id and text; null and empty texts hold none. Equal rows go or stay together. Empty tables take nothing away."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's budget takes it, with its pass, block and place in the mix.

    A null source is one of its own; texts without words come with their block; equal rows are taken together. An empty table stays empty.
    """
    return mix_sources(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Language ID, SimHash and the mix's hashes have no form in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
            if before is not None:
                drop_table(before)
            before = docs
    return docs
