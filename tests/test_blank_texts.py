"""Empty and blank texts, and none, among the documents: rows as the SQL has them."""

import shutil

import oracle
import pytest

from lakeseek.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ("commit_stats", "skip_histogram", "document_lines", "skip_reasons", "text_key_reuse", "version_stats", "window_chunks", "chunk_gaps", "chunk_line_median")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("blank")
    shutil.copy(f"{SF}/benchmark.parquet", out)
    blank = "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 35 = 1 THEN ' ' WHEN doc_id % 35 = 3 THEN ' \t  ' ELSE text END"
    spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", f"{blank} AS text", "lang", "source", "n_chars").write.parquet(f"{out}/documents.parquet")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_blank_texts(spark, tables, name):
    assert oracle.difference(catalogue.QUERIES[name](spark, tables), catalogue.SQL[name], oracle.connect(tables)) == ""


def test_lines_of_no_text(spark):
    from pyspark.sql import functions as F

    from lakeseek.functions.text import split_lines

    rows = spark.createDataFrame([("",), ("\n",), ("a\n",), (None,)], "t string").select(split_lines(F.col("t"), True), split_lines(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [([""], []), (["\n"], ["\n"]), (["a\n"], ["a\n"]), (None, [])]
