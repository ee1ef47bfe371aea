"""The queries opN_<name>: each operator over its whole table with production parameters, as the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm.common import P, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeseek.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and item; clean documents have none."""
    from lakeseek.llm.decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col(P + "id").alias("doc_id"), "item_id", "start_word", "n_item_words", F.round("similarity", 6).alias("similarity"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeseek.llm.line_dedup import line_dedup

    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col(P + "n_lines").alias("n_lines"), F.col(P + "n_removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeseek.llm.simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col(P + "id").alias("doc_id"), F.lower(F.lpad(F.hex(P + "fp"), 16, "0")).alias("fingerprint"), F.col(P + "component").alias("component_id"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: one row per document and pass that takes it."""
    from lakeseek.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op4_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeseek.llm.merkle import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeseek.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeseek.llm.class_lm import class_lm

    return class_lm(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeseek.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeseek.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"), "page_id", "html", "url")


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_temperature_mixing, op3_decontamination, op4_merkle_fingerprint, op5_toxicity, op6_line_dedup, op7_simhash, op8_class_lm, op9_language_id,
        op10_html_extraction,
    )
}

ORACLE_SQL = {
    "op1_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i + 1:i + 35], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)
), hit AS (
  SELECT DISTINCT doc_id, i + j AS pos
  FROM (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1), range(0, 35) AS r(j)
), gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM word ANTI JOIN hit USING (doc_id, pos) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op3_decontamination": r"""
WITH d AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark
), bs AS (
  SELECT item_id, n, array_to_string(ws[j + 1:j + 5], ' ') AS s FROM (SELECT item_id, ws, len(ws) AS n, unnest(range(0, len(ws) - 4)) AS j FROM b WHERE len(ws) >= 5)
), ds AS (
  SELECT id, n, p, array_to_string(ws[p + 1:p + 5], ' ') AS s FROM (SELECT id, ws, len(ws) AS n, unnest(range(0, len(ws) - 4)) AS p FROM d WHERE len(ws) >= 5)
), hit AS (
  SELECT DISTINCT ds.id, bs.item_id, bs.n, ds.n AS n_doc, p FROM ds JOIN bs ON ds.s = bs.s
), win AS ( -- every window that holds any shingle of the item
  SELECT DISTINCT id, item_id, n, n_doc, unnest(range(greatest(0, p - n + 5), least(p, greatest(0, n_doc - n)) + 1)) AS start FROM hit
), inside AS (
  SELECT win.id, item_id, win.n, n_doc, start, s, count(*) AS a FROM win JOIN ds ON ds.id = win.id AND p >= start AND p < start + win.n - 4 GROUP BY ALL
), sizes AS (SELECT id, item_id, start, sum(a) AS mw FROM inside GROUP BY ALL),
item AS (SELECT item_id, s, count(*) AS c FROM bs GROUP BY ALL),
common AS (
  SELECT id, item_id, n, n_doc, start, sum(least(a, c)) AS k FROM inside JOIN item USING (item_id, s) GROUP BY ALL
), judged AS (
  SELECT id, item_id, n, n_doc, start, k / (mw + n - 4 - k) AS sim FROM common JOIN sizes USING (id, item_id, start)
), best AS (SELECT id, item_id, max(sim) AS sim FROM judged WHERE sim >= 0.8 - 1e-9 GROUP BY ALL),
has AS (SELECT DISTINCT id, n, p FROM hit) -- shingles that an item of the size has
SELECT j.id AS doc_id, j.item_id, min(start)::BIGINT AS start_word, j.n::BIGINT AS n_item_words, round(any_value(j.sim), 6) AS similarity
FROM judged j JOIN best ON best.id = j.id AND best.item_id = j.item_id AND best.sim = j.sim
LEFT JOIN has x ON x.id = j.id AND x.n = j.n AND x.p = start LEFT JOIN has y ON y.id = j.id AND y.n = j.n AND y.p = start - 1
LEFT JOIN has z ON z.id = j.id AND z.n = j.n AND z.p = start + j.n - 5
WHERE start >= n_doc - j.n OR (x.p IS NOT NULL AND (y.p IS NULL OR z.p IS NOT NULL))
GROUP BY j.id, j.item_id, j.n""",
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents
), w AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), f AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w
  WHERE c IS NOT NULL AND NOT regexp_full_match(a || b || c, '[\x20\x09-\x0D]*')
), cov AS (SELECT DISTINCT doc_id, pos + j AS pos FROM f, range(0, 3) AS r(j) WHERE k > 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM l ANTI JOIN cov USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
