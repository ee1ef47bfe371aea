"""Answering queries from an index: score, group, adjust, rank, cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.functions import fixed
from lakeseek.functions.vectors import dot, encode
from lakeseek.operators import ranking, scoring, snippets
from lakeseek.operators import versions as ver


def embed_queries(queries: DataFrame, encoder) -> DataFrame:
    """queries (query_id, text) with their embedding."""
    return encode(queries.select("query_id", "text"), "text", encoder)


def search(
    queries: DataFrame, tables: dict[str, DataFrame], top_k: int = 10, aggregate: str = "max", kind_penalty: float = 0.0, code_only: bool = False, chunks_per_doc: int = fixed.CHUNKS_PER_DOC,
    blocks: bool = False,
) -> DataFrame:
    """(query_id, rank, doc_id, score, rank_score, kind, source_path, language, hits) of queries (query_id, embedding).

    With code_only, other documents are dropped before anything is scored. With ``blocks`` scores are matrix products and the best chunks are scored
    again for the ranked documents only; results are equal.
    """
    scoring.check_aggregate(aggregate)
    docs = tables["documents"].select("doc_id", "kind", "source_path", "language")
    docs = docs.filter("kind = 'code'") if code_only else docs
    chunks = tables["chunks"].join(docs.select("doc_id"), "doc_id", "left_semi") if code_only else tables["chunks"]
    if blocks:
        flat = aggregate == "max" and kind_penalty == 0
        totals = scoring.score_blocks(queries, chunks, aggregate, top_k if flat else None)
    else:
        scores = scoring.score(queries, chunks, "start_line", "end_line")
        totals = scoring.document_scores(scores, aggregate)
    value = scoring.rank_score(F.col("score"), F.col("kind"), kind_penalty)
    best = ranking.top_k(totals.join(docs, "doc_id").withColumn("rank_score", value), top_k, "rank_score")
    # only the ranked pairs are scored again, an equi-join
    asked = best.select("query_id", "doc_id").join(queries.select("query_id", F.col("embedding").alias("q_embedding")), "query_id")
    pairs = chunks.join(asked, "doc_id").select("query_id", "doc_id", "chunk_id", "ordinal", "start_line", "end_line", dot(F.col("q_embedding"), F.col("embedding")).alias("score"))
    item = F.struct("chunk_rank", "chunk_id", "start_line", "end_line", "score")
    hits = ranking.best_chunks(pairs, chunks_per_doc).groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(item)).alias("hits"))
    return best.join(hits, ["query_id", "doc_id"]).select("query_id", "rank", "doc_id", "score", "rank_score", "kind", "source_path", "language", "hits")


def cited(results: DataFrame, queries: DataFrame, indexed: DataFrame, current: DataFrame, focused: bool = True) -> DataFrame:
    """``results`` with the best hit's snippet (text, status), its focus line and matching lines, as rows to show. queries (query_id, text)."""
    first = results.withColumns({"start_line": F.col("hits")[0]["start_line"], "end_line": F.col("hits")[0]["end_line"]})
    shown = snippets.snippets(first, indexed, current)
    if not focused:
        return shown.withColumns({"focus_line": F.lit(None).cast("int"), "match_lines": F.array().cast("array<int>")})
    ok = shown.filter("snippet.status = 'ok'").join(queries.select("query_id", F.col("text").alias("query")), "query_id").select("query_id", "doc_id", "start_line", F.col("snippet.text").alias("text"), "query")
    both = shown.join(snippets.focus_and_matches(ok, "query", "query_id", "doc_id"), ["query_id", "doc_id"], "left")
    both = both.withColumn("focus", F.when(F.col("snippet.status") == "ok", F.coalesce("focus", F.lit(0))))
    lines = F.transform(F.coalesce("match", F.array().cast("array<int>")), lambda i: i + F.col("start_line"))
    return both.withColumns({"focus_line": F.col("focus") + F.col("start_line"), "match_lines": lines}).drop("focus", "match")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text per result row; scores to six places."""
    fields = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*fields)).alias("json"))


def search_versions(queries: DataFrame, tables: dict[str, DataFrame], top_k: int = 10, version: str | None = None, kind_penalty: float = 0.0, code_only: bool = False) -> DataFrame:
    """(query_id, path, rank, position, revision_id, score, rank_score, versions, start_line, end_line, contains_match, match_line): files, with all their revisions.

    ``version`` is a tag or a sha prefix of one indexed commit.
    """
    docs = tables["documents"].select("doc_id", "kind", "source_path")
    docs = docs.filter("kind = 'code'") if code_only else docs
    chunks = tables["chunks"].join(docs.select("doc_id"), "doc_id", "left_semi")
    scores = scoring.score(queries, chunks, "start_line", "end_line")
    totals = scoring.document_scores(scores).join(docs, "doc_id").withColumn("rank_score", scoring.rank_score(F.col("score"), F.col("kind"), kind_penalty))
    last = ver.newest(tables["bridge"], tables["commits"])
    scored = totals.withColumnsRenamed({"doc_id": "revision_id", "source_path": "path"}).join(last, "revision_id").select("query_id", "path", "revision_id", "score", "rank_score", "newest")
    held = None
    if version is not None:
        held = tables["bridge"].join(ver.resolve(tables["commits"], version).select("sha"), "sha", "left_semi")
    grouped = ver.group_by_path(scored, top_k, held)
    best = ranking.best_chunks(scores, 1).select("query_id", F.col("doc_id").alias("revision_id"), "start_line", "end_line")
    texts = tables["documents"].select(F.col("doc_id").alias("revision_id"), "text")
    from lakeseek.functions.text import line_slice, split_lines

    primary = grouped.filter("position = 1").join(best, ["query_id", "revision_id"]).join(texts, "revision_id", "left")
    matched = primary.select("query_id", "path", "start_line", line_slice(split_lines(F.col("text")), F.col("start_line"), F.col("end_line")).alias("match"))
    shown = ver.contains_match(grouped, matched, texts).join(best, ["query_id", "revision_id"], "left")
    labels = tables["bridge"].join(tables["commits"].select("sha", "ordinal"), "sha").groupBy("revision_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "sha"))), lambda x: x["sha"]).alias("versions"))
    return shown.join(labels, "revision_id", "left")


def evaluate_index(queries: DataFrame, qrels: DataFrame, tables: dict[str, DataFrame], k: int = 10, depth: int = fixed.EVAL_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(means, per query): retrieve ``depth`` documents by raw score, then rank for the metric, so that the metric settles ties at the cut."""
    from lakeseek.operators import metrics

    run = ranking.top_k(scoring.score_blocks(queries, tables["chunks"], "max", depth), depth).select("query_id", "doc_id", "score")
    asked = queries.select("query_id")
    return metrics.evaluate(run, qrels, k, asked), metrics.per_query(run, qrels, k, asked)
