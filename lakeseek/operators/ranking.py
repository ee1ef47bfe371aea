"""Rankings: top-k documents, best chunks, fusion, re-ranking, feedback. Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions import fixed
from lakeseek.functions.vectors import dot


def ranked(run: DataFrame, by: str = "score", id_col: str = "doc_id", within: str = "query_id") -> DataFrame:
    """``run`` with its rank from 1: score descending, then id descending."""
    return run.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(F.desc(by), F.desc(id_col))))


def top_k(run: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The best k documents of each query; none for k <= 0."""
    return ranked(run, by).filter(F.col("rank") <= max(k, 0))


def best_chunks(scores: DataFrame, n: int = fixed.CHUNKS_PER_DOC) -> DataFrame:
    """(query_id, doc_id, chunk_rank, chunk_id, ordinal, score): each document's best chunks, earlier ones first on ties."""
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "ordinal")
    return scores.withColumn("chunk_rank", F.row_number().over(order)).filter(F.col("chunk_rank") <= n)


def hits(scores: DataFrame, n: int = fixed.CHUNKS_PER_DOC) -> DataFrame:
    """(query_id, doc_id, hits): the best chunks as an array, best first."""
    item = F.struct("chunk_rank", "chunk_id", "ordinal", "score")
    return best_chunks(scores, n).groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(item)).alias("hits"))


def rrf(first: DataFrame, second: DataFrame, k: int = fixed.RRF_K, head: int | None = None) -> DataFrame:
    """(query_id, doc_id, rrf, rank): reciprocal rank fusion of two rankings (query_id, doc_id, rank).

    With ``head``, only the first ``head`` of the first ranking are fused; the others keep their order below.
    """
    both = first.select("query_id", "doc_id", F.col("rank").alias("r1")).join(second.select("query_id", "doc_id", F.col("rank").alias("r2")), ["query_id", "doc_id"], "left")
    value = 1 / (F.lit(k) + F.col("r1")) + F.coalesce(1 / (F.lit(k) + F.col("r2")), F.lit(0.0))
    in_head = F.lit(True) if head is None else F.col("r1") <= head
    fused = both.withColumn("rrf", F.when(in_head, value))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc_nulls_last(), "r1")
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "rrf", "rank")


def rerank_head(first: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, rank): the first k by ``scores`` (query_id, doc_id, rerank_score), the tail as it was."""
    both = first.select("query_id", "doc_id", F.col("rank").alias("before")).join(scores.select("query_id", "doc_id", "rerank_score"), ["query_id", "doc_id"], "left")
    tail = F.col("before") > k
    order = Window.partitionBy("query_id").orderBy(tail, F.when(~tail, F.col("rerank_score")).desc_nulls_last(), "before")
    return both.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "rank")


def rank_as_score(run: DataFrame) -> DataFrame:
    """Scores that fall strictly with the rank, so that no metric sees a tie."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return run.withColumn("score", (n - F.col("rank") + 1).cast("double"))


def centroid(vectors: DataFrame, *by: str) -> DataFrame:
    """(*by, centroid): element-wise mean of the rows' embeddings."""
    each = vectors.select(*by, F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def prf(run: DataFrame, vectors: DataFrame, k: int, alpha: Column | float) -> DataFrame:
    """Pseudo relevance feedback: score + alpha * (centroid of the query's best k documents . document); run has score and rank, vectors (doc_id, embedding)."""
    best = run.filter(F.col("rank") <= k).select("query_id", "doc_id").join(vectors, "doc_id")
    middle = centroid(best, "query_id")
    scored = run.select("query_id", "doc_id", "score").join(vectors, "doc_id").join(middle, "query_id")
    value = F.col("score") + (alpha if isinstance(alpha, Column) else F.lit(float(alpha))) * dot(F.col("centroid"), F.col("embedding"))
    return scored.select("query_id", "doc_id", value.alias("score"))


def prf_grid(run: DataFrame, vectors: DataFrame, ks=fixed.PRF_DOCS, alphas=fixed.PRF_ALPHAS) -> DataFrame:
    """(k, alpha, query_id, doc_id, score) over the grid; one pass per k, alphas by explode."""
    out = None
    steps = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    for k in ks:
        best = run.filter(F.col("rank") <= k).select("query_id", "doc_id").join(vectors, "doc_id")
        scored = run.select("query_id", "doc_id", "score").join(vectors, "doc_id").join(centroid(best, "query_id"), "query_id")
        part = scored.select(F.lit(k).alias("k"), "query_id", "doc_id", "score", dot(F.col("centroid"), F.col("embedding")).alias("near")).withColumn("alpha", steps)
        part = part.select("k", "alpha", "query_id", "doc_id", (F.col("score") + F.col("alpha") * F.col("near")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def best_setting(means: DataFrame, metric: str) -> DataFrame:
    """The row of the largest ``metric``; on ties the smallest k, then alpha."""
    return means.orderBy(F.desc(metric), "k", "alpha").limit(1)
