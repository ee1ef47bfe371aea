"""Ranking quality. run(query_id, doc_id, score), qrels(query_id, doc_id, relevance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.operators.ranking import ranked


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, ndcg, mrr, recall, precision, average_precision, hit) at k for every query of ``queries``, by default those of the run.

    Gain is linear, the discount log2(rank + 1), negative relevance counts as 0; a query without relevant documents scores 0.
    """
    queries = run.select("query_id").distinct() if queries is None else queries.select("query_id").distinct()
    labels = qrels.select("query_id", "doc_id", F.greatest(F.col("relevance"), F.lit(0)).alias("gain"))
    top = ranked(run).filter(F.col("rank") <= k).join(labels, ["query_id", "doc_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    relevant = F.col("gain") > 0
    got = top.groupBy("query_id").agg(
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.min(F.when(relevant, F.col("rank"))).alias("first"),
        F.count_if(relevant).alias("found"),
        F.array_sort(F.collect_list(F.when(relevant, F.col("rank")))).alias("ranks"),
    )
    # equal gains are counted, not ranked one by one: they take the ranks from the one after those above
    counted = labels.filter("gain > 0").groupBy("query_id", "gain").agg(F.count("*").alias("n"))
    counted = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("gain"))))
    ranks = F.when(F.col("upto") - F.col("n") < k, F.sequence(F.col("upto") - F.col("n") + 1, F.least(F.col("upto"), F.lit(k).cast("long"))))
    gained = F.aggregate(F.transform(ranks, lambda r: F.col("gain") / F.log2(r + 1)), F.lit(0.0), lambda s, x: s + x)
    ideal = counted.groupBy("query_id").agg(F.sum(gained).alias("idcg"), F.sum("n").alias("relevant"))
    all_ = queries.join(got, "query_id", "left").join(ideal, "query_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    precision_sum = F.aggregate(F.transform("ranks", lambda r, i: (i + 1) / r), F.lit(0.0), lambda s, x: s + x)
    return all_.select(
        "query_id",
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("found") / F.col("relevant")).alias("recall"),
        zero(F.col("found") / F.lit(k)).alias("precision"),
        zero(precision_sum / F.col("relevant")).alias("average_precision"),
        zero(F.when(F.col("found") > 0, F.lit(1.0))).alias("hit"),
    )


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10, queries: DataFrame | None = None) -> DataFrame:
    """One row of means over the queries; 0 if there are none. A query of the run without any label row raises when evaluated."""
    each = per_query(run, qrels, k, queries)
    known = qrels.select("query_id").distinct().withColumn("known", F.lit(True))
    each = each.join(known, "query_id", "left").withColumn("known", F.when(F.col("known"), True).otherwise(F.raise_error(F.concat(F.lit("no labels for query "), F.col("query_id").cast("string"))).cast("boolean")))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("known"), F.col(c))), F.lit(0.0)).alias(c)
    return each.agg(*[mean(c) for c in ("ndcg", "mrr", "recall", "precision", "average_precision", "hit")], F.count("*").alias("queries"))


def better_worse(base: DataFrame, variant: DataFrame, metric: str = "ndcg", slack: float = 1e-12) -> DataFrame:
    """One row (better, worse, equal): queries on which the variant's metric is higher or lower."""
    both = base.select("query_id", F.col(metric).alias("a")).join(variant.select("query_id", F.col(metric).alias("b")), "query_id")
    change = F.col("b") - F.col("a")
    return both.agg(F.count_if(change > slack).alias("better"), F.count_if(change < -slack).alias("worse"), F.count_if(F.abs(change) <= slack).alias("equal"))


def recall_any(candidates: DataFrame, qrels: DataFrame, depth: int) -> DataFrame:
    """One row: share of queries with a relevant document among the first ``depth`` candidates (query_id, doc_id, rank)."""
    relevant = qrels.filter("relevance > 0").select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    each = candidates.filter(F.col("rank") <= depth).join(relevant, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return each.agg(F.avg("hit").alias("recall_any"))
