"""Grading and statistics: answers by line spans, lengths, separation of matching pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.functions import fixed
from lakeseek.functions.vectors import dot
from lakeseek.operators.scoring import score_blocks


def overlapping(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """``hits`` (query_id, path, start_line, end_line, ...) with in_file and in_span against spans (query_id, path, first_line, last_line).

    An equi-join on query and path; the interval condition is tested on what is left.
    """
    s = spans.select("query_id", "path", "first_line", "last_line")
    keys = [c for c in hits.columns]
    both = hits.join(s, ["query_id", "path"], "left")
    inside = (F.col("start_line") <= F.col("last_line")) & (F.col("end_line") >= F.col("first_line"))
    return both.groupBy(*keys).agg(F.max(F.col("first_line").isNotNull()).alias("in_file"), F.max(F.coalesce(inside, F.lit(False))).alias("in_span"))


def graded(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, file_rank, span_rank): first rank in a right file, and in a right span; hits have a rank."""
    found = overlapping(hits, spans).groupBy("query_id").agg(
        F.min(F.when(F.col("in_file"), F.col("rank"))).alias("file_rank"), F.min(F.when(F.col("in_span"), F.col("rank"))).alias("span_rank")
    )
    return spans.select("query_id").distinct().join(found, "query_id", "left")


def summary(grades: DataFrame) -> DataFrame:
    """One row (queries, strict_top1, file_top1, file_top3, file_top10, mrr)."""
    within = lambda c, k: F.count_if(F.coalesce(F.col(c) <= k, F.lit(False)))
    return grades.agg(
        F.count("*").alias("queries"), within("span_rank", 1).alias("strict_top1"), within("file_rank", 1).alias("file_top1"), within("file_rank", 3).alias("file_top3"),
        within("file_rank", 10).alias("file_top10"), F.round(F.coalesce(F.sum(1 / F.col("file_rank")), F.lit(0.0)) / F.count("*"), 3).alias("mrr"),
    )


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """One row (median): of n values in order the one at n div 2, from 0.

    Values are counted first, so what is ordered is the distinct values; a value's place is the running sum of the counts.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("v", "n")))
    merged = counts.agg(pairs.alias("p"), F.sum("n").alias("total"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(df.schema[column].dataType).alias("v"))
    step = lambda s, x: F.when(s["seen"] > F.floor(F.col("total") / 2), s).otherwise(F.struct((s["seen"] + x["n"]).alias("seen"), x["v"].alias("v")))
    return merged.select(F.aggregate("p", start, step)["v"].alias("median"))


def length_stats(df: DataFrame, column: str, limits=fixed.LENGTH_LIMITS) -> DataFrame:
    """One row: n, total, mean, max, p50, p75, p90, p95, p99 (interpolated), and per limit the count and share above it."""
    c = F.col(column)
    percentiles = [F.percentile(c, p / 100).alias(f"p{p}") for p in (50, 75, 90, 95, 99)]
    over = [x for n in limits for x in (F.count_if(c > n).alias(f"over_{n}"), F.avg((c > n).cast("double")).alias(f"share_over_{n}"))]
    return df.agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.max(c).alias("max"), *percentiles, *over)


def pair_separation(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (pairs, matched, mismatched, top1): mean similarity of pairs of equal ids and of different ids, and queries whose own partner is nearest.

    left and right (id, embedding). No pairs are made for the means: the similarities of one vector with all others add up to that with
    their sum. The nearest come from matrix products in blocks. Partners within 1e-9 of the nearest count as nearest.
    """
    sums = right.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    total = right.select(F.count("*").alias("n")).crossJoin(sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("whole")))  # one row each
    partner = right.select(F.col("id").alias("b"), F.col("embedding").alias("y"))
    own = left.join(partner, F.col("id") == F.col("b")).crossJoin(F.broadcast(total)).select("id", dot(F.col("embedding"), F.col("y")).alias("own"), dot(F.col("embedding"), F.col("whole")).alias("every"), "n")
    best = score_blocks(left.select(F.col("id").alias("query_id"), "embedding"), right.select(F.col("id").alias("doc_id"), "embedding"), "max", 1).groupBy("query_id").agg(F.max("score").alias("best"))
    each = own.join(best, F.col("id") == F.col("query_id"))
    mismatched = F.sum(F.col("every") - F.col("own")) / F.sum(F.col("n") - 1)
    return each.agg(F.count("*").alias("pairs"), F.avg("own").alias("matched"), mismatched.alias("mismatched"), F.avg((F.col("own") >= F.col("best") - 1e-9).cast("double")).alias("top1"))


def extrapolated_seconds(df: DataFrame, tokens: str, sample_tokens: int, sample_seconds: float) -> DataFrame:
    """One row (seconds): a sample's time scaled by tokens."""
    return df.agg((F.sum(tokens) * F.lit(sample_seconds) / F.lit(sample_tokens)).alias("seconds"))


def distinct_paths(results: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, paths): different files among the first k results."""
    return results.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count_distinct("path").alias("paths"))
